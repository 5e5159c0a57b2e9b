"""Url parts, rules, and reputation against a plain computation."""

from pyspark.sql import functions as F

from trustweave.llm import url_reputation as u

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def test_parts_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://example.org"), (4, "x://B.com/de/"), (5, "x://b.com/fr/1"), (6, "nothing"), (7, None), (8, ""),
        (9, "a://İ.org?x/://y"), (10, "http://h.net#/de/"), (10, "http://h.net#/de/"), (None, "http://notexample.org/es/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    out = {(r.page_id, r.url): r for r in u.judge_urls(pages, outcomes, RULES).collect()}
    got = lambda *k: (out[k].host, out[k].path, out[k].rule, out[k].verdict)
    assert got(1, rows[0][1]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got(2, rows[1][1]) == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got(3, rows[2][1]) == ("example.org", "", None, "allow")
    assert got(4, rows[3][1]) == ("b.com", "/de/", "com/de/", "block")
    assert got(5, rows[4][1]) == ("b.com", "/fr/1", "com/fr/", "allow")
    assert got(6, "nothing")[:3] == got(7, None)[:3] == got(8, "")[:3] == ("", "", None)
    assert got(9, rows[8][1])[:3] == ("İ.org", "", None)
    assert got(None, rows[11][1])[2] == "org/"
    assert u.judge_urls(pages, outcomes, RULES).count() == len(rows)
    assert u.judge_urls(pages.limit(0), outcomes, RULES).count() == 0


def test_domains(spark):
    hosts = ["a.b.example.com", "example.com", "x.y.co.uk", "co.uk", "localhost", "10.0.0.1", "10.0.0.1:80", "u@a.org:9", "", "a..b"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    d, s = u.domain_columns(F.col("h"))
    got = {r.h: (r.d, r.s) for r in df.select("h", d.alias("d"), s.alias("s")).collect()}
    assert got["a.b.example.com"] == got["example.com"] == ("example.com", "com")
    assert got["x.y.co.uk"] == ("y.co.uk", "co.uk") and got["co.uk"] == ("co.uk", "co.uk")
    assert got["localhost"] == ("localhost", "localhost") and got["10.0.0.1"] == got["10.0.0.1:80"] == ("10.0.0.1", "")
    assert got["u@a.org:9"] == ("a.org", "org") and got[""] == ("", "")


def test_bad_hosts_are_blocked_and_few_labels_are_not(spark):
    pages = [(k, f"http://{h}/{k}") for k, h in enumerate(["bad.one.com"] * 60 + ["good.one.com"] * 60 + ["fresh.one.com"] * 2 + ["other.net"] * 60)]
    labels = [(k, 1) for k in range(60)] + [(k, 0) for k in range(60, 120)] + [(120, 1)] + [(k, 0) for k in range(122, 182)] + [(None, 1), (5, None)]
    out = u.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), ()).collect()
    by = {}
    for r in out:
        by.setdefault(r.host, set()).add(r.verdict)
    assert by == {"bad.one.com": {"block"}, "good.one.com": {"allow"}, "fresh.one.com": {"allow"}, "other.net": {"allow"}}


def test_registered_query_blocks_bad_hosts_of_few_labels_among_many_good_ones(spark, tmp_path):
    from trustweave.llm import queries

    # 6 bad hosts of 10 to 30 labels, three of them in a domain with good hosts; the rest good
    bad = {f"bad{k}.{'mixed.net' if k % 2 else f'own{k}.net'}": 10 + 4 * k for k in range(6)}
    good = {f"h{k}.{'mixed.net' if k < 6 else f'site{k}.net'}": 10 + k % 21 for k in range(80)}
    pages, labels = [], []
    for host, n in {**bad, **good}.items():
        for k in range(n):
            wrong = (k % 10 != 9) if host in bad else (k % 10 == 9)  # nine of ten, or one of ten
            labels.append((len(pages), 0 if wrong else 1, 0))
            pages.append((len(pages), f"http://{host}/en/{k}", ""))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op2_url_filters(spark, str(tmp_path)).collect()
    assert len(out) == len(pages) and all(r.rule is None for r in out)
    assert {r.host for r in out if r.verdict == "block"} == set(bad)
    assert {r.host for r in out if r.verdict == "allow"} == set(good)


def test_urls_without_a_host_are_judged_by_all_pages(spark):
    pages = [(k, None if k % 2 else "nothing") for k in range(400)] + [(k, f"http://h{k % 7}.com/{k}") for k in range(400, 1400)]
    labels = [(k, int(k < 400)) for k in range(1400)]
    out = u.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), ()).collect()
    empty = {(r.verdict, round(r.bound, 6)) for r in out if r.host == ""}
    mean = 400.5 / 1401
    assert len(empty) == 1 and next(iter(empty))[0] == "allow" and next(iter(empty))[1] <= mean
    assert {r.verdict for r in out} == {"allow"}
