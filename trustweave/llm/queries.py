"""Registered queries of the operators: each reads whole tables and returns its full result."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from trustweave.llm import chosen_path, collocations, decontamination, html_text, language_id, ngram_join, periodic_runs, quality, secrets, sentencepiece_codec, token_count, url_reputation, warc
from trustweave.llm.staging import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The public model file that the registered queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, a digest of the base spans, and all spans."""
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


def _sql_matches(pattern: str, kind: int, rank: int, where: str = "true") -> str:
    """All matches of a pattern with their places: a split and its matches alternate."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, {rank} AS rank, start, start + length(m) AS "end" FROM (
  SELECT doc_id, i, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM documents))) WHERE {where}"""


def _sql_secret_scans() -> str:
    value = "length(regexp_extract(m, '" + secrets.ASSIGN.replace("'", "''") + "', 2))"
    parts = "\nUNION ALL ".join([
        _sql_matches(secrets.ASSIGN, 0, 0, f"{value} >= 12"), _sql_matches(secrets.ACCESS, 1, 0, "length(m) >= 18"), _sql_matches(secrets.HEX, 2, 0, "length(m) >= 16"),
        _sql_matches(secrets.ASSIGN, 3, 1, f"{value} < 12"), _sql_matches(secrets.NAMED, 3, 1), _sql_matches(secrets.IDENT, 4, 1), _sql_matches(secrets.ENDPOINT, 5, 1),
        _sql_matches(secrets.BARE, 3, 2, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
    ])
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(secrets.KINDS)) + " END"
    text = f"string_agg({name}||':'||start||':'||\"end\", ',' ORDER BY start, kind, \"end\")"
    return f"""WITH raw AS ({parts}),
breaks AS ({_sql_matches(secrets.BREAK, 9, 3)}),
placed AS (SELECT r.*, (SELECT count(*) FROM breaks b WHERE b.doc_id = r.doc_id AND b.start <= r.start) AS scope FROM raw r),
parts AS (SELECT * FROM placed p WHERE rank = 0 OR NOT EXISTS (
  SELECT 1 FROM placed o WHERE o.doc_id = p.doc_id AND o.rank < p.rank AND o.start < p."end" AND p.start < o."end")),
linked AS (SELECT DISTINCT p.doc_id, p.kind, p.start, p."end" FROM parts p JOIN parts o ON o.doc_id = p.doc_id AND o.scope = p.scope
  AND abs(o.start - p.start) <= 256 AND (o.kind IN (0, 2, 3)) <> (p.kind IN (0, 2, 3)) WHERE p.rank > 0),
base AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, {text} AS spans FROM parts WHERE rank = 0 GROUP BY doc_id),
every AS (SELECT doc_id, {text} AS spans FROM (SELECT doc_id, kind, start, "end" FROM parts WHERE rank = 0 UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans
FROM documents LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


#: The rules of the registered query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by number: page and document ids count from the same zero, so the label of
    a number is the page's outcome; poor or toxic is bad."""
    labels = _table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by rule, or by its host's reputation."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_reputation.judge_urls(pages, page_outcomes(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL_URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
raw AS (
  SELECT host, coalesce(sum(bad), 0)::DOUBLE AS x, count(bad)::DOUBLE AS n,
    regexp_extract(host, '[^.]+\.[^.]+\z') AS domain, regexp_extract(host, '[^.]*\z') AS suffix
  FROM parts LEFT JOIN (
    SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END AS bad FROM labels
  ) l ON l.doc_id = parts.page_id GROUP BY host),
sums AS (
  SELECT host, CASE WHEN host = '' THEN 0.0 ELSE x END AS x, CASE WHEN host = '' THEN 0.0 ELSE n END AS n,
    CASE WHEN host = '' THEN '/' ELSE domain END AS domain, CASE WHEN host = '' THEN '/' ELSE suffix END AS suffix FROM raw),
s0 AS (
  SELECT suffix, sum(x) AS x, sum(n) AS n, (SELECT (sum(x) + 0.5) / (sum(n) + 1.0) FROM raw) AS m FROM sums GROUP BY suffix),
k0 AS (
  SELECT CASE WHEN coalesce(d, 0) = 0 OR s <= e THEN 1000.0 ELSE least(greatest(d / (s - e) - 1, 1.0), 1000.0) END AS k FROM (
    SELECT sum(n * pow(x / n - m, 2)) AS s, sum(m * (1 - m)) AS e, sum(m * (1 - m) * (n - 1)) AS d FROM s0 WHERE n > 0)),
d0 AS (
  SELECT sums.suffix, domain, sum(sums.x) AS x, sum(sums.n) AS n, any_value((s0.m * k + s0.x) / (k + s0.n)) AS m
  FROM sums JOIN s0 USING (suffix), k0 GROUP BY sums.suffix, domain),
k1 AS (
  SELECT CASE WHEN coalesce(d, 0) = 0 OR s <= e THEN 1000.0 ELSE least(greatest(d / (s - e) - 1, 1.0), 1000.0) END AS k FROM (
    SELECT sum(n * pow(x / n - m, 2)) AS s, sum(m * (1 - m)) AS e, sum(m * (1 - m) * (n - 1)) AS d FROM d0 WHERE n > 0)),
h0 AS (
  SELECT host, sums.x, sums.n, (d0.m * k + d0.x) / (k + d0.n) AS m
  FROM sums JOIN d0 ON sums.suffix = d0.suffix AND sums.domain = d0.domain, k1),
k2 AS (
  SELECT CASE WHEN coalesce(d, 0) = 0 OR s <= e THEN 1000.0 ELSE least(greatest(d / (s - e) - 1, 1.0), 1000.0) END AS k FROM (
    SELECT sum(n * pow(x / n - m, 2)) AS s, sum(m * (1 - m)) AS e, sum(m * (1 - m) * (n - 1)) AS d FROM h0 WHERE n > 0)),
judged AS (
  SELECT host, r - 1.645 * sqrt(r * (1 - r) / (k + n + 1)) AS bound FROM (SELECT host, n, k, (m * k + x) / (k + n) AS r FROM h0, k2)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN judged USING (host)
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learned where the id's fold isn't 1."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.fold(F.col("doc_id")) != 1))
    out = language_id.predict(docs.select("doc_id", "text"), model, columns=["doc_id"])
    held = F.coalesce(language_id.fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark: a row per document and item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_passages(docs, _table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", F.inline("hits"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group, its class of equal sets and its number of links."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_documents(docs).select("doc_id", "class_id", "copy_id", "n_links")


#: Ids (8 bytes each) that may be broadcast to the documents; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and log-likelihood ratio of every document; trusted are those labelled
    good and not toxic."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    ratio = quality.fit_ratio(docs.join(good, "doc_id", "left"), F.col("trusted"))
    out = quality.judge(docs, ratio, columns=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, piece_model(), columns=["doc_id"], limit=4096)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_texts(docs, piece_model(), columns=["doc_id"], verify=True)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), columns=["page_id", "url"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back; digests are those of the records read."""
    path = new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc.read_records(spark, path)
    own = F.col("kind") == "response"
    records = records.withColumns({  # before they are assembled, so that payloads stay out of the shuffle
        "short": F.when(F.col("kind") == "metadata", F.col("payload")).when(F.col("kind") == "request", F.col("http_head")),
        "payload_bytes": F.when(own, F.octet_length("payload")).otherwise(F.regexp_extract("http_head", r"Content-Length: ([0-9]+)", 1).try_cast("long")).cast("long"),
        "digest": F.when(own, warc.base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")),
        "refers_to": F.col("refers_to_page").cast("long"),
    })
    kept = ["kind", "payload_bytes", "digest", "refers_to", "damaged", "short"]
    captures = warc.assemble(records, kept)
    return captures.select(
        F.regexp_extract("metadata.short", r"page-id: (-?[0-9]+)", 1).try_cast("long").alias("page_id"),
        "response.payload_bytes", F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), "response.refers_to", "response.damaged",
        F.regexp_extract("request.short", r"(?s)\AGET (.*) HTTP/1\.1", 1).alias("request_target"),
    )


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and its group of near duplicates."""
    return chosen_path.link_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL_NEAR_DEDUP = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1]) END) AS gs FROM w WHERE len(ws) > 0),
c AS (SELECT min(doc_id) AS c_id, list_sort(gs) AS gs, len(gs) AS n FROM g GROUP BY ALL),
e AS (SELECT c_id, n, hash(unnest(gs)) AS gram FROM c),
pairs AS (SELECT a.c_id AS a, b.c_id AS b, a.n AS x, b.n AS y, count(*) AS common FROM e a JOIN e b ON a.gram = b.gram AND a.c_id < b.c_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (x + y - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(c_id, root) AS (SELECT c_id, c_id FROM c UNION SELECT l.b, r.root FROM reach r JOIN edges l ON l.a = r.c_id),
groups AS (SELECT c_id, min(root) AS root FROM reach GROUP BY c_id),
of AS (SELECT g.doc_id, c.n, groups.root FROM g JOIN c ON c.gs = list_sort(g.gs) JOIN groups USING (c_id))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT JOIN of USING (doc_id)"""


def repeated_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The registered query's word order: of ids whose checksum ends in 0, the words from a
    place on repeat its first few."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and n else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return index


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document: the longest, and digests of all runs and of the collapsed text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(docs, columns=["doc_id"], order_key="doc_id", order=repeated_order)
    # the greatest length, then the smallest start and period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest phrases of two or three words, over all documents."""
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


SQL_COLLOCATIONS = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
s AS (SELECT lang, ws[i] AS w1, ws[i+1] AS w2, ws[i+2] AS w3 FROM spots),
f1 AS (SELECT lang, w1, count(*) AS f FROM s GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
held AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
pairs AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * f2.f * f2.f // (x.f::HUGEINT * y.f) AS score
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  LEFT JOIN held ON held.lang = f2.lang AND held.w1 = f2.w1 AND held.w2 = f2.w2 WHERE most IS NULL OR 100 * most < 50 * f2.f),
cuts AS (
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, x1.f AS l1, y2.f AS r1, x2.f AS l2, y1.f AS r2,
    1000000::HUGEINT * f3.f * f3.f // (x1.f::HUGEINT * y2.f) AS s1, 1000000::HUGEINT * f3.f * f3.f // (x2.f::HUGEINT * y1.f) AS s2
  FROM f3 JOIN f1 x1 ON x1.lang = f3.lang AND x1.w1 = f3.w1 JOIN f2 x2 ON x2.lang = f3.lang AND x2.w1 = f3.w1 AND x2.w2 = f3.w2
  JOIN f2 y2 ON y2.lang = f3.lang AND y2.w1 = f3.w2 AND y2.w2 = f3.w3 JOIN f1 y1 ON y1.lang = f3.lang AND y1.w1 = f3.w3),
found AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


SQL_NGRAM_JOIN = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4]) END)) AS gs FROM w WHERE len(ws) > 0),
e AS (SELECT doc_id, unnest(gs) AS gram FROM g),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE c >= 0.8 * (len(x.gs) + len(y.gs) - c) - 1e-9),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id),
classes AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(gs, chr(10)))) AS copy_id FROM g),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN copies USING (doc_id) LEFT JOIN counts USING (doc_id)"""


SQL_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, coalesce(regexp_extract(url, '(?s)://[^/?#]*([^#]*)', 1), '') AS place FROM pages),
d AS (SELECT page_id, place, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, false AS damaged,
  CASE WHEN place = '' THEN '/' ELSE place END AS request_target FROM d"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_url_filters": op2_url_filters,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op9_html_extraction": op9_html_extraction,
    "op10_warc": op10_warc,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_collocations": op13_phrase_collocations,
}

SQL: dict[str, str] = {
    "op1_secret_scans": _sql_secret_scans(),
    "op2_url_filters": SQL_URL_FILTERS,
    "op5_ngram_join": SQL_NGRAM_JOIN,
    "op10_warc": SQL_WARC,
    "op11_minhash_near_dedup": SQL_NEAR_DEDUP,
    "op13_phrase_collocations": SQL_COLLOCATIONS,
}
