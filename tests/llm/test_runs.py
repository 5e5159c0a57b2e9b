"""Runs and collapsed texts against every start and period by brute force."""

import hashlib
import random
import zlib

import numpy as np

from trustweave.llm import periodic_runs, queries


def brute(w, least=6, exponent=4):
    out = []
    n = len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            part = w[i:i + length]
            if length >= max(least, exponent * q) and not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def collapse(w, runs):
    return " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs))


def samples():
    rng = random.Random(3)
    out = ["", "a", "a b", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", " \n\t", "x\x0bx x\x0cx\rx x é é"]
    for _ in range(150):
        letters = [f"w{k}" for k in range(rng.choice((2, 3, 5, 40)))]
        w = []
        while len(w) < rng.randrange(1, 150):
            base = rng.choices(letters, k=rng.randrange(1, 12))
            w += base * rng.choice((1, 1, 2, 3, 4, 5, 9)) + base[:rng.randrange(len(base))]
        out.append(rng.choice((" ", "  ", "\n")).join(w))
    nested = ("a " * 7 + "b ") * 6 + "c "
    return [*out, nested * 5, "a " * 500, "a b a b a " * 60]


def test_runs_and_texts_match_brute_force(spark):
    texts = samples()
    rows = [(k, t, "kept", 1.5) for k, t in enumerate(texts)] + [(900, None, None, None), (None, texts[20], "x", 2.0), (3, texts[3], "again", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, period double").repartition(3)
    out = periodic_runs.find_runs(df).collect()
    assert len(out) == len(rows)
    for r in out:
        w = (r.text or "").encode().split()
        w = [x.decode() for x in w]
        runs = brute(w)
        assert [tuple(x) for x in r.runs] == runs
        assert r.collapsed == collapse(w, runs) and r.n_words == len(w)
    assert {r["a.b"] for r in out} == {"kept", None, "x", "again"}
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    assert periodic_runs.find_runs(df.withColumn("Runs", df.doc_id)).columns == ["doc_id", "text", "a.b", "period", "n_words", "runs", "collapsed"]


def test_longer_runs_than_four_periods(spark):
    texts = samples()
    out = periodic_runs.find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=3, exponent=5).collect()
    for r in out:
        assert [tuple(x) for x in r.runs] == brute([x.decode() for x in r.text.encode().split()], 3, 5)


def test_one_repeated_word_stays_near_linear():
    n = 1 << 17
    values, row = np.full(n, 7, np.uint64), np.zeros(n, np.int64)
    assert periodic_runs.runs_of(values, row, np.array([0, n]), 6, 4) == [(0, n, 1)]
    block = np.random.default_rng(1).integers(0, 1 << 60, 900).astype(np.uint64)
    values = np.tile(block, 200)
    assert periodic_runs.runs_of(values, np.zeros(len(values), np.int64), np.array([0, len(values)]), 6, 4) == [(0, 180_000, 900)]


def test_registered_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(["a", "b", "ccc", "é"], k=rng.randrange(0, 60)))) for k in range(300)] + [(301, None), (302, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    planted = 0
    for i, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs, r = brute(w), out[i]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()
    assert planted > 10
