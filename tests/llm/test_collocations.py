"""Collocations against plain counting, with groups and prefixes forced apart."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from trustweave.llm import collocations as c, queries


def brute(rows, min_count=10, absorb=50, top=2000):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < min_count:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= min_count and p in (q[:2], q[1:]) and 100 * b >= absorb * a for q, b in f.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        for rank, x in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, x[2].decode(), *x[3:6], n[lang], x[6]))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "straße", "日本", "New", "york"]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 80)):
            w += ["New", "York", rng.choice(["City", "state"])] if rng.random() < 0.1 else [rng.choice(vocabulary)]
            w[-1] += rng.choice([""] * 8 + [".", ",", "!", ";x", ":"])
        rows.append((rng.choice(["en", "de", None, "", "und"]), rng.choice([" ", "\t ", "\n"]).join(w)))
    return [*rows, ("en", None), ("en", ""), ("fr", " . , "), (None, None), ("en", "a b c " * 40), rows[0]]


def spark_rows(df):
    return sorted(tuple(r[k] for k in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("budget", [c.BUDGET, 40])
def test_phrases_match_plain_counting(spark, monkeypatch, budget):
    rows = corpus(1)
    if budget == 40:  # every step of partitioning and merging at work
        for k, v in (("FLUSH", 100), ("MERGE", 50), ("PAIR_SHARE", 64)):
            monkeypatch.setattr(c, k, v)
    df = spark.createDataFrame([(k, t, x, 1) for k, (x, t) in enumerate(rows)], "f long, text string, lang string, phrase int").repartition(3)
    assert spark_rows(c.collocations(df, budget=budget)) == brute(rows)
    assert spark_rows(c.collocations(df, budget=budget, min_count=3, absorb=80, top=7)) == brute(rows, 3, 80, 7)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert c.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert c.collocations(empty).count() == 0


def test_groups_stay_within_the_budget_and_extend_hot_prefixes():
    rng = np.random.default_rng(2)
    load = rng.integers(0, 40, c.BINS)
    load[7], load[8] = 5000, 1001
    groups = c.pack_groups(load, np.zeros(0, np.uint64), 1000)
    held = Counter()
    for cell in range(c.BINS):
        for part in range(int(groups.parts[cell])):
            held[int(groups.base[cell]) + part] += load[cell] / groups.parts[cell]
    assert max(held.values()) <= 1000 and groups.parts[7] == 5 and groups.parts[8] == 2
    assert len(held) <= 3 * load.sum() / 1000
    h = rng.integers(1, 1 << 63, (3, 1000)).astype(np.uint64)
    h[:2] = h[:2, :1]
    wide = c.pack_groups(load, c._pair(h[0, :1], h[1, :1]), 1000).of(*h)
    assert (wide < 0).all() and len(set(wide.tolist())) == c.PAIR_PARTS


def test_tries_keep_every_suffix():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(0, 4, (3, 500)), np.ones((1, 500), np.int64)]).astype(np.uint64)
    merged, _ = c._merged(rows)
    back = c._unpack(c._pack(*merged))
    assert (back == merged).all()
    want = Counter(map(tuple, rows[:3].T.tolist()))
    assert {tuple(x[:3]): x[3] for x in back.T.tolist()} == want


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**12 + 9, 3 * 10**12 + 1), (10**9 + 7, 10**9 + 7, 10**9 + 7), (10, 10, 10), (999_999_937, 1_000_000_007, 1_000_000_009)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", c._score("a", "l", "r").alias("s")).collect()
    assert all(x.s == 1_000_000 * x.a * x.a // (x.l * x.r) for x in got)


def test_registered_query(spark, tmp_path):
    rows = corpus(4, 30)
    spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert spark_rows(queries.op13_phrase_collocations(spark, str(tmp_path))) == brute(rows)
