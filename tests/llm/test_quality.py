"""Base statistics against plain Python; the ratio's verdicts; defined cases."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trustweave.llm import quality as q
from trustweave.llm.text import chunks


def brute(x):
    x = x or ""
    w = re.findall("[^\x20\x09-\x0D]+", x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k:k + 3]), []).append(k)
    covered = {k + i for v in windows.values() if len(v) > 1 for k in v for i in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)]


def test_base_statistics():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n\t漢#$") for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + [None, "", "\n\n", "a b c " * 9000]
    for limit in (50, 1 << 18):
        got = np.concatenate([q.base_statistics(t)[1] for t in chunks(pa.array(texts), limit)])
        assert got.tolist() == [brute(x) for x in texts]


def test_noise_goes_and_prose_stays(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    prose = [" ".join(rng.choices(words, k=80)).capitalize() + "." for _ in range(300)]
    noise = [" ".join(w + rng.choice(["%%%", "###", "***"]) for w in rng.choices(words, k=80)) for _ in range(60)]
    rows = [(i, t, i < 120) for i, t in enumerate(prose + noise)] + [(9001, None, False), (9002, "", True), (9003, "short text", False), (None, prose[0], None), (0, prose[0], True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean").withColumn("kept", F.lit(1))
    ratio = q.fit_ratio(df, F.col("good"))
    out = q.judge(df, ratio).collect()
    assert len(out) == len(rows)
    for r in out:
        expected = r.doc_id is None or r.doc_id < 300
        assert r.kept == expected, (r.doc_id, r.score)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    none = q.judge(df, q.fit_ratio(df, F.lit(None)))
    assert none.where("score <> 0").count() == 0
    assert q.judge(df.limit(0), ratio).count() == 0 and not q.fit_ratio(df.limit(0), F.col("good")).any()
