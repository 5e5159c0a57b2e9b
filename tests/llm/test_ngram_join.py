"""Links, groups and removal against all pairs by brute force."""

import random
import re
from collections import Counter

import pytest

from trustweave.llm import ngram_join as j
from trustweave.llm.components import components


def grams(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(links, group) of each row by its place."""
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return links, group


def corpus(seed, n, copies):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = " ".join(rng.choices(words, k=120))
    rows = []
    for _ in range(n):
        rows.append(" ".join(rng.choices(words, k=rng.randrange(3, 150))))
    for _ in range(copies):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), "", None, "a b", "A  b\n", "\n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def compare(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in j.link_documents(df).collect()}
    links, group = brute(rows)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    assert len(out) == len(rows)
    wrong = [i for k, (i, _) in enumerate(rows) if out[i].n_links != links[k] or out[i].class_id != least[group[k]]]
    return wrong


def test_links_and_groups(spark):
    assert compare(spark, corpus(1, 60, 25)) == []


def test_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "CHUNK_CLASSES", 8)
    assert compare(spark, corpus(2, 10, 90)) == []
    monkeypatch.setattr(j, "CHUNK_SET_BYTES", 4000)
    assert compare(spark, corpus(3, 10, 40)) == []


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.998), (0.5, 0.9), (0.95, 0.99)):
        bands, rows = j.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= j.HASH_BUDGET
    with pytest.raises(ValueError):
        j.choose_bands(0.01, 0.9999)


def test_keep_one_per_group(spark):
    rows = corpus(4, 20, 12)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, id string, class_id long")
    kept = {r.doc_id for r in j.keep_one(df).collect()}
    _, group = brute(rows)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    assert kept == set(least.values())
    # repeated and missing ids: one row of each group's text
    text = " ".join(f"v{k}" for k in range(50))
    odd = [(1, text), (1, text), (2, text), (None, text), (7, "other words entirely here now"), (7, "a second text of that id"), (None, "alone without any id here"), (None, None), (8, "")]
    got = sorted(((r.doc_id, r.text) for r in j.keep_one(spark.createDataFrame(odd, "doc_id long, text string")).collect()), key=str)
    assert got.count((1, text)) == 1 and (2, text) not in got
    assert (7, "other words entirely here now") in got and (7, "a second text of that id") in got
    assert (None, None) in got and (8, "") in got and (None, "alone without any id here") in got and (None, text) not in got
    assert j.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in label.items() if x != r}
