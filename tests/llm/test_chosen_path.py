"""Groups of near duplicates against all pairs by brute force, with nodes and parts made small."""

import random
import re
from collections import Counter

import numpy as np

from trustweave.llm import chosen_path as c, queries
from trustweave.llm.text import constants


def grams(text, width=2):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent=80, width=2):
    """(size, group) of each row by its place."""
    sets = [grams(t, width) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [len(s) for s in sets], group


def corpus(seed, n, copies, edits=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 150))) for _ in range(n)]
    for _ in range(3):
        base = rng.choices(vocabulary, k=rng.randrange(30, 120))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, edits * len(base) // 60 + 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), rows[-1], "", None, "a", "A", "a b", "b a", "É é", "é é", " \n", "a a a a"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def compare(spark, rows, **options):
    """Rows that differ from brute force."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in c.link_documents(df, **options).collect()}
    sizes, group = brute(rows, options.get("percent", 80), options.get("width", 2))
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(i, least.get(g, i))
    assert len(out) == len(rows)
    return [i for k, (i, _) in enumerate(rows) if (out[i].n_shingles, out[i].component_id, out[i].kept) != (sizes[k], least[group[k]], least[group[k]] == i)]


def test_groups_match_brute_force(spark):
    assert compare(spark, corpus(1, 60, 12)) == []


def test_deep_trees_and_large_nodes(spark, monkeypatch):
    """Nodes of four members: every level branches, and near copies stay large to the last."""
    monkeypatch.setattr(c, "NODE", 4)
    monkeypatch.setattr(c, "PART_CLASSES", 6)
    assert compare(spark, corpus(2, 40, 40)) == []


def test_parts_by_bytes_and_other_thresholds(spark, monkeypatch):
    monkeypatch.setattr(c, "PART_BYTES", 3000)
    assert compare(spark, corpus(3, 20, 15, edits=9), percent=60, width=3) == []


def test_later_blocks_hold_every_pair_of_different_labels(spark, monkeypatch):
    monkeypatch.setattr(c, "PART_CLASSES", 5)
    rng = random.Random(4)
    rows = [(g, bytes([g, k]) * 8, rng.choice([1, 1, 1, 2, 3]), 5, b"") for g in (1, 2, 3) for k in range(30)]
    rows += [(4, bytes([4, k]) * 8, 9, 5, b"") for k in range(30)]  # one label
    seen = {}
    for r in c._later_blocks(spark.createDataFrame(rows, c._NODE_ROW)).collect():
        seen.setdefault((r.part_of, r.low, r.high), []).append((bytes(r.digest), r.side))
    met = {frozenset((a, b)) for m in seen.values() for a, x in m for b, y in m if a != b and x & c.LEFT and y & c.RIGHT}
    marks = {bytes(r[1]): (r[0], r[2]) for r in rows}
    assert all(frozenset((a, b)) in met for a in marks for b in marks if marks[a][0] == marks[b][0] and marks[a][1] != marks[b][1])
    assert not any(k[0] == 4 for k in seen)


def test_a_group_in_every_tree_is_compared_once(spark, monkeypatch):
    monkeypatch.setattr(c, "PART_CLASSES", 8)
    node = lambda n, ids: [(n, b"%d" % i, 7 if i < 40 else i, 10, b"s") for i in ids]
    count = lambda rows: c._later_blocks(spark.createDataFrame(rows, c._NODE_ROW)).count()
    one = count(node(1, range(60)))
    assert count([r for n in range(12) for r in node(n, range(60))]) == one
    # parts of one label that share few members stay apart
    apart = [r for n in range(5) for r in node(n, [*range(8 * n, 8 * n + 8), 40 + n])]
    assert count(apart) == sum(count(apart[k:k + 9]) for k in range(0, 45, 9))


def test_trees_reach_the_recall():
    """A pair at the threshold, by independent tokens, shares a node as often as promised."""
    rng = np.random.default_rng(5)
    n, depth = 3000, 5
    one = rng.integers(0, 1 << 16, (n, c.COORDINATES)).astype(np.uint16)
    two = np.where(rng.random((n, c.COORDINATES)) < 0.8, one, one + np.uint16(1))
    met = np.zeros(n, bool)
    trees, _ = c.plan_trees(c.NODE * 16 ** 3, 80, 0.98)
    for seed in constants(trees, 77):
        live = [{i: {int(seed)} for i in range(n)} for _ in range(2)]
        for _ in range(depth):
            for k, tokens in enumerate((one, two)):
                pairs = [(i, p) for i, paths in live[k].items() for p in paths]
                if pairs:
                    row, node = c.children(np.array([p for _, p in pairs], np.uint64), tokens[[i for i, _ in pairs]], 80)
                    live[k] = {}
                    for r, x in zip(row.tolist(), node.tolist()):
                        live[k].setdefault(pairs[r][0], set()).add(x)
        met |= np.array([bool(live[0].get(i, set()) & live[1].get(i, set())) for i in range(n)])
    assert met.mean() >= 0.98 - 0.01
    assert abs(c.survival(80, 1) - 0.84) < 1e-9 and c.plan_trees(0, 80, 0.999)[0] >= 2


def test_rows_without_ids_empty_tables_and_clashing_names(spark):
    text = " ".join(f"v{k}" for k in range(50))
    odd = [(1, text, 7), (1, text, 8), (2, text, 9), (None, text, 0), (None, "alone here", 1), (None, None, 2), (8, "", 3)]
    df = spark.createDataFrame(odd, "doc_id long, text string, n_shingles long")
    got = Counter(tuple(r) for r in c.link_documents(df).collect())
    assert got == Counter([(1, 49, 1, True)] * 2 + [(2, 49, 1, False), (None, 49, 1, False), (None, 1, None, True), (None, 0, None, True), (8, 0, 8, True)])
    assert c.link_documents(df.limit(0)).count() == 0


def test_registered_query(spark, tmp_path):
    rows = corpus(6, 30, 8)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op11_minhash_near_dedup(spark, str(tmp_path)).collect()}
    sizes, group = brute(rows)
    assert len({(out[i].component_id, g) for (i, _), g in zip(rows, group)}) == len(set(group)) == sum(r.kept for r in out.values())
    assert [out[i].n_shingles for i, _ in rows] == sizes
