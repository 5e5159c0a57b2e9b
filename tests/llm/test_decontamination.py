"""Edit distances against brute force, measured recall, and defined cases."""

import random

import pyarrow as pa

from trustweave.llm import decontamination as d


def brute(item, text):
    previous = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        row = [i + 1]
        for j, y in enumerate(text):
            row.append(min(previous[j] + (x != y), previous[j + 1] + 1, row[-1] + 1))
        previous = row
    return min(previous), previous.index(min(previous))


def test_exact_distance():
    rng = random.Random(3)
    for _ in range(1500):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 90))]
        assert d.edit_ends(d._places(item), len(item), text) == brute(item, text)


def edited(rng, words, vocabulary, n):
    words = list(words)
    for _ in range(n):
        k, kind = rng.randrange(len(words)), rng.randrange(3)
        words[k:k + (kind != 1)] = [] if kind == 2 else [rng.choice(vocabulary)]
    return words


def test_recall_at_the_largest_distance_and_no_false_hits():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 60
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)))) for k in range(150)]
    index = d.Index(items, 0.8, 6, 8)
    found = total = 0
    for number, text in items:
        for _ in range(3):
            words = text.split()
            passage = edited(rng, words, vocabulary, int(0.2 * len(words) + 1e-9))
            doc = " ".join(rng.choices(vocabulary, k=40) + passage + rng.choices(vocabulary, k=40))
            hits = index.hits(pa.array([doc]))[0]
            total += 1
            found += any(h["item_id"] == number for h in hits)
            for h in hits:  # every hit holds
                own = dict(items)[h["item_id"]].split()
                assert brute(own, doc.split()[h["start_word"]:h["end_word"]])[0] == h["distance"] <= 0.2 * len(own)
    assert found / total >= 0.97
    clean = [" ".join(rng.choices(vocabulary, k=300)) for _ in range(100)]
    assert not any(index.hits(pa.array(clean)))


def test_defined_cases(spark):
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage), (2, passage.upper()), (3, "too short"), (4, None), (5, ""), (None, passage + " eleven")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"a b {passage}! c", 0), (1, f"a b {passage}! c", 0), (2, "ONE, two-three|four five\nsix SEVEN%% eight nine ten", 0), (3, None, 0), (4, "", 0), (None, "x " * 60000 + passage, 0), (6, "one two three", 0)],
        "doc_id long, text string, hits int",
    )
    out = d.find_passages(docs, bench).collect()
    assert len(out) == 7
    ids = {(r.doc_id, len(r.text or "")): {h.item_id for h in r.hits} for r in out}
    assert all(got == ({1, 2, None} if key[0] in (1, 2, None) else set()) for key, got in ids.items())
    long = next(h for r in out if r.doc_id is None for h in r.hits if h.item_id == 1)
    assert (long.start_word, long.end_word, long.distance) == (60000, 60010, 0)
    assert d.find_passages(docs.limit(0), bench).count() == 0
    assert {len(r.hits) for r in d.find_passages(docs, bench.limit(0)).collect()} == {0}


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(50)]
    items = [(k, " ".join(rng.choices(vocabulary, k=12))) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(rng.choices(vocabulary, k=20)) + " " + items[k][1]) for k in range(30)], "doc_id long, text string")
    whole = {(r.doc_id, h.item_id) for r in d.find_passages(docs, bench).collect() for h in r.hits}
    monkeypatch.setattr(d, "BLOCK_WORDS", 100)
    parts = {(r.doc_id, h.item_id) for r in d.find_passages(docs, bench).collect() for h in r.hits}
    assert whole == parts and {(k, k) for k in range(30)} <= whole


def test_trimmed_passages_as_whole_documents_between_others():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([20, 25, 30, 40, 60] * 6)]
    index = d.Index(items, 0.8, 6, 8)
    other = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))
    for number, text in items:
        words = text.split()
        for head in range(0, len(words) // 5 + 1):
            whole = words[head:len(words) - (len(words) // 5 - head)]
            alone = index.hits(pa.array([" ".join(whole)]))[0]
            rows = index.hits(pa.array([other(), " ".join(whole), other()]))
            assert [h["item_id"] for h in alone] == [number]
            assert rows == [[], alone, []]
            assert (alone[0]["start_word"], alone[0]["end_word"], alone[0]["distance"]) == (0, len(whole), len(words) - len(whole))


def test_short_items_are_found_verbatim():
    """Every length below the walks' one, at every place, and no longer or shorter match."""
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7] * 5)]
    index = d.Index(items, 0.8, 6, 8)
    docs = [rng.choices(vocabulary, k=rng.randrange(0, 30)) + (x.split() if rng.random() < 0.7 else []) + rng.choices(vocabulary, k=rng.randrange(0, 30)) for _, x in items for _ in range(8)]
    out = index.hits(pa.array([" ".join(w) for w in docs]))
    found = 0
    for w, hits in zip(docs, out):
        want = {}
        for number, text in items:
            own = text.split()
            places = [k for k in range(len(w) - len(own) + 1) if w[k:k + len(own)] == own]
            if len(own) >= 3 and places:
                want[number] = places[0]
        assert {h["item_id"]: h["start_word"] for h in hits} == want
        assert all(h["end_word"] - h["start_word"] == h["n_words"] and h["distance"] == 0 for h in hits)
        found += len(want)
    assert found > 100
    assert not any(h["n_words"] < 3 for hits in out for h in hits)


def test_scripts_without_spaces_are_words_by_character():
    rng = random.Random(14)
    letters = [chr(k) for k in range(0x4E00, 0x4E00 + 900)] + [chr(k) for k in range(0x3042, 0x3094)]
    items = [(k, "".join(rng.choices(letters, k=rng.randrange(10, 50)))) for k in range(60)]
    index = d.Index(items, 0.8, 6, 8)
    found = 0
    for number, text in items:
        passage = edited(rng, text, letters, int(0.2 * len(text) + 1e-9))
        doc = "".join(rng.choices(letters, k=80)) + "。" + "".join(passage) + "".join(rng.choices(letters, k=80))
        found += any(h["item_id"] == number for h in index.hits(pa.array([doc]))[0])
    assert found / len(items) >= 0.9
    assert not any(index.hits(pa.array(["".join(rng.choices(letters, k=300)) for _ in range(50)])))
