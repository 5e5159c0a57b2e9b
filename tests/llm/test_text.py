"""Vectorised words and n-grams against plain Python."""

import random
import re

import pyarrow as pa

from trustweave.llm.text import SPACE, chunks, shingles, words


def test_words_and_shingles_do_not_depend_on_chunks():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t漢") for _ in range(rng.randrange(0, 40))) for _ in range(400)] + [None, "", "x", "y" * 300]
    seen = {}
    for limit in (1, 64, 1 << 18):
        found, grams = [], []
        for t in chunks(pa.array(texts), limit):
            w = words(t, SPACE)
            by_row = [[] for _ in range(t.n)]
            for a, b, r in zip(w.start, w.end, w.row):
                by_row[r].append(bytes(t.data[a:b]).decode())
            found += by_row
            s, bounds = shingles(w, t.n, 5)
            grams += [tuple(s[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
        seen[limit] = grams
        assert found == [re.findall("[^\x20\x09-\x0D]+", x or "") for x in texts]
    assert seen[1] == seen[64] == seen[1 << 18]
    for g, x in zip(seen[1], texts):
        w = re.findall("[^\x20\x09-\x0D]+", x or "")
        plain = [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        assert len(g) == len(plain) and len(set(g)) == len(set(plain))
