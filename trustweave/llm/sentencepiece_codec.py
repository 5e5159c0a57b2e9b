"""SentencePiece encoding by an Aho-Corasick automaton in a single pass, and decoding.

One automaton over all pieces reads a unit once; at each position its output links give
every piece that ends there. A model's type says which of them is the last one:

* unigram (``Codec``): each relaxes the best score of that position (Viterbi). A character
  that no one-letter piece covers costs ``unk_penalty`` below the lowest score. Among equal
  scores the longer last piece wins.
* BPE (``MergeCodec``): scores are merge ranks, so sums of them mean nothing. A text's pieces
  are the merges' result exactly if each two neighbours are, so the last piece is the only
  one that forms a valid border with the piece before it; borders are checked by undoing
  the merges of both sides, latest first, and kept.

A character without a piece is written as byte pieces.

Units (see ``units.py``) are encoded one by one, so a worker cache serves repeated ones;
the encoding of a text is that of its units in a row.

Defined cases: a null text gives a null list, an empty text an empty list. Decoding gives
back the text, where the model's space mark reads as a space. Ids outside the vocabulary
raise; null ids are skipped. Rows are kept as they come, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from trustweave.llm.batches import name, with_text_columns
from trustweave.llm.units import BYTE, CONTROL, MARK, UNKNOWN, check_units, load_model, split_units

#: Entries of a worker's cache (about 60 MB); beyond, it starts anew.
CACHE_SIZE = 1 << 18
CACHED_CHARS = 64
UNK_PENALTY = 10.0


@lru_cache(maxsize=2)
def worker_codec(path: str) -> Codec:
    """One codec of the model's type for each Python worker, kept from task to task."""
    kind = load_model(path).trainer_spec.model_type
    if kind not in CODECS:
        raise ValueError(f"model type {kind}: only unigram and BPE models are coded")
    return CODECS[kind](path)


class Codec:
    def __init__(self, path: str):
        model = load_model(path)
        check_units(model)
        self.automaton = ahocorasick.Automaton()
        self.byte_ids: dict[int, int] = {}
        self.letters: set[str] = set()
        plain: list[bytes] = []
        lowest = 0.0
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                plain.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (UNKNOWN, CONTROL):
                plain.append(b"")
            else:
                self.automaton.add_word(p.piece, (i, len(p.piece), p.score))
                lowest = min(lowest, p.score)
                if len(p.piece) == 1:
                    self.letters.add(p.piece)
                plain.append(p.piece.replace(MARK, " ").encode())
        self.automaton.make_automaton()
        self.unk_score = lowest - UNK_PENALTY
        self.lengths = np.array([len(x) for x in plain], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.cache: dict[str, bytes] = {}

    def best_path(self, unit: str) -> list[int]:
        """Ids of the best segmentation of one unit, spaces written as marks."""
        n = len(unit)
        best, via = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
        done = n if self.letters.issuperset(unit) else 0  # characters that have had their unknown edge
        for last, edge in self.automaton.iter(unit):
            while done < last:
                done += 1
                self._unknown(unit, done, best, via)
            value = best[last + 1 - edge[1]] + edge[2]
            if value > best[last + 1]:
                best[last + 1], via[last + 1] = value, edge
        while done < n:
            done += 1
            self._unknown(unit, done, best, via)
        ids: list[int] = []
        at = n
        while at:
            piece, size = via[at][:2]
            if piece < 0:
                ids += [self.byte_ids[b] for b in reversed(unit[at - 1].encode())]
            else:
                ids.append(piece)
            at -= size
        return ids[::-1]

    def _unknown(self, unit: str, end: int, best: list[float], via: list[tuple]) -> None:
        """Relax the edge of a character without a piece of its own."""
        if unit[end - 1] not in self.letters and best[end - 1] + self.unk_score > best[end]:
            best[end], via[end] = best[end - 1] + self.unk_score, (-1, 1)

    def encode_unit(self, unit: str) -> bytes:
        out = np.array(self.best_path(unit.replace(" ", MARK)), np.int32).tobytes()
        if len(unit) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_SIZE:
                self.cache = {}
            self.cache[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        """The text's ids as 32-bit integers in a row."""
        units = split_units(text)
        found = list(map(self.cache.get, units))
        if None in found:
            found = [self.encode_unit(u) if x is None else x for u, x in zip(units, found)]
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' text, the dummy prefix removed."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id outside the vocabulary")
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        at = np.arange(total) + np.repeat(self.offsets[ids] - (ends - size), size)
        return self.bytes[at].tobytes()[1:] if total and self.bytes[at[0]] == 0x20 else self.bytes[at].tobytes()


class MergeCodec(Codec):
    """The encoding of a BPE model."""

    def __init__(self, path: str):
        super().__init__(path)
        pieces = {piece: edge for piece, edge in self.automaton.items()}
        self.ids = {piece: edge[0] for piece, edge in pieces.items()}
        place = {score: k for k, score in enumerate(sorted({edge[2] for edge in pieces.values()}, reverse=True))}
        self.rank: dict[str, int] = {}  # of pieces that merges can make, lower is earlier
        self.halves: dict[str, tuple[str, str]] = {}  # what the last merge of a piece joins
        self.borders: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in sorted(pieces, key=lambda x: (place[pieces[x][2]], len(x))):
            if len(piece) > 1:
                halves = ((piece[:k], piece[k:]) for k in range(len(piece) - 1, 0, -1))
                made = next((h for h in halves if all(len(x) == 1 or x in self.rank for x in h) and self.is_border(*h)), None)
                if made is None:
                    raise ValueError(f"the piece {piece!r} is not made by earlier merges")
                self.rank[piece], self.halves[piece] = place[pieces[piece][2]], made
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def is_border(self, left: str, right: str) -> bool:
        """Whether no merge crosses from one piece into the next before both are made."""
        rank = self.rank
        limit = len(self.ids)
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # undo the later merge; of equal ones the left one is made first
            if a > b:
                limit, left = a, self.halves[left][1]
            else:
                limit, right = b + 1, self.halves[right][0]

    def best_path(self, unit: str) -> list[int]:
        """Ids of the merges' result for one unit, spaces written as marks."""
        n = len(unit)
        last = [""] * (n + 1)  # the last piece of the text up to each place
        borders = self.borders
        done = n if self.letters.issuperset(unit) else 0
        for end, piece in self.automaton.iter(unit):
            end += 1
            while done < end - 1:  # a character without a piece stands alone
                done += 1
                last[done] = last[done] or unit[done - 1]
            if last[end]:
                continue
            before = last[end - len(piece)]
            if before:
                valid = borders.get((before, piece))
                if valid is None:
                    if len(borders) >= CACHE_SIZE:
                        borders.clear()
                    valid = borders[before, piece] = self.is_border(before, piece)
                if not valid:
                    continue
            last[end] = piece
        while done < n:
            done += 1
            last[done] = last[done] or unit[done - 1]
        ids: list[int] = []
        at = n
        while at:
            piece = last[at]
            if piece in self.ids:
                ids.append(self.ids[piece])
            else:
                ids += [self.byte_ids[b] for b in reversed(piece.encode())]
            at -= len(piece)
        return ids[::-1]


#: By the format's model types.
CODECS = {1: Codec, 2: MergeCodec}


def _plain(text: str) -> bytes:
    return text.replace(MARK, " ").encode()


def encode_texts(
    docs: DataFrame, model_path: str, *, text: str = "text", ids: str = "ids", columns: Sequence[str] | None = None, verify: bool = False,
) -> DataFrame:
    """Append ``ids`` (array of int) and ``n_tokens`` to ``columns`` (default: all); with
    ``verify`` also ``round_trip``, true if decoding gives the text back."""

    def make():
        codec = worker_codec(model_path)

        def compute(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            coded = [codec.encode(x) if x else b"" for x in texts]
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, pa.py_buffer(b"".join(coded))])
            out = [pa.ListArray.from_arrays(pa.array(bounds), values, mask=column.is_null()), pa.array(sizes)]
            if verify:
                out.append(pa.array([x is None or codec.decode(np.frombuffer(c, np.int32)) == _plain(x) for x, c in zip(texts, coded)]))
            return out

        return compute

    ddl = f"`{ids}` array<int>, n_tokens long" + ", round_trip boolean" * verify
    return with_text_columns(docs, make, ddl, text=text, columns=columns)


def decode_ids(rows: DataFrame, model_path: str, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """Append ``text``, decoded from ``ids``; null lists give null. Bytes that are no UTF-8
    (only if the ids come from elsewhere) read as replacement characters."""
    kept = [c for c in rows.columns if c.lower() != text.lower()]
    place = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model_path)
        for batch in batches:
            texts = [
                None if x is None else codec.decode(np.array([i for i in x if i is not None], np.int64)).decode(errors="replace")
                for x in batch.column(place).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, text])

    taken = rows.select(*[name(c) for c in kept])
    return taken.mapInArrow(run, T.StructType([*taken.schema.fields]).add(text, "string"))
