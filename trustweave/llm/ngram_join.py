"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

1. Signatures: words are lower-cased runs of non-space; the n-gram set of a whole text is
   hashed to 64 bits per n-gram, and MinHash values are folded to one hash per band.
   ``choose_bands`` takes the most rows per band whose band count still reaches the target
   recall at the threshold within a hash budget.
2. Classes: documents with equal sets (a 128-bit digest) are one class from here on, so a
   group of copies, however large, is one row after a partial aggregate.
3. Buckets: classes shuffle on (band, hash). Buckets of one class go; so do buckets with
   the members of an earlier band's bucket, which hold no new pair.
4. Verification on full sets: a bucket is cut into chunks of bounded rows and bytes, and
   each pair of chunks is a block of its own, so no task holds a whole large bucket. A
   block counts the links of its members and joins linked members to in-block groups; it
   emits rows per member, never per pair. A pair counts in its first common band only.
5. Groups: connected components over the blocks' groups.

Recall is that of the banding: pairs at the threshold are missed with a probability below
``1 - recall``, closer ones far more rarely. Every reported link is exact.

Defined cases: a text of fewer words than the n-gram's width has one n-gram, all its
words; a text without words, or null, links to nothing and is its own class; repeated rows
are copies; rows without an id take part, and a group's id is the smallest id it has (null
if it has none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trustweave.llm.batches import name, with_text_columns
from trustweave.llm.components import components
from trustweave.llm.staging import staged
from trustweave.llm.text import SPACE, chunks, constants, mix, shingles, words

#: Classes in one chunk of a bucket, and bytes of its n-gram sets.
CHUNK_CLASSES, CHUNK_SET_BYTES = 256, 1 << 25
#: Ids (16 bytes each) of candidate classes that may be broadcast to the documents.
BROADCAST_IDS = 1_000_000
#: MinHash values that a document may have.
HASH_BUDGET = 96


def choose_bands(threshold: float, recall: float, budget: int = HASH_BUDGET) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach ``recall`` at ``threshold``."""
    best = None
    for rows in range(1, budget + 1):
        bands = 1 if threshold >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= budget:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall within the hash budget")
    return best


class Signer:
    """N-gram sets and band hashes of texts."""

    def __init__(self, width: int, bands: int, rows: int):
        self.width, self.bands, self.rows = width, bands, rows
        self.factors, self.folds = constants(bands * rows, 21), constants(rows, 22)

    def sets(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct n-gram hashes of some rows in order, and their bounds."""
        for t in chunks(column):
            hashed, bounds = shingles(words(t, SPACE), t.n, self.width)
            parts = [np.unique(hashed[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield (np.concatenate(parts) if parts else hashed), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    @staticmethod
    def digests(grams: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
        full = np.flatnonzero(np.diff(bounds))
        out: list[bytes | None] = [None] * (len(bounds) - 1)
        if len(full):
            sums = [np.add.reduceat(mix(grams * f), bounds[full]) for f in constants(2, 23)]
            for i, pair in zip(full, np.stack(sums, 1)):
                out[i] = pair.astype(">u8").tobytes()
        return out

    def band_hashes(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows with n-grams) x bands."""
        full = np.flatnonzero(np.diff(bounds))
        out = np.zeros((len(full), self.bands), np.uint64)
        if len(full):
            for k, f in enumerate(self.factors):
                least = np.minimum.reduceat(grams * f, bounds[full])
                out[:, k // self.rows] += least * self.folds[k % self.rows]
        return mix(out)

    def signatures(self, column: pa.Array) -> list[pa.Array]:
        digests: list[bytes | None] = []
        sizes, hashes = [], [np.zeros((0, self.bands), np.uint64)]
        for grams, bounds in self.sets(column):
            digests += self.digests(grams, bounds)
            sizes.append(np.diff(bounds))
            hashes.append(self.band_hashes(grams, bounds))
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.where(size > 0, self.bands, 0))]).astype(np.int32)
        values = pa.array(np.concatenate(hashes).ravel().view(np.int64))
        return [pa.array(digests, pa.binary()), pa.array(size), pa.ListArray.from_arrays(pa.array(ends), values)]

    def blobs(self, column: pa.Array) -> list[pa.Array]:
        digests: list[bytes | None] = []
        blobs: list[bytes] = []
        for grams, bounds in self.sets(column):
            digests += self.digests(grams, bounds)
            blobs += [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return [pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())]


def _linked(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Truth matrix of pairs left x right with a Jaccard similarity of ``threshold`` or more."""
    size = np.array([len(g) for g in grams], np.float64)
    common = np.zeros((len(left), len(right)))
    if len(left) * len(right) <= 64:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if a != b and min(size[a], size[b]) >= threshold * max(size[a], size[b]):
                    common[i, j] = len(np.intersect1d(grams[a], grams[b], assume_unique=True))
    else:
        owner = np.repeat(np.arange(len(grams)), size.astype(np.int64))
        _, column, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        wide = 4096
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            a, b = np.searchsorted(column, [low, low + wide])
            part = np.zeros((len(grams), wide), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part[left] @ part[right].T
    return common >= threshold * (size[left][:, None] + size[right][None] - common) - 1e-9


def _block(band: int, same: bool, members: list[tuple], threshold: float) -> Iterator[tuple]:
    """Rows (class, links, smallest class of its in-block group) of one block."""
    digest, side, copies, bands, blobs = zip(*members)
    grams = [np.frombuffer(b, np.uint64) for b in blobs]
    side = np.array(side)
    left = np.arange(len(grams)) if same else np.flatnonzero(side)
    right = left if same else np.flatnonzero(~side)
    if len(left) == 0 or len(right) == 0 or len(grams) < 2:
        return
    hashes = np.array(bands)
    fresh = left[:, None] != right[None]
    for k in range(band):  # pairs that an earlier band has already counted
        fresh &= hashes[left, k][:, None] != hashes[right, k][None]
    if not fresh.any():
        return
    link = _linked(grams, left, right, threshold) & fresh
    adjacent = np.zeros((len(grams), len(grams)), bool)
    adjacent[np.ix_(left, right)] = link
    adjacent |= adjacent.T
    order = np.argsort(np.array([int.from_bytes(d) for d in digest], object))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    label = rank.copy()
    while True:
        lower = np.minimum(label, np.where(adjacent, label[None], len(label)).min(1))
        lower = np.minimum(lower, lower[order[lower]])  # a label is a member's rank: follow it
        if (lower == label).all():
            break
        label = lower
    links = adjacent @ np.array(copies, np.int64)
    for i in np.flatnonzero(links):
        yield digest[i], int(links[i]), digest[order[label[i]]]


def _verify(threshold: float):
    """Blocks come sorted; a block may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        now, members, out = None, [], []
        for batch in batches:
            for r in (r for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
                block = (r["band"], r["key"], r["low"], r["high"])
                if block != now:
                    if now:
                        out += _block(now[0], now[2] == now[3], members, threshold)
                    now, members = block, []
                members.append((r["digest"], r["chunk"] == r["low"], r["copies"], r["bands"], r["grams"]))
            if len(out) > 10_000:
                yield table(out)
                out = []
        if now:
            out += _block(now[0], now[2] == now[3], members, threshold)
        yield table(out)

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(name(doc_id).alias("doc_id"), F.lower(name(text).cast("string")).alias("text"))


def link_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.998,
) -> DataFrame:
    """One row per document: doc_id, digest (of its set), group (digest that names its linked
    group, told apart even where ids repeat), class_id (the group's smallest id), copy_id (smallest id with its very set), n_links (other documents, copies too,
    with a similarity of ``threshold`` or more)."""
    bands, rows = choose_bands(threshold, recall)
    source = _rows(docs, doc_id, text)
    made = with_text_columns(source, lambda: Signer(width, bands, rows).signatures, "digest binary, n_grams long, bands array<long>", columns=["doc_id"])
    signed = staged(made, "signatures")
    classes = staged(signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"),
    ), "classes")

    # buckets of several classes; of those with the same members the first band's
    spread = classes.select("digest", "n_grams", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("n_grams").alias("size"), F.bit_xor(F.xxhash64("digest")).alias("mark"), F.min("digest").alias("least"), F.max("digest").alias("most"),
    ).where("n > 1")
    buckets = buckets.groupBy("n", "size", "mark", "least", "most").agg(F.min(F.struct("band", "key")).alias("first"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK_CLASSES), F.ceil(F.col("size") * 8 / CHUNK_SET_BYTES)).cast("int")
    buckets = buckets.select("first.band", "first.key", parts.alias("parts"))
    members = staged(spread.join(buckets, ["band", "key"]).select("band", "key", "digest", "parts"), "members")

    wanted = members.select("digest").distinct().join(classes, "digest").select("digest", "copies", "bands", "copy_id")
    wanted = staged(wanted, "candidates")
    ids = wanted.select(F.col("copy_id").alias("id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = source.join(ids, source["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    blobs = with_text_columns(texts, lambda: Signer(width, bands, rows).blobs, "digest binary, grams binary", columns=[])
    sets = staged(blobs.where("digest IS NOT NULL").dropDuplicates(["digest"]).join(wanted, "digest"), "sets")

    chunk = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    placed = members.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = placed.select("band", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "digest")
    block = ["band", "key", "low", "high"]
    together = blocks.join(sets.drop("copy_id"), "digest").repartition(*block).sortWithinPartitions(*block)
    found = staged(together.mapInArrow(_verify(threshold), "digest binary, links long, root binary"), "links")

    root = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    linked = links.join(classes.select("digest", "copy_id"), "digest").join(root.withColumnRenamed("node", "digest"), "digest", "left")
    linked = linked.withColumn("root", F.coalesce("root", "digest"))
    group = linked.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    per_class = classes.select("digest", "copy_id", "copies").join(linked.join(group, "root").select("digest", "root", "links", "class_id"), "digest", "left").select(
        "digest", F.coalesce("root", "digest").alias("group"), "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    # written first, so that the last join has plain sides, which AQE splits where copies crowd
    out = signed.select("doc_id", "digest").join(staged(per_class, "classes"), "digest", "left")
    own = F.col("digest").isNull()
    return out.select(
        "doc_id", "digest", "group", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, one for each group of linked documents: that of the smallest id.

    Texts are not shuffled: the ids of other documents are removed by a narrow join. Only
    rows whose id is null or repeated are compared by content.
    """
    found = staged(link_documents(docs, doc_id=doc_id, text=text, **options), "grouped")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("class_id").eqNullSafe(F.col("doc_id"))).alias("keeps"))
    odd = staged(ids.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "odd")
    gone = staged(ids.where("NOT keeps AND n = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")), "gone")
    strange = odd.count()

    def sized(ids_of: DataFrame, n: int) -> DataFrame:
        return F.broadcast(ids_of) if n <= BROADCAST_IDS else ids_of

    key = name(doc_id)
    kept = docs.join(sized(gone, gone.count()), key.eqNullSafe(F.col("__id")), "left_anti")
    if not strange:
        return kept
    rest = docs.join(sized(odd, strange), key.eqNullSafe(F.col("__id")), "left_semi")
    kept = kept.join(sized(odd, strange), key.eqNullSafe(F.col("__id")), "left_anti")
    # of rows with the group's id, one of the smallest set stays; those without words all do
    signer = lambda: Signer(options.get("width", 5), 1, 1).signatures
    marked = with_text_columns(rest.withColumn("__lower", F.lower(name(text).cast("string"))), signer, "__digest binary, __n long, __bands array<long>", text="__lower", columns=docs.columns)
    chosen = found.where("digest IS NOT NULL AND class_id <=> doc_id").groupBy("group", F.col("class_id").alias("__class")).agg(F.min("digest").alias("__chosen"))
    worded = marked.where("__digest IS NOT NULL").dropDuplicates([doc_id, "__digest"])
    worded = worded.join(chosen, name(doc_id).eqNullSafe(F.col("__class")) & (F.col("__digest") == F.col("__chosen")), "left_semi")
    return kept.unionByName(worded.select(*[name(c) for c in docs.columns])).unionByName(marked.where("__digest IS NULL").select(*[name(c) for c in docs.columns]))
