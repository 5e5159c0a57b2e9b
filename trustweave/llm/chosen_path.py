"""Near-duplicate documents by a chosen-path similarity join of their shingle sets.

A document's set holds the distinct word shingles of its whole text, as 64-bit hashes; sets
are linked at a Jaccard similarity of ``percent`` / 100 or more, and linked sets are groups.

1. Signatures. Equal sets (128-bit digest) are one class from here on, so copies are one row
   after a partial aggregate. A class has COORDINATES minwise tokens of 16 bits, and a sketch
   of their lowest four.
2. Trees. A tree starts with all classes at its root. A node chooses coordinates by the hash
   of its path, 100 / ``percent`` of them on average; each member goes to a child for each
   chosen coordinate, named by its token there. So a pair at the threshold expects one common
   child or more, and pairs far below it part. Nodes are counted by a partial aggregate; those
   above ``NODE`` members branch again, to a depth that follows from the number of classes.
   ``plan_trees`` takes as many independent trees as reach the target recall at that depth.
3. Small nodes are compared exhaustively, one node at a time: by sketches first, with five
   standard deviations of slack, then the likely members by their full sets. The likely ones
   of many nodes are mostly the same; equal groups are compared once.
4. Rounds. Trees of one level go ahead of the others. Their large nodes are cut into parts by
   hash, in two ways, so that no task holds one, and each part is compared with itself. What is
   linked there has a common label from then on: a node with one label is let go, and only
   members with different labels are compared.
5. In the trees themselves a large node with few members outside its largest label, a group of
   near copies as a rule, doesn't branch: those members meet all others, part by part. So do
   the nodes still large at the last depth. Such nodes of several trees that hold much the same
   members are one, so their pairs meet once. No link between groups is lost by this.
6. Connected components of all links found give the groups.

Every link is exact; a pair at the threshold is missed with a probability of at most
1 - ``recall``, closer ones and those in shallow nodes far more rarely. Stages between rounds
are written to the shared folder, so a lost executor costs a part of one stage.

Defined cases: letters A-Z are lower-cased; with fewer words than a shingle's, the whole
sequence is the one shingle; a text without words, or null, has an empty set, is linked with
nothing and is its own group; repeated rows are copies; a group's id is its smallest id, null
if it has none, and a row is kept if its id is the group's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trustweave.llm.batches import name, with_text_columns
from trustweave.llm.components import components
from trustweave.llm.staging import staged
from trustweave.llm.text import SPACE, Texts, chunks, constants, mix, shingles, words

#: Minwise tokens of a set.
COORDINATES = 64
#: Members of a node that is compared exhaustively; classes and set bytes in one part.
NODE, PART_CLASSES, PART_BYTES = 256, 256, 1 << 25
#: A large node doesn't branch if most members have one label and the others fill few parts.
FEW_PARTS = 4
#: Trees, of one level, that label before the others.
FIRST_TREES = 3
#: Sides of a block.
LEFT, RIGHT = 1, 2
#: Rows (below 64 bytes each) of large nodes, candidate classes and their blocks that may be
#: broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bits of a token in the sketch.
SKETCH_BITS = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP, _AXIS, _PICK, _MORE = constants(4, 51)


def survival(percent: int, depth: int) -> float:
    """Least probability that a pair at the threshold shares a node at this depth."""
    whole, rest = divmod(100 / percent, 1)
    lost = 0.0
    for _ in range(depth):
        one = 1 - percent / 100 * (1 - lost)
        lost = one**whole * (1 - rest + rest * one)
    return 1 - lost


def plan_trees(classes: int, percent: int, recall: float) -> tuple[int, int]:
    """(trees, depth): unlike sets are taken to share a sixteenth of their tokens at most."""
    depth = 2 + max(1, math.ceil(math.log(max(classes, NODE) / NODE, 16)))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - survival(percent, depth)))), depth


class Signer:
    """Sets, digests and minwise tokens of texts."""

    def __init__(self, width: int):
        self.width, self.factors = width, constants(COORDINATES, 52)

    def sets(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct shingles of some rows in order, and their bounds."""
        for t in chunks(column):
            t = Texts(_LOWER[t.data], t.bounds, t.first)
            hashed, bounds = shingles(words(t, SPACE), t.n, self.width)
            parts = [np.unique(hashed[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    @staticmethod
    def digests(grams: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
        out: list[bytes | None] = [None] * (len(bounds) - 1)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            sums = np.stack([np.add.reduceat(mix(grams * f), bounds[full]) for f in constants(2, 53)], 1)
            for i, pair in zip(full.tolist(), sums):
                out[i] = pair.astype(">u8").tobytes()
        return out

    def signatures(self, column: pa.Array) -> list[pa.Array]:
        digests: list[bytes | None] = []
        sizes: list[np.ndarray] = [np.zeros(0, np.int64)]
        tokens: list[bytes | None] = []
        sketches: list[bytes | None] = []
        for grams, bounds in self.sets(column):
            size = np.diff(bounds)
            digests += self.digests(grams, bounds)
            sizes.append(size)
            full = np.flatnonzero(size)
            out = np.zeros((len(size), COORDINATES), np.uint16)
            if len(full):
                for k, f in enumerate(self.factors):
                    out[full, k] = mix(np.minimum.reduceat(grams * f, bounds[full])) >> np.uint64(48)
            low = (out & (1 << SKETCH_BITS) - 1).astype(np.uint8)
            low = low[:, ::2] << SKETCH_BITS | low[:, 1::2]
            tokens += [row.tobytes() if n else None for row, n in zip(out, size.tolist())]
            sketches += [row.tobytes() if n else None for row, n in zip(low, size.tolist())]
        return [pa.array(digests, pa.binary()), pa.array(np.concatenate(sizes)), pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary())]

    def blobs(self, column: pa.Array) -> list[pa.Array]:
        digests: list[bytes | None] = []
        blobs: list[bytes] = []
        for grams, bounds in self.sets(column):
            digests += self.digests(grams, bounds)
            blobs += [grams[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        return [pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())]


def children(path: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of each child that the rows' nodes send them to."""
    whole, rest = divmod(100 / percent, 1)
    rows, nodes = [], []
    more = mix(path * _MORE) < np.uint64(int(rest * ((1 << 64) - 1)))
    first = mix(path * _PICK)
    for k in range(int(whole) + 1):
        row = np.arange(len(path)) if k < whole else np.flatnonzero(more)
        # coordinates of one node are apart, as they start anywhere and go on by one
        axis = ((first[row] + np.uint64(k)) % np.uint64(COORDINATES)).astype(np.int64)
        rows.append(row)
        nodes.append(mix(path[row] * _STEP + mix(axis.astype(np.uint64) * _AXIS + tokens[row, axis].astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(nodes)


def _branch(seeds: np.ndarray | None, percent: int):
    """Rows (tokens, path, rest of the columns) to (node, rest); the path is each seed at a
    tree's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                part = batch.slice(low, 8192)
                tokens = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                if seeds is None:
                    row, node = children(part.column(1).to_numpy(zero_copy_only=False).view(np.uint64), tokens, percent)
                else:
                    row, node = children(np.tile(seeds, len(tokens)), np.repeat(tokens, len(seeds), axis=0), percent)
                    row = row // len(seeds)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *[c.take(row) for c in part.columns[2:]]], ["node", *part.schema.names[2:]])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that come sorted by keys, key by key; a key's rows may span batches."""
    now, held = None, []
    for batch in batches:
        for row in (r for k in range(0, batch.num_rows, 256) for r in batch.slice(k, 256).to_pylist()):
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def _roots(n: int) -> tuple[list[int], callable]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return parent, find


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _components(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Smallest row that each of n rows is connected with by pairs of rows."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[one], label[two])
        lower = label.copy()
        np.minimum.at(lower, one, least)
        np.minimum.at(lower, two, least)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _likely(percent: int, keys: list[str]):
    """Small nodes, or blocks with sides, to groups (named by their members) of members that
    may be linked. Rows come sorted by keys; all nodes of a batch are compared together, the
    pairs at one distance in the batch at a time."""
    share = percent / 100
    share += (1 - share) / (1 << SKETCH_BITS)  # tokens that agree by chance
    least = COORDINATES * (share - 5 * math.sqrt(share * (1 - share) / COORDINATES))
    schema = pa.schema([("part_of", pa.int64()), ("digest", pa.binary())])

    def compare(rows: pa.Table) -> list[pa.RecordBatch]:
        group = np.zeros(len(rows), np.int64)
        for k in keys:
            value = rows[k].to_numpy()
            group[1:] |= value[1:] != value[:-1]
        group = np.cumsum(group)
        mark, size = rows["mark"].to_numpy(), rows["n_shingles"].to_numpy().astype(np.int64)
        packed = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(rows), -1)
        sketch = np.concatenate([packed >> SKETCH_BITS, packed & (1 << SKETCH_BITS) - 1], axis=1)
        side = rows["side"].to_numpy() if "side" in rows.column_names else np.full(len(rows), LEFT | RIGHT)
        ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, len(rows)):
            one = np.flatnonzero(group[k:] == group[:-k])
            if not len(one):
                break
            two = one + k
            small, large = np.minimum(size[one], size[two]), np.maximum(size[one], size[two])
            meets = (side[one] & LEFT > 0) & (side[two] & RIGHT > 0) | (side[two] & LEFT > 0) & (side[one] & RIGHT > 0)
            one = one[(mark[one] != mark[two]) & (100 * small >= percent * large) & meets]
            for low in range(0, len(one), 1 << 14):
                some = one[low:low + (1 << 14)]
                some = some[(sketch[some] == sketch[some + k]).sum(1) >= least]
                ones.append(some)
                twos.append(some + k)
        one, two = np.concatenate(ones), np.concatenate(twos)
        member = np.unique(np.concatenate([one, two]))
        if "side" in rows.column_names and (side != LEFT | RIGHT).all() and len(one) <= 4 * len(member):
            # few on the left: a group for each, whichever tree and part it comes from
            left, right = np.where(side[one] == LEFT, one, two), np.where(side[one] == LEFT, two, one)
            digests = np.frombuffer(b"".join(rows["digest"].to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
            named = mix((digests[left] * constants(2, 57)).sum(1)).view(np.int64)
            own = rows["digest"].take(pa.array(np.concatenate([left, right])))
            return pa.Table.from_arrays([pa.array(np.concatenate([named, named])), own], ["part_of", "digest"]).combine_chunks().to_batches()
        label = _components(np.searchsorted(member, one), np.searchsorted(member, two), len(member))
        digests = rows["digest"].take(pa.array(member)).to_pylist()
        pairs = sorted(set(zip(label.tolist(), digests)))  # a member may come for both sides
        if not pairs:
            return []
        label = np.array([p[0] for p in pairs])
        words = np.frombuffer(b"".join(p[1] for p in pairs), ">u8").reshape(-1, 2).astype(np.uint64)
        starts = np.flatnonzero(np.diff(label, prepend=-1))
        named = np.add.reduceat(mix(words * constants(2, 54)).sum(1), starts)
        named = np.repeat(named, np.diff(np.append(starts, len(label))))
        return [pa.RecordBatch.from_arrays([pa.array(named.view(np.int64)), pa.array([p[1] for p in pairs], pa.binary())], schema=schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not len(rows):
                continue
            other = np.zeros(len(rows), bool)  # than the last row's node, which may go on
            for k in keys:
                value = rows[k].to_numpy()
                other |= value != value[-1]
            end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if end:
                yield from compare(rows.slice(0, end).combine_chunks())
            held = rows.slice(end)
        if held is not None and len(held):
            yield from compare(held.combine_chunks())

    return run


def _verify(percent: int):
    """Blocks of members to links (member, root), root being the least of those it is linked
    to. Pairs with one label, or that other links join already, are not compared; the others
    are, on full sets."""

    def of(members: list[dict]) -> Iterator[tuple]:
        members = sorted({m["digest"]: m for m in members}.values(), key=lambda m: m["digest"])
        grams = [np.frombuffer(m["grams"], np.uint64) for m in members]
        size = np.array([len(g) for g in grams])
        parent, find = _roots(len(members))
        linked = set()
        first: dict[int, int] = {}
        for i, m in enumerate(members):
            parent[i] = first.setdefault(m["mark"], i)
        for i in range(len(members)):
            own = find(i)
            fits = 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            others = [j for j in (np.flatnonzero(fits[i + 1:]) + i + 1).tolist() if find(j) != own]
            if not others:
                continue
            held = np.concatenate([grams[j] for j in others])
            place = np.minimum(np.searchsorted(grams[i], held), len(grams[i]) - 1)
            common = np.add.reduceat(grams[i][place] == held, np.concatenate([[0], np.cumsum(size[others])[:-1]]))
            for j, c in zip(others, common.tolist()):
                if 100 * c >= percent * (int(size[i]) + int(size[j]) - c):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a  # the least member stays a root
                    linked |= {i, j}
        for i in linked:
            yield members[i]["digest"], members[find(i)]["digest"]

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    return lambda batches: _batched((row for _, members in _grouped(batches, ["part_of", "low", "high"]) for row in of(members)), schema)


def _sized(rows: DataFrame) -> DataFrame:
    """The rows, marked for broadcast where their counted number allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


#: What a member brings to a comparison.
_MEMBER = ["digest", "mark", "n_shingles", "sketch"]
_NODE_ROW = "node long, digest binary, mark long, n_shingles int, sketch binary"


def _grow(classes: DataFrame, seeds: np.ndarray, depth: int, percent: int, labelled: bool) -> tuple[DataFrame, DataFrame]:
    """All trees of a round, level by level: likely groups (part_of, digest) of small nodes,
    and the members of large nodes that are compared part by part: those still large at the
    last level and, if classes are labelled, those with few members outside their largest
    label. Nodes of one label are let go."""
    likely, deep = [], []
    rows = classes.select("tokens", F.lit(0).cast("long").alias("path"), *_MEMBER)
    for level in range(depth):
        rows = staged(rows.mapInArrow(_branch(seeds if level == 0 else None, percent), _NODE_ROW), "nodes")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("mark").alias("least"), F.max("mark").alias("most"))
        large = _sized(staged(sizes.where(f"n > {NODE}").select("node", (F.col("least") != F.col("most")).alias("mixed")), "large"))
        small = rows.join(large, "node", "left_anti").repartition("node").sortWithinPartitions("node")
        likely.append(staged(small.mapInArrow(_likely(percent, ["node"]), "part_of long, digest binary"), "likely"))
        live = staged(rows.join(large.where("mixed").drop("mixed"), "node", "left_semi"), "live")
        if live.isEmpty():
            break
        if level == depth - 1:
            deep.append(live)
            break
        if labelled:
            labels = live.groupBy("node", "mark").agg(F.count("*").alias("n")).groupBy("node").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
            few = _sized(staged(labels.where(f"n - top <= {FEW_PARTS * PART_CLASSES} AND 2 * top >= n").select("node"), "few"))
            deep.append(live.join(few, "node", "left_semi"))
            live = live.join(few, "node", "left_anti")
        rows = live.join(classes.select("digest", "tokens"), "digest").select("tokens", F.col("node").alias("path"), *_MEMBER)
    return reduce(DataFrame.unionByName, likely), staged(reduce(DataFrame.unionByName, deep), "deep") if deep else rows.limit(0)


def _chunk(parts: str):
    return F.pmod(F.xxhash64("digest"), F.col(parts)).cast("int")


_BLOCK = ["part_of", "low", "high"]


def _first_blocks(deep: DataFrame) -> DataFrame:
    """Large nodes cut into parts in two ways that cross each other: every part of one has
    members of every part of the other, so what is alike joins through both."""
    of = deep.groupBy("node").agg(F.ceil(F.count("*") / PART_CLASSES).cast("int").alias("parts"))
    of = deep.join(of, "node").withColumnRenamed("node", "part_of").withColumn("high", F.explode(F.array(F.lit(0), F.lit(1))))
    return of.select("part_of", F.pmod(F.xxhash64("digest", "high"), F.col("parts")).cast("int").alias("low"), "high", *_MEMBER, F.lit(LEFT | RIGHT).alias("side"))


def _labels(links: DataFrame) -> DataFrame:
    """(digest, root): the least root within three links. Members of one root are connected;
    not all that are connected share one."""
    own = links.groupBy("a").agg(F.min("b").alias("label"))
    beside = links.join(own, "a").groupBy("b").agg(F.min("label").alias("label"))
    return links.join(beside, "b").groupBy(F.col("a").alias("digest")).agg(F.min("label").alias("root"))


def _united(deep: DataFrame) -> DataFrame:
    """Large nodes of all trees with the same largest label as one, named by that label, where
    their union takes no more comparisons than they do: each tree has a node with much the same
    group of near copies, whose pairs would be compared again in every tree."""
    labels = deep.groupBy("node", "mark").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "mark")).alias("top"), F.sum("n").alias("n"))
    of = labels.select("node", F.col("top.mark").alias("main"), ((F.col("n") - F.col("top.n")) * F.col("n")).alias("pairs"))
    members = staged(deep.join(of.drop("pairs"), "node"), "members")
    union = members.select("main", "mark", "digest").distinct().groupBy("main").agg((F.count_if(F.col("mark") != F.col("main")) * F.count("*")).alias("once"))
    one = union.join(of.groupBy("main").agg(F.sum("pairs").alias("pairs")), "main").where("once <= pairs").select("main", F.col("main").alias("name"))
    named = members.join(one, "main", "left").select(F.coalesce("name", "node").alias("node"), *_MEMBER)
    return staged(named.distinct(), "united")


def _later_blocks(deep: DataFrame) -> DataFrame:
    """Members of a large node outside its largest label with all members, part by part."""
    deep = _united(deep)
    labels = deep.groupBy("node", "mark").agg(F.count("*").alias("n"))
    of = labels.groupBy("node").agg(F.max(F.struct("n", "mark")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    of = of.select(
        F.col("node"), F.col("top.mark").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / PART_CLASSES).cast("int").alias("lefts"),
        F.ceil(F.col("n") / PART_CLASSES).cast("int").alias("rights"),
    )
    of = deep.join(of, "node").withColumnRenamed("node", "part_of")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = of.where("mark <> main").select("part_of", _chunk("lefts").alias("low"), each("rights").alias("high"), *_MEMBER, F.lit(LEFT).alias("side"))
    right = of.select("part_of", each("lefts").alias("low"), _chunk("rights").alias("high"), *_MEMBER, F.lit(RIGHT).alias("side"))
    return left.unionByName(right)


def _group_blocks(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Likely groups, each once; one whose sets are too many bytes as all pairs of its parts."""
    sized = staged(groups.distinct().join(classes.select("digest", "n_shingles", "mark", "copy_id"), "digest"), "sized")
    of = sized.groupBy("part_of").agg(F.ceil(F.sum("n_shingles") * 8 / PART_BYTES).cast("int").alias("parts"))
    placed = sized.join(of, "part_of").withColumn("chunk", _chunk("parts")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return placed.select("part_of", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "digest", "mark", "copy_id")


def link_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80, recall: float = 0.999) -> DataFrame:
    """One row per document: doc_id, n_shingles (of its set), component_id (smallest id of its
    group) and kept (its id is that one)."""
    source = docs.select(name(doc_id).alias("doc_id"), name(text).cast("string").alias("text"))
    made = with_text_columns(source, lambda: Signer(width).signatures, "digest binary, n_shingles long, tokens binary, sketch binary", columns=["doc_id"])
    signed = staged(made, "signatures")
    classes = staged(signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("copy_id"), F.first(F.struct(F.col("n_shingles").cast("int").alias("n_shingles"), "tokens", "sketch")).alias("own"),
    ).select("digest", "copy_id", "own.*", F.xxhash64("digest").alias("mark")), "classes")
    trees, depth = plan_trees(classes.count(), percent, recall)

    def linked(groups: DataFrame, of: DataFrame) -> DataFrame:
        """Exact links among the members of likely groups."""
        blocks = _sized(staged(_group_blocks(groups, of), "blocks"))
        ids = _sized(staged(blocks.select(F.col("copy_id").alias("id")).distinct(), "wanted"))
        texts = source.join(ids, source["doc_id"].eqNullSafe(ids["id"]), "left_semi")
        sets = with_text_columns(texts, lambda: Signer(width).blobs, "digest binary, grams binary", columns=[])
        together = sets.join(blocks.drop("copy_id"), "digest").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
        return staged(together.mapInArrow(_verify(percent), "a binary, b binary"), "links")

    def likely_in(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(_likely(percent, _BLOCK), "part_of long, digest binary")

    groups, deep = _grow(classes, constants(FIRST_TREES, 56), 1, percent, False)
    links = linked(groups.unionByName(likely_in(_first_blocks(deep))), classes)
    labelled = staged(classes.join(_labels(links), "digest", "left").withColumn("mark", F.xxhash64(F.coalesce("root", "digest"))).drop("root"), "labelled")
    groups, deep = _grow(labelled, constants(trees, 55), depth, percent, True)
    later = linked(groups.unionByName(likely_in(_later_blocks(deep))), labelled)

    found = components(links.unionByName(later)).select(F.col("node").alias("digest"), "root")
    grouped = classes.join(found, "digest", "left").select("digest", "copy_id", F.coalesce("root", "digest").alias("root"))
    least = grouped.groupBy("root").agg(F.min("copy_id").alias("component_id"))
    # written first, so that the last join has plain sides, which AQE splits where copies crowd
    per_class = staged(grouped.join(least, "root").select("digest", "component_id"), "groups")
    out = signed.select("doc_id", "digest", "n_shingles").join(per_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
