"""Token counts by a two-tier lookup on the map side.

Tier 1 is a table of frequent pre-tokens and their token counts, broadcast: at most
``table_size`` entries, found in at most ``sample_rows`` documents. It is a cache only; no
count depends on what it holds. Tier 2 is a cache per
Python worker for pre-tokens outside the table, encoded by the library when first met.
No pre-token is ever shuffled; the plan is one scan and one map.

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are
counted whole; repeated rows and rows with null ids give a row each; other columns stay
as they are, but those named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from trustweave.llm.batches import name, with_text_columns
from trustweave.llm.units import check_units, load_model, split_units

#: Entries of a worker's cache (about 45 MB); beyond, it starts anew from the table.
CACHE_SIZE = 1 << 18
#: Longer texts don't serve as samples for the broadcast table.
SAMPLE_TEXT_BYTES = 1 << 16
#: Longer pre-tokens are encoded each time, so that the caches stay small.
CACHED_CHARS = 64


@lru_cache(maxsize=2)
def worker_counter(path: str) -> UnitCounter:
    """One counter for each Python worker, kept from task to task."""
    return UnitCounter(path, {})


class UnitCounter:
    """Counts tokens of texts with one library processor."""

    def __init__(self, path: str, table: dict[str, int]):
        check_units(load_model(path))
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table, self.cache = table, dict(table)

    def use(self, table: dict[str, int]) -> UnitCounter:
        """Take the broadcast table as first tier, if it is another than before."""
        if table is not self.table:
            self.table = table
            self.cache |= table
        return self

    def encode_unit(self, unit: str) -> int:
        if unit[0] == " ":  # the library itself adds the first space
            n = len(self.model.encode(unit[1:])) if len(unit) > 1 else 1
        elif unit == "\n":
            n = 1
        else:
            n = len(self.model.encode("\n" + unit)) - 2
        if len(unit) <= CACHED_CHARS:
            if len(self.cache) >= CACHE_SIZE + len(self.table):
                self.cache = dict(self.table)
            self.cache[unit] = n
        return n

    def count(self, text: str | None) -> int:
        units = split_units(text or "")
        found = list(map(self.cache.get, units))
        if None in found:
            return sum(self.encode_unit(u) if n is None else n for u, n in zip(units, found))
        return sum(found)


def frequent_units(docs: DataFrame, counter: UnitCounter, text: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """At most ``table_size`` frequent pre-tokens of a bounded sample, with their counts.

    ``take`` reads as few partitions as give ``sample_rows`` texts of at most
    ``SAMPLE_TEXT_BYTES``, so the sample costs the same for any corpus.
    """
    value = name(text).cast("string")
    sample = docs.select(value.alias("text")).where(F.octet_length("text").between(1, SAMPLE_TEXT_BYTES)).take(sample_rows)
    seen = Counter(u for r in sample for u in split_units(r["text"]) if len(u) <= CACHED_CHARS)
    return {u: counter.encode_unit(u) for u, _ in seen.most_common(table_size)}


def count_tokens(
    docs: DataFrame, model_path: str, *, text: str = "text", columns: Sequence[str] | None = None, limit: int = 4096, table_size: int = 1 << 15, sample_rows: int = 500,
) -> DataFrame:
    """Append ``n_bytes``, ``n_tokens`` and ``over_limit`` to ``columns`` (default: all).

    ``model_path`` must exist on every executor.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, UnitCounter(model_path, {}), text, sample_rows, table_size))

    def make():
        counter = worker_counter(model_path).use(table.value)
        return lambda texts: [pa.array([counter.count(x) for x in texts.to_pylist()], pa.int64())]

    n_bytes = F.coalesce(F.octet_length(name(text).cast("string")), F.lit(0)).cast("long")
    counted = with_text_columns(docs, make, "n_tokens long", text=text, columns=columns, before={"n_bytes": n_bytes})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
