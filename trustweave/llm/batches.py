"""Columns computed from one text column, batch by batch in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text given to a function at once; a longer single text comes alone.
SLICE_BYTES = 1 << 22
#: Bytes of one Arrow batch on its way to a Python worker, in place of Spark's larger default.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: texts are long, and each task holds a batch on both
    sides. A smaller value that the user has set stays."""
    now = spark.conf.get(BATCH_SETTING, None)
    if not (now or "").isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def name(column: str) -> Column:
    """The column of this very name, dots and spaces in it included."""
    return F.col("`" + column.replace("`", "``") + "`")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + limit, "right")))
        yield low, high
        low = high


def with_text_columns(
    docs: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], ddl: str, *,
    text: str = "text", columns: Sequence[str] | None = None, before: dict[str, Column] | None = None,
) -> DataFrame:
    """Append what a function computes from the text column.

    ``make`` is called once for each task and gives the function, which turns texts into
    one array for each field of ``ddl``. ``columns`` are carried along (default: all);
    the text goes back from Python only if it is among them. ``before`` adds columns that
    Spark computes itself. A carried column named like a new one is replaced.
    """
    small_batches(docs.sparkSession)
    fields = T.StructType.fromDDL(ddl).fields
    before = before or {}
    new = {f.name.lower() for f in fields} | {b.lower() for b in before}
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in new]
    carried = [c for c in kept if c != text]
    rows = docs.select(*[name(c) for c in carried], *[v.alias(k) for k, v in before.items()], name(text).cast("string").alias("__text"))
    head = rows.schema.fields[:-1]
    back = text in kept
    place = len(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                made = compute(part.column(place))
                columns_out = [*part.columns[:place + back], *made]
                yield pa.RecordBatch.from_arrays(columns_out, [str(i) for i in range(len(columns_out))])

    placed = [*head, *([rows.schema.fields[-1]] if back else []), *fields]
    # numbered names inside, so that no name clashes on the way
    schema = T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(placed)])
    out = rows.toDF(*[str(i) for i in range(len(rows.columns))]).mapInArrow(run, schema)
    at = {c: i for i, c in enumerate([*carried, *before, *[text] * back, *[f.name for f in fields]])}
    return out.select(*[name(str(at[c])).alias(c) for c in [*kept, *before, *[f.name for f in fields]]])
