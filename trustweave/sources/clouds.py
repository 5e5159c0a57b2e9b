"""Uncompressed binary clouds, read in parallel ranges of records.

A binary file is a header and a run of records of one width, so its points can be read from
any record on. Files are listed by Spark, each header is read once in a task, and the records
are cut into ranges of a bounded size: a range is a row, and a task reads its bytes alone. So
one very large cloud is spread over tasks like many small ones. Tasks open files through
Arrow's file systems, which know local, object store and HDFS addresses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from trustweave.sources.files import list_files

#: Records of one range, and the longest header that is looked for.
RANGE_RECORDS, HEADER_BYTES = 1_000_000, 1 << 16
_KINDS = {"F": "f", "I": "i", "U": "u"}


def _open(path: str) -> pa.NativeFile:
    system, place = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_input_file(place)


def parse_header(start: bytes) -> tuple[dict[str, list[str]], int]:
    """Header entries and the place of the first record."""
    at = start.find(b"\nDATA ")
    end = start.find(b"\n", at + 1)
    if at < 0 or end < 0:
        raise ValueError("no cloud header")
    lines = [line.split() for line in start[:end].decode("ascii").splitlines() if line and line[0] != "#"]
    return {words[0]: words[1:] for words in lines if words}, end + 1


def record_type(head: dict[str, list[str]]) -> np.dtype:
    return np.dtype([
        (name, f"<{_KINDS[kind]}{size}", () if count == "1" else (int(count),))
        for name, kind, size, count in zip(head["FIELDS"], head["TYPE"], head["SIZE"], head["COUNT"])
    ])


def cloud_ranges(spark: SparkSession, path: str, glob: str = "*.pcd", records: int = RANGE_RECORDS) -> DataFrame:
    """One row per range: path, first (record), n, start (byte), layout; a file that is not
    binary or not of the declared length fails."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(name) as file:
                    head, start = parse_header(file.read(HEADER_BYTES))
                if head["DATA"] != ["binary"]:
                    raise ValueError(f"{name} is not uncompressed binary: {head['DATA']}")
                kind, n = record_type(head), int(head["POINTS"][0])
                if start + n * kind.itemsize != size:
                    raise ValueError(f"{name} declares {n} points and holds {(size - start) / kind.itemsize}")
                out.append({"path": name, "points": n, "start": start, "width": kind.itemsize, "layout": repr(kind.descr)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("points", pa.int64()), ("start", pa.int64()), ("width", pa.int64()), ("layout", pa.string())]))

    files = list_files(spark, path, glob).mapInArrow(heads, "path string, points bigint, start bigint, width bigint, layout string")
    last = F.expr(f"(points - 1) div {records}")
    cut = files.filter("points > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    first = F.col("part") * records
    return cut.select(
        "path", first.alias("first"), F.least(F.col("points") - first, F.lit(records)).alias("n"),
        (F.col("start") + first * F.col("width")).alias("start"), "layout",
    )


def read_binary_clouds(
    spark: SparkSession, path: str, fields: list[str], glob: str = "*.pcd", records: int = RANGE_RECORDS
) -> DataFrame:
    """Points of binary cloud files: path, point_index and the fields as doubles."""

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ast

        for batch in batches:
            for r in batch.to_pylist():
                kind = np.dtype([tuple(x) for x in ast.literal_eval(r["layout"])])
                with _open(r["path"]) as file:
                    file.seek(r["start"])
                    data = np.frombuffer(file.read(r["n"] * kind.itemsize), kind)
                at = r["first"] + np.arange(r["n"])
                for low in range(0, r["n"], 100_000):
                    part = slice(low, low + 100_000)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["path"]] * len(at[part])), pa.array(at[part]), *[pa.array(data[f][part].astype(np.float64)) for f in fields],
                    ], ["path", "point_index", *fields])

    ranges = cloud_ranges(spark, path, glob, records)
    columns = ", ".join(f"`{f}` double" for f in fields)
    return ranges.repartition("path", "first").mapInArrow(points, f"path string, point_index bigint, {columns}")


def write_binary_clouds(points: DataFrame, path: str, file: str, fields: list[str], order: list[str]) -> None:
    """One binary file of 4-byte floats below ``path`` for each value of the column ``file``,
    points by ``order``. A file is one task's work, as a sensor writes it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {}
        done = []

        def close() -> None:
            for name, held in parts.items():
                data = np.concatenate(held)
                head = "\n".join([
                    "# .PCD v0.7", "VERSION 0.7", f"FIELDS {' '.join(fields)}", f"SIZE {' '.join('4' for _ in fields)}", f"TYPE {' '.join('F' for _ in fields)}",
                    f"COUNT {' '.join('1' for _ in fields)}", f"WIDTH {len(data)}", "HEIGHT 1", f"POINTS {len(data)}", "DATA binary\n",
                ])
                system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place}/{name}") as out:  # whole files only: a repeated task writes the same
                    out.write(head.encode("ascii") + data.tobytes())
                done.append(name)
            parts.clear()

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            data = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype("<f4") for k in range(len(fields))], 1)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if parts and names[a] not in parts:
                        close()
                    parts.setdefault(names[a], []).append(data[a:b])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])

    rows = points.repartition(file).sortWithinPartitions(file, *order).select(file, *fields)
    rows.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
