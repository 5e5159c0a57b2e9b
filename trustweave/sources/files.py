"""Readers of the raw file layout: clouds, labels, odometry, registries, fixtures.

Parsers work on DataFrames of (path, content), so any source of files can feed them.
One file holds one scan, one frame's labels, or one vehicle's series.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trustweave.functions.geometry import vec
from trustweave import schemas as S

# File-name shapes and odometry columns of the data set.
CLOUD_NAME = r"^(.+)_([0-9]+)_([0-9]+)\.([0-9]{1,9})\.pcd$"
LABEL_NAME = r"^.+_([0-9]+)\.txt$"
ODOMETRY_NAME = r"odometry_([^/]+)\.csv(?:/[^/]*)?$"
ODOMETRY_FIELDS = (
    "%time", "field.header.stamp",
    "field.pose.pose.position.x", "field.pose.pose.position.y", "field.pose.pose.position.z",
    "field.pose.pose.orientation.x", "field.pose.pose.orientation.y",
    "field.pose.pose.orientation.z", "field.pose.pose.orientation.w",
    "field.twist.twist.linear.x", "field.twist.twist.linear.y", "field.twist.twist.linear.z",
)
OMITTED_LEADING_ZEROES = "omitted_leading_zeroes"
DECIMAL_DIGITS = "decimal_digits"


def decimal_time_ns(seconds: Column, fraction: Column, convention: str) -> Column:
    """Nanoseconds of ``seconds.fraction`` without passing through a double.

    A short fraction either lost leading zeroes or is a decimal fraction.
    """
    if convention not in (OMITTED_LEADING_ZEROES, DECIMAL_DIGITS):
        raise ValueError(f"unknown time convention {convention!r}")
    pad = F.lpad if convention == OMITTED_LEADING_ZEROES else F.rpad
    return seconds.cast("bigint") * 1_000_000_000 + pad(fraction, 9, "0").cast("bigint")


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Paths and sizes below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", glob
    ).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def index_clouds(paths: DataFrame, convention: str = OMITTED_LEADING_ZEROES) -> DataFrame:
    """Agent, frame and exact time from cloud file names; bad names keep a problem."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda i: F.regexp_extract(name, CLOUD_NAME, i)
    ok = name.rlike(CLOUD_NAME)
    return paths.select(
        *paths.columns,
        F.when(ok, part(1)).alias("agent_id"),
        F.when(ok, part(2).cast("bigint")).alias("sync_frame_id"),
        F.when(ok, decimal_time_ns(part(3), part(4), convention)).alias("source_time_ns"),
        F.when(ok, F.concat_ws(".", part(3), part(4))).alias("timestamp_text"),
        F.when(~ok, "invalid_cloud_name").alias("problem"),
    )


def index_labels(paths: DataFrame, offset: int = 1) -> DataFrame:
    """Frame of each label file: the number in its name minus the offset."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ok = name.rlike(LABEL_NAME)
    frame = F.when(ok, F.regexp_extract(name, LABEL_NAME, 1).cast("bigint") - offset)
    problem = F.when(~ok, "invalid_label_name").when(frame < 0, "negative_frame")
    return paths.select(*paths.columns, frame.alias("sync_frame_id"), problem.alias("problem"))


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of small text files."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(
        path, wholetext=True
    ).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def _strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_labels(texts: DataFrame, content: str = "content") -> DataFrame:
    """One row per non-blank line with class and box; ``local_index`` counts them.

    Lines without exactly eight numeric fields keep a problem instead of values.
    """
    lines = F.filter(F.split(F.col(content), r"\r?\n"), lambda s: s.rlike(r"\S"))
    rows = texts.select(
        *[c for c in texts.columns if c != content], F.posexplode(lines).alias("local_index", "__line")
    )
    rows = rows.withColumn("__f", F.split(_strip(F.col("__line")), r"\s+"))
    number = lambda i: F.expr(f"try_cast(get(__f, {i}) AS DOUBLE)")
    values = {
        "class_id": F.expr("try_cast(get(__f, 0) AS INT)"),
        **{n: number(i + 1) for i, n in enumerate((
            "center_x_m", "center_y_m", "center_z_m", "size_x_m", "size_y_m", "size_z_m", "yaw_rad"))},
    }
    bad_number = F.lit(False)
    for c in values.values():
        bad_number = bad_number | c.isNull()
    problem = F.when(F.size("__f") != 8, "field_count").when(bad_number, "invalid_number")
    kept = [c for c in rows.columns if not c.startswith("__")]
    rows = rows.withColumn("problem", problem)
    return rows.select(
        *kept, *[F.when(F.col("problem").isNull(), c).alias(n) for n, c in values.items()], "problem"
    )


def odometry_columns(df: DataFrame, agent: Column) -> DataFrame:
    """Typed odometry rows from the raw columns of the CSV layout."""
    c = lambda name: F.col(f"`{name}`")
    p, q, v = "field.pose.pose.position.", "field.pose.pose.orientation.", "field.twist.twist.linear."
    return df.select(
        agent.alias("agent_id"),
        c("%time").cast("bigint").alias("time_ns"),
        c("field.header.stamp").cast("bigint").alias("header_time_ns"),
        vec(*[c(p + a).cast("double") for a in "xyz"]).col().alias("position_m"),
        F.struct(*[c(q + a).cast("double").alias(a) for a in "xyzw"]).alias("quaternion_xyzw"),
        vec(*[c(v + a).cast("double") for a in "xyz"]).col().alias("body_velocity_mps"),
    )


def read_odometry(spark: SparkSession, path: str, glob: str = "odometry_*.csv") -> DataFrame:
    """Odometry CSV files; a file without the required columns or types fails.

    A sender's series is a file, or a folder of parts, named after it; for folders ``glob``
    is that of the parts. Audit the rows with ``odometry_rules`` and ``order_violations``.
    """
    found = spark.read.option("pathGlobFilter", glob)
    # names come from one header: a reader left to find them lists every file once more as a path of its own
    header = found.option("recursiveFileLookup", "true").text(path).filter("value <> ''").head()
    if header is None:
        raise ValueError("odometry has no rows")
    names = spark.read.option("header", "true").csv(spark.sparkContext.parallelize([header["value"]], 1)).columns
    strings = T.StructType([T.StructField(n, T.StringType()) for n in names])  # every value is cast explicitly
    raw = spark.read.schema(strings).option("header", "true").option("mode", "FAILFAST").option(
        "pathGlobFilter", glob
    ).csv(path)
    missing = sorted(set(ODOMETRY_FIELDS) - set(raw.columns))
    if missing:
        raise ValueError(f"odometry is missing columns: {missing}")
    return odometry_columns(raw, F.regexp_extract(F.col("_metadata.file_path"), ODOMETRY_NAME, 1))


def _header(content: Column, key: str) -> Column:
    return F.regexp_extract(content, rf"(?m)^{key}[ \t]+([^\r\n]*)", 1)


def parse_ascii_clouds(texts: DataFrame, fields: list[str], content: str = "content") -> DataFrame:
    """One row per point of ASCII point-cloud files, with all requested fields.

    A file without points, or one that can't be read here, gives one row without a point.
    Each row carries ``declared_points``, ``parsed_points`` and the file's ``problem``.
    """
    kept = [c for c in texts.columns if c != content]
    rows = texts.select(
        *kept,
        F.split(_strip(_header(F.col(content), "FIELDS")), r"\s+").alias("__names"),
        _header(F.col(content), "POINTS").try_cast("bigint").alias("declared_points"),
        _strip(_header(F.col(content), "DATA")).alias("__encoding"),
        F.filter(
            F.split(F.regexp_extract(F.col(content), r"(?s)\nDATA ascii\s*?\n(.*)$", 1), r"\r?\n"),
            lambda s: s.rlike(r"\S"),
        ).alias("__lines"),
    )
    rows = rows.withColumn("parsed_points", F.size("__lines").cast("bigint"))
    problem = F.when(~F.col("__encoding").eqNullSafe("ascii"), "unsupported_encoding").when(
        ~F.col("declared_points").eqNullSafe(F.col("parsed_points")), "point_count"
    )
    rows = rows.select(
        *kept, "declared_points", "parsed_points", problem.alias("problem"), "__names",
        F.posexplode_outer("__lines").alias("point_index", "__line"),
    ).withColumn("__v", F.split(_strip(F.col("__line")), r"\s+"))
    values = [
        F.get(F.col("__v"), F.array_position("__names", F.lit(f)).cast("int") - 1).cast("double").alias(f)
        for f in fields
    ]
    return rows.select(*kept, "declared_points", "parsed_points", "problem", "point_index", *values)


def cloud_metadata(texts: DataFrame, content: str = "content") -> DataFrame:
    """Header facts of clouds and what is wrong with them."""
    kept = [c for c in texts.columns if c != content]
    words = lambda key: F.split(F.trim(_header(F.col(content), key)), r"\s+")
    rows = texts.select(
        *kept, words("FIELDS").alias("fields"), words("SIZE").alias("sizes"),
        words("TYPE").alias("types"), words("COUNT").alias("counts"),
        _header(F.col(content), "POINTS").cast("bigint").alias("points"),
        _header(F.col(content), "DATA").alias("encoding"),
    )
    need = ("x", "y", "z", "intensity")
    lacking = F.size(F.array_except(F.array(*[F.lit(n) for n in need]), "fields")) > 0
    wrong = F.lit(False)
    for n in need:
        at = F.array_position("fields", F.lit(n)).cast("int") - 1
        wrong = wrong | (F.get("sizes", at) != "4") | (F.get("types", at) != "F") | (F.get("counts", at) != "1")
    problem = (
        F.when(lacking, "missing_field").when(wrong, "not_scalar_float32")
        .when(~F.col("encoding").isin("ascii", "binary"), "unsupported_encoding")
    )
    return rows.withColumn("problem", problem)


def read_clouds(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Points of ASCII and uncompressed binary cloud files, one row per point.

    Files are split over tasks; each is decoded as one NumPy record array.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcd").option(
        "recursiveFileLookup", "true"
    ).load(path).select("path", "content")
    columns = ", ".join(f"`{f}` double" for f in fields)
    return files.mapInPandas(_decoder(fields), f"path string, point_index bigint, {columns}")


def _decoder(fields: list[str]):
    def decode(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"]):
                start = blob.index(b"\nDATA ") + 1
                end = blob.index(b"\n", start) + 1
                head = {}
                for line in blob[:end].decode("ascii").splitlines():
                    key, _, rest = line.partition(" ")
                    head[key] = rest.split()
                kinds = {"F": "f", "I": "i", "U": "u"}
                layout = np.dtype([
                    (name, f"<{kinds[t]}{size}", () if count == "1" else (int(count),))
                    for name, t, size, count in zip(
                        head["FIELDS"], head["TYPE"], head["SIZE"], head["COUNT"])
                ])
                n = int(head["POINTS"][0])
                if head["DATA"] == ["binary"]:
                    data = np.frombuffer(blob, layout, n, end)
                elif head["DATA"] == ["ascii"]:
                    data = np.atleast_1d(np.loadtxt(io.BytesIO(blob[end:]), layout)) if n else np.empty(0, layout)
                else:
                    raise ValueError(f"unsupported encoding in {path}: {head['DATA']}")
                if len(data) != n:
                    raise ValueError(f"{path} declares {n} points and holds {len(data)}")
                yield pd.DataFrame({
                    "path": path, "point_index": np.arange(n),
                    **{f: data[f].astype("float64") for f in fields},
                })

    return decode


def read_registry(spark: SparkSession, path: str, schema: str = S.REGISTRY, rows: str = "agents") -> DataFrame:
    """Rows of registry files (JSON, or YAML where a YAML reader is installed), each file
    small and whole, read by Spark from any file system it knows. An unreadable file fails."""
    name = F.input_file_name()
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        name.rlike(r"\.ya?ml$").alias("yaml"), F.col("value").alias("text")
    )
    strict = {"mode": "FAILFAST"}
    listed = F.from_json("text", f"struct<{rows}: array<struct<{_struct_fields(schema)}>>>", strict)
    plain = texts.filter("NOT yaml").select(F.inline(listed[rows]))
    if not any(p.endswith((".yaml", ".yml")) for p in spark.read.option("recursiveFileLookup", "true").text(path).inputFiles()):
        return plain

    def parse(batches):
        import pandas as pd
        import yaml

        for batch in batches:
            yield pd.DataFrame({"line": [json.dumps(r) for text in batch["text"] for r in yaml.safe_load(text)[rows]]})

    lines = texts.filter("yaml").select("text").mapInPandas(parse, "line string")
    return plain.unionByName(lines.select(F.from_json("line", schema, strict).alias("r")).select("r.*"))


def _struct_fields(schema: str) -> str:
    """The fields of a schema as those of a struct type."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def read_fixture(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Observation rows of nested fixtures, one row per frame and agent. A file holds one
    fixture, or one in each line."""
    raw = spark.read.schema(S.FIXTURE).json(path, multiLine=not one_per_line)
    frames = raw.select("*", F.explode("frames").alias("f")).drop("frames")
    rows = frames.select("*", F.explode("f.observations").alias("o"))
    return rows.select(
        "fixture_run_id", "source_id", "sequence_id", "session_id", "ego_agent_id",
        "max_source_age_ns", "ewma", "integration_corruption",
        "f.sync_frame_id", "f.decision_time_ns", "f.clean_reference", "o.*",
    )


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", glob
    ).load(path)
    return files.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def write_text_files(
    rows: DataFrame, path: str, file: str, line: str, order: list[str], header: str | None = None
) -> None:
    """One text file below ``path`` for each value of the column ``file``: the header, then the
    column ``line`` of its rows by ``order``. A file is one task's work.

    Tasks write whole files in place, and a repeated task writes the same. A table partitioned
    by ``file`` would make folders and renames for each file, the last of them one by one on the
    driver. The folder is complete when this returns; use a new one for each run.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        system.create_dir(place, recursive=True)
        now, out, done = None, None, 0
        try:
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if name != now:
                        if out is not None:
                            out.close()
                        now, out, done = name, system.open_output_stream(f"{place}/{name}"), done + 1
                        if header is not None:
                            out.write(f"{header}\n".encode())
                    out.write(f"{'' if text is None else text}\n".encode())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([done])], ["files"])

    placed = rows.repartition(file).sortWithinPartitions(file, *order).select(file, line)
    placed.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
