"""Published evidence tables: write once, verify, resume."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from trustweave.operators.governance import verify_inventory
from trustweave.sources.files import file_inventory


class StoreError(RuntimeError):
    """A published table is stale, partial or altered."""


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), sort_by: list[str] = ()) -> int:
    """Write a zstd Parquet table once and check its row count; returns the rows."""
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if sort_by:
        rows = rows.sortWithinPartitions(*sort_by)
    rows.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    written = seen.get["rows"]
    if df.sparkSession.read.parquet(path).count() != written:
        raise StoreError(f"row count of {path} differs after writing")
    return written


def write_delta(delta: DataFrame, path: str, variant: str = "variant_id") -> int:
    """Evidence deltas of many variants, one folder per variant."""
    return write_table(delta, path, [variant])


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).limit(1).count()
        return True
    except AnalysisException:
        return False


def publish(df: DataFrame, path: str, fingerprint: str, **options) -> DataFrame:
    """Publish ``df`` under ``path`` for a request fingerprint, or reuse it.

    The manifest is written last and marks completion: same fingerprint is reused
    after verification, another one or an unfinished folder is an error.
    """
    spark = df.sparkSession
    manifest = _manifest(spark, path)
    if manifest is not None:
        return read_verified(spark, path, fingerprint)
    if _exists(spark, path):
        raise StoreError(f"{path} is incomplete; publish to a new folder")
    rows = write_table(df, f"{path}/data", **options)
    files = file_inventory(spark, f"{path}/data", "*.parquet")
    files.withColumns({"fingerprint": F.lit(fingerprint), "rows": F.lit(rows)}).write.mode(
        "errorifexists"
    ).parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/data")


def read_verified(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """Read a published table after comparing fingerprint, files and digests."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise StoreError(f"{path} has no completion manifest")
    if fingerprint is not None and manifest.filter(F.col("fingerprint") != fingerprint).limit(1).count():
        raise StoreError(f"{path} was published for another request")
    bad = verify_inventory(manifest, file_inventory(spark, f"{path}/data", "*.parquet")).take(3)
    if bad:
        raise StoreError(f"{path} was altered: {bad}")
    return spark.read.parquet(f"{path}/data")


def read_attempts(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Recorded attempts of a published table, for coverage and replay."""
    rows = read_verified(spark, path, fingerprint)
    missing = {"variant_id", "status", "realized_effect_band", "maximum_effect"} - set(rows.columns)
    if missing:
        raise StoreError(f"{path} holds no attempts: {sorted(missing)} are missing")
    return rows


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON report in a stable order."""
    df.orderBy(*[F.asc_nulls_first(c) for c in order]).write.mode("errorifexists").json(path)
