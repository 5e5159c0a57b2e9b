"""Provenance, logical hashes, split roles and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustweave.functions.canonical import line_sha256, row_hash, row_json
from trustweave.operators.contracts import Rule, one_of, safe_relative_path, text, violations
from trustweave.operators.joins import duplicate_keys, null_safe
from trustweave.schemas import SPLIT_ACTIONS, SPLIT_ROLES

LINEAGE_GROUPS = {
    "sequence_session": ("sequence_id", "session_id"),
    "source_episode": ("source_episode_id",),
    "neighboring_frame_block": ("neighboring_frame_block_id",),
    "clean_counterpart": ("clean_counterpart_id",),
}


def leakage(lineage: DataFrame, groups: dict[str, tuple[str, ...]] = LINEAGE_GROUPS) -> DataFrame:
    """Lineage groups whose rows have more than one role.

    Distinct (group, role) pairs first: a group's copies collapse before the
    shuffle and at most one row per role is left to compare.
    """
    keys = [
        F.struct(F.lit(kind).alias("kind"), F.concat_ws("\u0000", *cols).alias("group_key"))
        for kind, cols in groups.items()
    ]
    pairs = lineage.select("role", F.inline(F.array(*keys))).groupBy("kind", "group_key", "role").agg(
        F.count("*").alias("rows")
    )
    return pairs.groupBy("kind", "group_key").agg(
        F.count("*").alias("roles"), F.sum("rows").alias("rows"),
        F.min("role").alias("first_role"), F.max("role").alias("last_role"),
    ).filter("roles > 1")


def role_conflicts(lineage: DataFrame, splits: DataFrame) -> DataFrame:
    """Lineage rows whose sequence is unassigned, not frozen, or has another role."""
    assigned = splits.select(
        "sequence_id", F.col("role").alias("assigned_role"), "resolved", "frozen"
    )
    problem = (
        F.when(F.col("assigned_role").isNull(), "unassigned")
        .when(~(F.col("resolved") & F.col("frozen")), "not_frozen")
        .when(F.col("role") != F.col("assigned_role"), "role_conflict")
    )
    return lineage.join(assigned, "sequence_id", "left").select(
        *lineage.columns, "assigned_role", problem.alias("problem")
    ).filter("problem is not null")


def allowed_actions(spark) -> DataFrame:
    """The (action, role) pairs that are permitted."""
    rows = [(a, r) for a, roles in SPLIT_ACTIONS.items() for r in roles]
    return spark.createDataFrame(rows, "action string, role string")


def forbidden_actions(requests: DataFrame, splits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requested (sequence, action) rows that no frozen role permits."""
    usable = splits.filter("resolved and frozen").select("sequence_id", "role")
    permitted = usable.join(allowed, "role").select("sequence_id", "action")
    return requests.join(permitted, ["sequence_id", "action"], "left_anti")


def split_problems(splits: DataFrame) -> DataFrame:
    """Rule violations of a split registry, one row each."""
    rules = [
        text("source_id"), text("sequence_id"), one_of("role", SPLIT_ROLES),
        Rule("resolved", F.col("resolved")), Rule("frozen", F.col("frozen")),
    ]
    rows = violations(splits, ["sequence_id"], rules)
    for key in ("source_id", "sequence_id"):
        rows = rows.unionByName(duplicate_keys(splits, [key]).select(
            F.col(key).alias("sequence_id"), F.lit(f"unique_{key}").alias("rule")
        ))
    development = splits.agg(F.count_if(F.col("role") == "regression_development").alias("n"))
    return rows.unionByName(development.filter("n <> 1").select(
        F.lit(None).cast("string").alias("sequence_id"),
        F.lit("sole_development_source").alias("rule"),
    ))


def manifest_problems(files: DataFrame) -> DataFrame:
    """Unsafe paths, malformed digests and repeated paths of a file inventory."""
    rules = [
        Rule("path_safe", safe_relative_path(F.col("path"))),
        Rule("bytes_nonnegative", F.col("bytes") >= 0),
        Rule("sha256_well_formed", F.col("sha256").rlike("^[0-9a-f]{64}$")),
    ]
    twice = duplicate_keys(files, ["path"]).select("path", F.lit("unique_path").alias("rule"))
    return violations(files, ["path"], rules).unionByName(twice)


def verify_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, unexpected, or differ in size or digest."""
    e = expected.select("path", F.struct("bytes", "sha256").alias("e"))
    a = actual.select("path", F.struct("bytes", "sha256").alias("a"))
    problem = (
        F.when(F.col("a").isNull(), "missing")
        .when(F.col("e").isNull(), "unexpected")
        .when(F.col("e.bytes") != F.col("a.bytes"), "size_mismatch")
        .when(F.col("e.sha256") != F.col("a.sha256"), "sha256_mismatch")
    )
    return e.join(a, "path", "full_outer").select("path", problem.alias("problem")).filter(
        "problem is not null"
    )


def row_hashes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumn("row_sha256", row_hash(df, columns))


def table_hash(df: DataFrame, columns: list[str] | None = None, fanout_digits: int = 2,
               levels: int = 3) -> DataFrame:
    """One digest of all rows, independent of their order and of file bytes.

    A tree of digests: equal rows collapse to (digest, copies), then groups by
    digest prefix are hashed in sorted order, level by level. Digests are uniform,
    so groups stay even; with ``levels * fanout_digits`` prefix digits no group
    grows beyond rows / 16**digits.
    """
    rows = df.select(row_hash(df, columns).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    rows = rows.select("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("line"))
    total = rows.select(
        F.substring("h", 1, fanout_digits * levels).alias("p"), "line"
    )
    for level in range(levels, 0, -1):
        digest = F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)
        total = total.groupBy("p").agg(digest.alias("line")).select(
            F.substring("p", 1, fanout_digits * (level - 1)).alias("p"),
            F.concat_ws(":", "p", "line").alias("line"),
        )
    return total.agg(
        F.sha2(F.coalesce(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("")), 256)
        .alias("table_sha256")
    )


#: Words of 32 bits in which row digests are summed.
SUM_WORDS = 8


def table_sum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A hash of a table as a multiset of rows that can be merged: eight sums of digest words.

    Rows count as often as they occur, their order doesn't matter, and the sum of a table
    is that of its parts: a delta's rows are added and those it replaces taken away
    (``merge_sums``) without another scan of the base. Words of 32 bits are summed in
    decimals, so no sum wraps, and the digest of the sums is the hash.
    Against errors, not against forgers: sums of digests are not a signature.
    """
    word = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    rows = df.select(row_hash(df, columns).alias("h"))
    zero = F.lit(0).cast("decimal(38,0)")
    return rows.agg(
        F.count("*").alias("rows"),
        F.array(*[F.coalesce(F.sum(word(i)).cast("decimal(38,0)"), zero) for i in range(SUM_WORDS)]).alias("sums"),
    )


def merge_sums(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The sums of the base with some rows added and some removed; one row each."""
    parts = base.withColumn("sign", F.lit(1)).unionByName(added.withColumn("sign", F.lit(1))).unionByName(
        removed.withColumn("sign", F.lit(-1))
    )
    return parts.agg(
        F.sum(F.col("rows") * F.col("sign")).alias("rows"),
        F.array(*[F.sum(F.col("sums")[i] * F.col("sign")).cast("decimal(38,0)") for i in range(SUM_WORDS)]).alias("sums"),
    )


def sum_digest(sums: DataFrame) -> DataFrame:
    """(rows, table_digest) of merged sums."""
    text = F.concat_ws(":", F.col("rows").cast("string"), F.transform("sums", lambda s: s.cast("string")))
    return sums.select("rows", F.sha2(text, 256).alias("table_digest"))


def delta_sums(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(added, removed) sums of a keyed delta: its own rows, and the base rows it replaces,
    found by one join with the delta's keys."""
    hit = base.alias("b").join(delta.select(*keys).alias("d"), null_safe("b", "d", keys), "left_semi")
    return table_sum(delta, columns), table_sum(hit, columns)


def request_fingerprint(config: DataFrame, ignore: tuple[str, ...] = ("producer_command",)) -> DataFrame:
    """Digest of each configuration row, without the fields that do not matter."""
    columns = [c for c in config.columns if c not in ignore]
    return config.select("*", line_sha256(row_json(config, columns)).alias("fingerprint"))


def group_key(*parts: Column) -> Column:
    return F.concat_ws("\u0000", *parts)
