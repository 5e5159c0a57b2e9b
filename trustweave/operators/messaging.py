"""Packets, integrity and admission with exact byte accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from trustweave.functions.canonical import json_text, line_sha256, row_json, self_including_size
from trustweave.operators.joins import null_safe
from trustweave.schemas import POLICIES
from trustweave.sources.stage import once

SIZE = "measured_size_bytes"
SERIALIZATION = "canonical-json-sort-keys-utf8-v1"  # fixed value of the wire format
_EMPTY = f'"{SIZE}":0'


def _with_size(text: Column, size: Column) -> Column:
    # inside JSON strings quotes are escaped, so the bare key occurs only once
    return F.replace(text, F.lit(_EMPTY), F.concat(F.lit(f'"{SIZE}":'), size.cast("string")))


def payload_digest(payload: Column) -> Column:
    return line_sha256(json_text(payload, T.ArrayType(T.DoubleType())))


def _wire(
    df: DataFrame, flat: list[str], nested: list[str] | None, texts: dict[str, Column] | None = None
) -> Column:
    """Canonical text of the wire object; ``texts`` as for :func:`row_json`.

    ``nested`` fields go under ``descriptor``, together with an ``integrity`` object.
    """
    if not nested:
        return row_json(df, [*flat, SIZE], texts)
    inner = [*nested, SIZE]
    integrity = F.struct(
        F.lit("sha256").alias("algorithm"), F.col("payload_sha256"),
        F.lit(SERIALIZATION).alias("serialization"),
    )
    parts = {name: (F.col(name), df.schema[name].dataType) for name in flat}
    kind = T.StructType([df.schema[n] for n in inner])
    kind.add("integrity", T.StructType([
        T.StructField(n, T.StringType()) for n in ("algorithm", "payload_sha256", "serialization")
    ]))
    parts["descriptor"] = (F.struct(*inner, integrity.alias("integrity")), kind)
    out = [F.lit("{")]
    for i, name in enumerate(sorted(parts)):
        text = (texts or {}).get(name)
        out += [F.lit(("," if i else "") + f'"{name}":'), json_text(*parts[name]) if text is None else text]
    return F.concat(*out, F.lit("}"))


def _flat_fields(identity: list[str], payload: str, nested: list[str] | None) -> list[str]:
    return [payload] if nested else [*identity, payload, "local_confidence", "payload_sha256"]


def build_packets(
    observations: DataFrame,
    identity: list[str],
    *,
    payload: str = "payload",
    nested: list[str] | None = None,
    digest: bool = True,
) -> DataFrame:
    """Packets of the present, non-ego observations that carry a vector.

    Appends ``payload_sha256``, ``measured_size_bytes`` (which counts its own
    digits) and ``packet_sha256`` of the wire text. With ``nested`` the identity is
    wrapped in a descriptor object, else the wire text is one flat object. Without
    ``digest`` there is no ``packet_sha256``, for reports that only count bytes.
    """
    sent = observations.filter(
        ~F.col("is_ego") & F.col("message_present")
        & F.col("source_time_ns").isNotNull() & F.col(payload).isNotNull()
    )
    # a number's text takes many steps, so the payload's is made once for digest and wire
    rows = once(sent, __payload=json_text(F.col(payload), T.ArrayType(T.DoubleType())))
    rows = once(rows, payload_sha256=line_sha256(F.col("__payload"))).withColumn(
        SIZE, F.lit(0).cast("bigint")
    )
    same = sent.schema[payload].dataType.simpleString() == "array<double>"
    texts = {payload: F.col("__payload")} if same else {}
    text = _wire(rows, _flat_fields(identity, payload, nested), nested, texts)
    rows = once(rows, __wire=text).drop("__payload")
    # one digit stands in for the size, one newline ends the message
    size = self_including_size(F.octet_length("__wire") - 1 + 1).cast("bigint")
    rows = once(rows.drop(SIZE), **{SIZE: size})
    if not digest:
        return rows.drop("__wire")
    packet = line_sha256(_with_size(F.col("__wire"), F.col(SIZE)))
    return once(rows, packet_sha256=packet).drop("__wire")


def verify_packets(
    packets: DataFrame, identity: list[str], *, payload: str = "payload",
    nested: list[str] | None = None,
) -> DataFrame:
    """Append ``integrity_valid``: both digests and the size recomputed and compared."""
    zero = packets.withColumn("__size", F.col(SIZE)).withColumn(SIZE, F.lit(0).cast("bigint"))
    text = _wire(zero, _flat_fields(identity, payload, nested), nested)
    rows = once(zero, __wire=_with_size(text, F.col("__size"))).withColumn(SIZE, F.col("__size"))
    valid = (
        (payload_digest(F.col(payload)) == F.col("payload_sha256"))
        & (F.octet_length("__wire") + 1 == F.col(SIZE))
        & (line_sha256(F.col("__wire")) == F.col("packet_sha256"))
    )
    return once(rows, integrity_valid=F.coalesce(valid, F.lit(False))).drop("__wire", "__size")


def admit(
    packets: DataFrame,
    *,
    max_source_age_ns: int,
    state: str = "current_state",
    check_integrity: bool = True,
    policies: tuple[str, ...] = POLICIES,
) -> DataFrame:
    """One row per packet and policy with the decision and its bytes.

    The packet row carries the sender's state (see ``attach_states``). The first
    failing test names the reason: integrity, age, then the gate.
    """
    if max_source_age_ns < 0:
        raise ValueError("max_source_age_ns must be nonnegative")
    age = F.col("decision_time_ns") - F.col("source_time_ns")
    intact = F.col("integrity_valid") if check_integrity else F.lit(True)
    closed = (F.col("policy") == "hard_gate") & ~F.col(state).eqNullSafe("normal")
    reason = (
        F.when(~intact, "invalid_integrity")
        .when((age < 0) | (age > max_source_age_ns), "late")
        .when(closed, "hard_gated")
        .otherwise("admitted")
    )
    rows = packets.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    rows = rows.withColumn("reason_code", reason)
    admitted = F.col("reason_code") == "admitted"
    return rows.select(
        *[c for c in packets.columns if c != "reason_code"],
        "policy",
        F.lit(max_source_age_ns).cast("bigint").alias("max_source_age_ns"),
        age.alias("source_age_ns"),
        admitted.alias("admitted"),
        F.when(admitted, F.col(SIZE)).otherwise(F.lit(0)).cast("bigint").alias("admitted_bytes"),
        "reason_code",
    )


def attach_states(packets: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Add the sender's state; senders without one stay, with a null state."""
    right = states.select(*keys, "current_state")
    joined = packets.alias("p").join(right.alias("s"), null_safe("p", "s", keys), "left")
    return joined.select("p.*", "s.current_state")
