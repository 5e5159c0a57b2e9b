"""Canonical JSON text, byte sizes and SHA-256 digests as Column expressions.

The text is what a sorted-key, separator-free JSON writer produces for the same
values, so digests can be compared with those of other tools. Doubles are the
delicate part: Spark prints ``2.5E-4`` where JSON writers print ``0.00025``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def number_text(c: Column) -> Column:
    """Shortest decimal text of a double in the usual JSON style."""
    raw = c.cast("double").cast("string")
    pattern = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, lead, frac, exp = (F.regexp_extract(raw, pattern, i) for i in range(1, 5))
    power = exp.cast("int")
    digits = F.when(frac == "0", lead).otherwise(F.concat(lead, frac))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    padded = F.rpad(digits, F.greatest(F.length(digits), power + 1), "0")
    whole = F.substring(padded, F.lit(1), power + 1)
    rest = F.substring(padded, power + 2, F.lit(400))
    large = F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    mantissa = F.when(frac == "0", lead).otherwise(F.concat(lead, F.lit("."), frac))
    expo = F.concat(
        sign, mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), "0"),
    )
    return (
        F.when(~raw.contains("E"), raw)
        .when((power < 0) & (power >= -4), small)
        .when((power > 0) & (power < 16), large)
        .otherwise(expo)
    )


def string_text(c: Column) -> Column:
    """JSON string literal with the writer's own escaping."""
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def json_text(c: Column, data_type: T.DataType) -> Column:
    """Canonical JSON text of one value; null is written as ``null``."""
    if isinstance(data_type, T.StructType):
        parts = []
        for i, name in enumerate(sorted(data_type.names)):
            head = ("," if i else "") + f'"{name}":'
            parts += [F.lit(head), json_text(c[name], data_type[name].dataType)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(data_type, T.ArrayType):
        items = F.transform(c, lambda v: json_text(v, data_type.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = number_text(c)
    elif isinstance(data_type, T.StringType):
        text = string_text(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def row_json(
    df: DataFrame, columns: list[str] | None = None, texts: dict[str, Column] | None = None
) -> Column:
    """Canonical JSON object of a row, without the final newline; ``texts`` are those of
    columns that have theirs already."""
    columns, texts = columns or df.columns, texts or {}
    parts = []
    for i, name in enumerate(sorted(columns)):
        parts += [
            F.lit(("," if i else "") + f'"{name}":'),
            texts[name] if name in texts else json_text(F.col(name), df.schema[name].dataType),
        ]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def line_sha256(text: Column) -> Column:
    """Digest of a canonical text with its one trailing newline."""
    return F.sha2(F.concat(text, F.lit("\n")), 256)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return line_sha256(row_json(df, columns))


def self_including_size(base: Column) -> Column:
    """Smallest n with n = base + digits(n): a size that counts its own digits.

    ``base`` is the byte length of everything but the digits.
    """
    fits = F.filter(
        F.array(*[F.lit(d).cast("bigint") for d in range(1, 11)]),
        lambda d: F.length((base + d).cast("string")) <= d,
    )
    return base + F.array_min(fits)


def vector_error(a: Column, b: Column) -> Column:
    """Euclidean distance of two equally long arrays; null when either is null."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def frame_local_group(sequence, session, frame, obj) -> Column:
    """Frame-scoped object group key (not a track identity)."""
    return F.concat_ws(
        "\u0000", sequence, session,
        F.concat(F.lit("frame="), frame.cast("string")),
        F.concat(F.lit("local-object="), obj.cast("string")),
    )
