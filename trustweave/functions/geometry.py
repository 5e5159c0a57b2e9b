"""Quaternion, rigid-transform, box and visibility Columns (no Python per row).

Stored vectors are structs ``{x, y, z}``, quaternions ``{x, y, z, w}``. Functions
take such a struct column or :class:`Parts` and return :class:`Parts`: separate
component Columns, so that a nested call does not repeat whole structs. Call
``.col()`` for a struct again; keep long chains short by storing steps as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


class Parts(dict):
    """Named component Columns of a vector or quaternion."""

    def col(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in self.items()])


def vec(x, y, z) -> Parts:
    return Parts(x=x, y=y, z=z)


def quat(x, y, z, w) -> Parts:
    return Parts(x=x, y=y, z=z, w=w)


def parts_of(prefix: str, names: str = "xyz") -> Parts:
    """Components stored in the columns ``<prefix>x``, ``<prefix>y``, ..."""
    return Parts({n: F.col(prefix + n) for n in names})


def columns_of(prefix: str, parts: Parts) -> dict[str, Column]:
    """Columns to store components under, for ``withColumns``."""
    return {prefix + n: c for n, c in parts.items()}


def finite(*cols: Column) -> Column:
    """True when every column is a real number: not null, NaN or infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False))
    return out


def finite_vec(v: Column, parts: str = "xyz") -> Column:
    return finite(*[v[p] for p in parts])


def add(a, b) -> Parts:
    return vec(*[a[p] + b[p] for p in "xyz"])


def sub(a, b) -> Parts:
    return vec(*[a[p] - b[p] for p in "xyz"])


def scale(a, k) -> Parts:
    return vec(*[a[p] * k for p in "xyz"])


def dot(a, b, parts: str = "xyz") -> Column:
    total = a[parts[0]] * b[parts[0]]
    for p in parts[1:]:
        total = total + a[p] * b[p]
    return total


def cross(a, b) -> Parts:
    return vec(
        a["y"] * b["z"] - a["z"] * b["y"],
        a["z"] * b["x"] - a["x"] * b["z"],
        a["x"] * b["y"] - a["y"] * b["x"],
    )


def norm(a, parts: str = "xyz") -> Column:
    return F.sqrt(dot(a, a, parts))


def quat_normalize(q) -> Parts:
    n = norm(q, "xyzw")
    return quat(*[q[p] / n for p in "xyzw"])


def quat_conjugate(q) -> Parts:
    return quat(-q["x"], -q["y"], -q["z"], q["w"])


def quat_multiply(a, b) -> Parts:
    """Hamilton product: rotate by ``b``, then by ``a``."""
    return quat(
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    )


def quat_rotate(q, v) -> Parts:
    """Rotate ``v`` by unit ``q``: v + 2w(u x v) + 2u x (u x v)."""
    t = scale(cross(q, v), F.lit(2.0))
    u = cross(q, t)
    return vec(*[v[p] + q["w"] * t[p] + u[p] for p in "xyz"])


def slerp(df: DataFrame, a: Parts, b: Parts, share: Column, out: str) -> DataFrame:
    """Append ``<out>x`` ... ``<out>w``: short-arc interpolation of unit quaternions.

    Each step is a column of its own: written as one expression, the angle would be
    repeated dozens of times and outgrow code generation.
    """
    step = df.withColumn("__sign", F.when(dot(a, b, "xyzw") < 0, -1.0).otherwise(1.0))
    near = Parts({p: F.col("__sign") * b[p] for p in "xyzw"})
    gap = Parts({p: near[p] - a[p] for p in "xyzw"})
    both = Parts({p: near[p] + a[p] for p in "xyzw"})
    # atan2 of the chord lengths stays exact for tiny angles, acos does not
    step = step.withColumn("__theta", 2 * F.atan2(norm(gap, "xyzw"), norm(both, "xyzw")))
    step = step.withColumn("__rest", share)
    theta, t = F.col("__theta"), F.col("__rest")
    tiny = theta < 1e-12
    sine = F.when(tiny, 1.0).otherwise(F.sin(theta))
    step = step.withColumns({
        "__wa": F.when(tiny, 1 - t).otherwise(F.sin((1 - t) * theta) / sine),
        "__wb": F.col("__sign") * F.when(tiny, t).otherwise(F.sin(t * theta) / sine),
    })
    return step.withColumns({
        out + p: F.col("__wa") * a[p] + F.col("__wb") * b[p] for p in "xyzw"
    }).drop("__sign", "__theta", "__rest", "__wa", "__wb")


def quat_first_angle(q) -> Column:
    """The angle about z that an extrinsic z-y-x decomposition applies first."""
    r00 = 1 - 2 * (q["y"] * q["y"] + q["z"] * q["z"])
    r01 = 2 * (q["x"] * q["y"] - q["z"] * q["w"])
    return F.atan2(-r01, r00)


def quat_to_matrix(q: Column) -> Column:
    """3x3 rotation rows of a unit quaternion."""
    x, y, z, w = (q[p] for p in "xyzw")
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def matrix_to_quat(m: Column) -> Column:
    """Unit quaternion (w >= 0 where it is not zero) of a proper rotation matrix."""
    e = lambda i, j: m[i][j]
    half = lambda c: F.sqrt(F.greatest(c, F.lit(0.0))) / 2
    w = half(1 + e(0, 0) + e(1, 1) + e(2, 2))
    x = half(1 + e(0, 0) - e(1, 1) - e(2, 2))
    y = half(1 - e(0, 0) + e(1, 1) - e(2, 2))
    z = half(1 - e(0, 0) - e(1, 1) + e(2, 2))
    big = F.greatest(w, x, y, z)
    four = 4 * big
    return (
        F.when(big == w, quat((e(2, 1) - e(1, 2)) / four, (e(0, 2) - e(2, 0)) / four,
                              (e(1, 0) - e(0, 1)) / four, w).col())
        .when(big == x, quat(x, (e(0, 1) + e(1, 0)) / four, (e(0, 2) + e(2, 0)) / four,
                             (e(2, 1) - e(1, 2)) / four).col())
        .when(big == y, quat((e(0, 1) + e(1, 0)) / four, y, (e(1, 2) + e(2, 1)) / four,
                             (e(0, 2) - e(2, 0)) / four).col())
        .otherwise(quat((e(0, 2) + e(2, 0)) / four, (e(1, 2) + e(2, 1)) / four, z,
                        (e(1, 0) - e(0, 1)) / four).col())
    )


def matrix_is_rigid(m: Column, tolerance: float = 1e-6) -> Column:
    """4x4 with finite entries, orthonormal proper rotation and a (0,0,0,1) last row."""
    ok = (F.size(m) == 4) & F.forall(
        m, lambda r: (F.size(r) == 4) & F.forall(r, lambda v: finite(v))
    )
    for i in range(3):
        for j in range(i, 3):
            prod = sum((m[k][i] * m[k][j] for k in range(3)), F.lit(0.0))
            ok = ok & (F.abs(prod - (1.0 if i == j else 0.0)) <= tolerance)
    det = (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )
    last = sum((F.abs(m[3][k] - (1.0 if k == 3 else 0.0)) for k in range(4)), F.lit(0.0))
    return F.coalesce(ok & (F.abs(det - 1) <= tolerance) & (last <= tolerance), F.lit(False))


def transform_point(m: Column, x: Column, y: Column, z: Column) -> Parts:
    """Apply a 4x4 rigid matrix column to a point."""
    return vec(*[m[i][0] * x + m[i][1] * y + m[i][2] * z + m[i][3] for i in range(3)])


def invert_transform(m: Column) -> Column:
    """Inverse of a rigid 4x4: transposed rotation, rotated negated translation."""
    rows = [
        F.array(
            m[0][i], m[1][i], m[2][i],
            -(m[0][i] * m[0][3] + m[1][i] * m[1][3] + m[2][i] * m[2][3]),
        )
        for i in range(3)
    ]
    return F.array(*rows, F.array(*[F.lit(float(k == 3)) for k in range(4)]))


def compose_transforms(first: Column, then: Column) -> Column:
    """Matrix that applies ``first`` and afterwards ``then``."""
    return F.array(*[
        F.array(*[
            sum((then[i][k] * first[k][j] for k in range(4)), F.lit(0.0)) for j in range(4)
        ])
        for i in range(4)
    ])


def resolve_extrinsics(extrinsics: Column) -> tuple[Column, Column]:
    """(matrix or null, quality): only a verified status yields a usable matrix."""
    verified = extrinsics["status"] == "verified"
    matrix = F.when(verified, extrinsics["matrix_4x4"])
    return matrix, F.when(verified, "verified").otherwise("unresolved_transform")


def box_local(px, py, pz, cx, cy, cz, cos_yaw, sin_yaw) -> tuple[Column, Column, Column]:
    """Point coordinates in the frame of a yaw-oriented box."""
    dx, dy = px - cx, py - cy
    return cos_yaw * dx + sin_yaw * dy, cos_yaw * dy - sin_yaw * dx, pz - cz


def box_to_frame(lx, ly, lz, cx, cy, cz, cos_yaw, sin_yaw) -> tuple[Column, Column, Column]:
    return cos_yaw * lx - sin_yaw * ly + cx, sin_yaw * lx + cos_yaw * ly + cy, lz + cz


def box_volume(sx, sy, sz) -> Column:
    return sx * sy * sz


def center_range(cx, cy, cz) -> Column:
    return F.sqrt(cx * cx + cy * cy + cz * cz)


def visibility(center: Column, coverage: Column) -> Column:
    """Struct (eligible, reason, range, azimuth, elevation); unknown stays null."""
    horizontal = F.hypot(center["x"], center["y"])
    distance = F.sqrt(horizontal * horizontal + center["z"] * center["z"])
    azimuth = F.degrees(F.atan2(center["y"], center["x"]))
    elevation = F.degrees(F.atan2(center["z"], horizontal))
    reason = (
        F.when(center.isNull(), "unresolved_transform")
        .when(~coverage["status"].eqNullSafe("verified"), "visibility_unknown")
        .when(~finite_vec(center), "nonfinite")
        .otherwise("matched")
    )
    known = reason == "matched"
    eligible = (
        (distance <= coverage["range_m"])
        & (F.abs(azimuth) <= coverage["horizontal_fov_deg"] / 2)
        & (F.abs(elevation) <= coverage["vertical_fov_deg"] / 2)
    )
    return F.struct(
        F.when(known, eligible).alias("eligible"),
        reason.alias("reason_code"),
        F.when(known, distance).alias("range_m"),
        F.when(known, azimuth).alias("azimuth_deg"),
        F.when(known, elevation).alias("elevation_deg"),
    )


def normalized_intensity(raw: Column, divisor: float) -> Column:
    if not divisor > 0 or math.isinf(divisor):
        raise ValueError("divisor must be finite and positive")
    # NaN must stay NaN: greatest/least would order it above every number
    ratio = (raw.cast("float") / F.lit(divisor).cast("float")).cast("float")
    clipped = F.least(F.greatest(ratio, F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))
    return F.when(F.isnan(ratio), ratio).otherwise(clipped)
