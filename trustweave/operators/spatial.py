"""Points in yaw-oriented boxes, as an equi-join on grid cells plus an exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from trustweave.functions.geometry import (
    box_local, box_volume, center_range, finite, transform_point,
)
from trustweave.functions.scoring import count_residuals

TOLERANCE_M = 1e-6
BOX_COLUMNS = [
    "center_x_m", "center_y_m", "center_z_m", "size_x_m", "size_y_m", "size_z_m", "yaw_rad",
]


#: Levels of the grid: cells of ``cell_m`` times a power of two. Beyond the last one, a box
#: is listed in the one cell that holds everything.
LEVELS = 24
#: With more levels than these, reading the points' reach saves more than it costs.
FEW_LEVELS = 4


def _cell(c: Column, level: Column, cell_m: float) -> Column:
    return F.when(level >= LEVELS, F.lit(0).cast("bigint")).otherwise(
        F.floor(c / (cell_m * F.pow(F.lit(2.0), level))).cast("bigint")
    )


def _inside(tolerance_m: float) -> Column:
    lx, ly, lz = box_local(
        F.col("x"), F.col("y"), F.col("z"),
        F.col("center_x_m"), F.col("center_y_m"), F.col("center_z_m"),
        F.col("__cos"), F.col("__sin"),
    )
    out = F.lit(True)
    for value, size in ((lx, "size_x_m"), (ly, "size_y_m"), (lz, "size_z_m")):
        out = out & (F.abs(value) <= F.col(size) / 2 + tolerance_m)
    return out


def box_cells(
    boxes: DataFrame, keys: list[str], box_id: list[str], tolerance_m: float, cell_m: float,
    reach_m: float = math.inf,
) -> DataFrame:
    """Boxes listed in the cells of their own level that they may touch: at most three by
    three. Boxes of unknown or undefined extent hold no point and are left out. No point is
    further out than ``reach_m`` along x or y: boxes as wide as all points go to the one cell
    of the last level, and those beyond the points are left out."""
    slack = 2 * tolerance_m + 1e-6
    sized = boxes.select(
        *keys, *box_id, *BOX_COLUMNS,
        F.cos("yaw_rad").alias("__cos"), F.sin("yaw_rad").alias("__sin"),
    ).withColumns({
        "__ex": (F.abs("__cos") * F.col("size_x_m") + F.abs("__sin") * F.col("size_y_m")) / 2 + slack,
        "__ey": (F.abs("__sin") * F.col("size_x_m") + F.abs("__cos") * F.col("size_y_m")) / 2 + slack,
    })
    wide = 2 * F.greatest("__ex", "__ey") / cell_m
    whole = min(2.0**LEVELS, max(2 * reach_m / cell_m, 1.0))
    level = F.when(wide <= 1, 0).when(wide >= whole, LEVELS).otherwise(F.ceil(F.log2(wide)))
    sized = sized.filter(~F.isnan(wide) & wide.isNotNull()).withColumn("__level", level.cast("int"))
    if math.isfinite(reach_m):
        near = lambda c, e: F.abs(c) - F.col(e) <= reach_m
        sized = sized.filter(near("center_x_m", "__ex") & near("center_y_m", "__ey"))
    span = lambda c, e: F.sequence(
        _cell(F.col(c) - F.col(e), F.col("__level"), cell_m), _cell(F.col(c) + F.col(e), F.col("__level"), cell_m)
    )
    return (
        sized.withColumn("__ix", F.explode(span("center_x_m", "__ex")))
        .withColumn("__iy", F.explode(span("center_y_m", "__ey"))).drop("__ex", "__ey")
    )


def pairs_in_boxes(
    points: DataFrame,
    boxes: DataFrame,
    keys: list[str],
    box_id: list[str],
    *,
    tolerance_m: float = TOLERANCE_M,
    cell_m: float = 4.0,
) -> DataFrame:
    """All (point, box) rows of a key where the point lies in the box.

    An equi-join on the cells of a grid with levels. A box is listed at the level whose
    cells are just as wide as it, in at most three by three cells whatever its size
    (usually four); a point is listed once for each level that any box uses. So neither
    a large box nor a small one makes many rows, and a crowded frame spreads over its
    cells. A crowded cell is a skewed join key, which AQE splits on the points' side. The
    levels in use, at most ``LEVELS`` + 1 numbers, are read once from the boxes; where they
    are many, the points' reach is read too, and all levels beyond it become one. The join
    is shuffled: sizes of listed boxes, known before they are unfolded only, would have
    them broadcast. Points with non-finite coordinates are in no box, boxes with an unknown
    extent hold no point.
    """
    return _pairs(points, points, boxes, keys, box_id, tolerance_m, cell_m)


def _pairs(
    points: DataFrame, measured: DataFrame, boxes: DataFrame, keys: list[str], box_id: list[str],
    tolerance_m: float, cell_m: float,
) -> DataFrame:
    """``measured`` has the coordinates of ``points``, whose reach is read from it."""
    if not math.isfinite(tolerance_m) or tolerance_m < 0 or cell_m <= 0:
        raise ValueError("tolerance and cell size must be valid")
    listed = box_cells(boxes, keys, box_id, tolerance_m, cell_m)
    used = sorted(r[0] for r in listed.select("__level").distinct().collect())
    if len(used) > FEW_LEVELS:
        known = measured.filter(finite(F.col("x"), F.col("y"), F.col("z")))
        reach = known.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
        listed = box_cells(boxes, keys, box_id, tolerance_m, cell_m, float(reach))
        used = sorted(r[0] for r in listed.select("__level").distinct().collect())
    at = F.col("__level")
    placed = points.filter(finite(F.col("x"), F.col("y"), F.col("z"))).withColumn(
        "__level", F.explode(F.array(*[F.lit(u) for u in used]).cast("array<int>"))
    ).select("*", _cell(F.col("x"), at, cell_m).alias("__ix"), _cell(F.col("y"), at, cell_m).alias("__iy"))
    return (
        placed.join(listed.hint("merge"), [*keys, "__level", "__ix", "__iy"])
        .filter(_inside(tolerance_m))
        .select(*points.columns, *[c for c in box_id if c not in points.columns])
    )


def count_in_boxes(
    points: DataFrame, boxes: DataFrame, keys: list[str], box_id: list[str], *,
    tolerance_m: float = TOLERANCE_M, cell_m: float = 4.0,
) -> DataFrame:
    """Points per box; boxes without points stay, with count 0.

    Points of a key at the same place are tested once, with their number as weight. Hits
    are counted before they are shuffled, and the zero rows come from a union instead of a
    second join.
    """
    places = points.filter(finite(F.col("x"), F.col("y"), F.col("z"))).groupBy(*keys, "x", "y", "z").agg(
        F.count("*").alias("__n")
    )
    hits = _pairs(places, points, boxes, keys, box_id, tolerance_m, cell_m).select(*keys, *box_id, "__n")
    zeros = boxes.select(*keys, *box_id, F.lit(0).cast("bigint").alias("__n"))
    return hits.unionByName(zeros).groupBy(*keys, *box_id).agg(F.sum("__n").alias("point_count"))


def cloud_summary(points: DataFrame, keys: list[str], intensity: str | None = None) -> DataFrame:
    """Per cloud: number of points, whether any coordinate is not finite, intensity range."""
    bad = ~finite(F.col("x"), F.col("y"), F.col("z"))
    aggs = [F.count("*").alias("points"), F.max(bad).alias("any_nonfinite")]
    if intensity:
        real = F.when(finite(F.col(intensity)), F.col(intensity))
        aggs += [
            F.min(real).alias("normalized_intensity_min"),
            F.max(real).alias("normalized_intensity_max"),
        ]
    return points.groupBy(*keys).agg(*aggs)


def transform_points(points: DataFrame, matrix: str) -> DataFrame:
    """Move ``x, y, z`` by the 4x4 matrix column; a null matrix yields nulls."""
    moved = transform_point(
        F.col(matrix), F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")
    )
    return points.withColumn("__moved", moved.col()).withColumns(
        {c: F.col(f"__moved.{c}") for c in "xyz"}
    ).drop("__moved")


def spatial_support(
    points: DataFrame,
    boxes: DataFrame,
    keys: list[str],
    box_id: list[str],
    *,
    reference: tuple[float, float] | None = None,
    **options,
) -> DataFrame:
    """Append count, residuals, range, volume and reason to boxes.

    ``boxes`` may carry ``transform_quality``; a box whose transform is not verified
    has an unknown count, as has every box of a cloud with a non-finite point.
    """
    counted = count_in_boxes(points, boxes, keys, box_id, **options)
    clouds = cloud_summary(points, keys).filter("any_nonfinite").select(*keys, "any_nonfinite")
    # shuffled like the grid's join, since unfolded boxes may look small enough to broadcast
    rows = boxes.join(counted.hint("merge"), [*keys, *box_id]).join(clouds, keys, "left")
    quality = F.col("transform_quality") if "transform_quality" in boxes.columns else F.lit("verified")
    reason = (
        F.when(~quality.eqNullSafe("verified"), "unresolved_transform")
        .when(F.col("any_nonfinite"), "nonfinite")
        .otherwise("matched")
    )
    rows = rows.withColumn("spatial_reason", reason).withColumn(
        "point_count", F.when(F.col("spatial_reason") == "matched", F.col("point_count"))
    )
    if reference:
        deficit, surplus = count_residuals(F.col("point_count"), *reference)
    else:
        deficit = surplus = F.lit(None).cast("double")
    box = {c: F.col(c) for c in BOX_COLUMNS}
    return rows.select(
        *boxes.columns,
        "point_count", "spatial_reason",
        center_range(box["center_x_m"], box["center_y_m"], box["center_z_m"]).alias("box_range_m"),
        box_volume(box["size_x_m"], box["size_y_m"], box["size_z_m"]).alias("box_volume_m3"),
        deficit.alias("deficit_residual"),
        surplus.alias("surplus_residual"),
    )
