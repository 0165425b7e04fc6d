"""Exact percentiles of groups of any size (linear interpolation between order statistics)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.session import group_size
from cytoplane.settings import BOUNDS, SizeBounds

SLICES = 512


def exact_percentiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    named: dict[str, float],
    bounds: SizeBounds = BOUNDS,
    per_cell: int = 1,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per group with the named percentiles of ``value`` (nulls ignored) and further aggregates ``also``.

    ``per_cell`` is how many rows a cell contributes at most. Groups within bounds are ordered whole, in one shuffle
    and a sort that can spill. Larger groups are cut into slices by approximate split points; slice counts tell which
    slices hold the wanted ranks, and only those are ordered.
    """
    rows = rows.where(F.col(value).isNotNull())
    if group_size(rows, keys, bounds, per_cell) <= bounds.percentile_rows:
        return _sorted_percentiles(rows, keys, value, named, also or {})
    found = _sliced_percentiles(rows, keys, value, named)
    if not also:
        return found
    return found.join(rows.groupBy(*keys).agg(*[a.alias(n) for n, a in also.items()]), keys)


def exact_medians(rows: DataFrame, keys: list[str], named: dict[str, str], bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Medians of several columns (name -> column) per group; one aggregate while every group is within bounds."""
    if group_size(rows, keys, bounds) <= bounds.percentile_rows:
        return rows.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(n) for n, c in named.items()])
    parts = [_sliced_percentiles(rows.where(F.col(c).isNotNull()), keys, c, {n: 0.5}) for n, c in named.items()]
    return reduce(lambda a, b: a.join(b, keys), parts)


def _sorted_percentiles(
    rows: DataFrame, keys: list[str], value: str, named: dict[str, float], also: dict[str, Column]
) -> DataFrame:
    group = Window.partitionBy(*keys)
    seated = rows.withColumn("seat", F.row_number().over(group.orderBy(value)) - 1).withColumn(
        "last_seat", F.count("*").over(group) - 1
    )
    chosen = []
    for name, p in named.items():
        place = F.lit(float(p)) * F.col("last_seat")
        low = F.max(F.when(F.col("seat") == F.floor(place), F.col(value)))
        high = F.max(F.when(F.col("seat") == F.ceil(place), F.col(value)))
        chosen.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return seated.groupBy(*keys).agg(*chosen, *[a.alias(n) for n, a in also.items()])


def _sliced_percentiles(rows: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    distinct = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    steps = F.lit([i / SLICES for i in range(1, SLICES)])
    splits = distinct.groupBy(*keys).agg(
        F.percentile_approx("v", steps, SLICES * 20).alias("splits"), F.sum("c").alias("total")
    )
    placed = distinct.join(splits, keys).withColumn(
        "slice", F.size(F.filter("splits", lambda s: s <= F.col("v")))
    )
    slices = placed.groupBy(*keys, "total", "slice").agg(F.sum("c").alias("in_slice"))
    upto = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("before", F.sum("in_slice").over(upto) - F.col("in_slice"))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in named.items()])
    targets = (
        slices.withColumn("want", F.explode(wanted))
        .withColumn("position", F.col("want.p") * (F.col("total") - 1))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("in_slice")))
        .select(*keys, "slice", "before", F.col("want.name").alias("wanted"), "position", "rank")
    )
    needed = placed.join(targets.select(*keys, "slice").distinct(), [*keys, "slice"], "left_semi")
    inside = Window.partitionBy(*keys, "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = needed.withColumn("last", F.sum("c").over(inside)).select(
        *keys, "slice", "v", (F.col("last") - F.col("c")).alias("first"), "last"
    )
    hits = targets.join(ranked, [*keys, "slice"]).where(
        (F.col("rank") - F.col("before") >= F.col("first")) & (F.col("rank") - F.col("before") < F.col("last"))
    )
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    fraction = F.max(F.col("position") - F.floor("position"))
    values = hits.groupBy(*keys, "wanted").agg((low + (high - low) * fraction).alias("value"))
    return values.groupBy(*keys).pivot("wanted", list(named)).agg(F.first("value"))
