"""Positions within groups of any size, without ordering a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.session import group_size
from cytoplane.settings import BOUNDS, SizeBounds

SLICES = 512
SAMPLED = 20  # rows of a slice that its split points are taken from


def _splits(rows: DataFrame, keys: list[str], point: Column, largest: int, bounds: SizeBounds) -> DataFrame:
    """Split points per group for slices of about half the bound, or of 1/512 of the largest group if that is more.

    They are (value, tie) pairs of a hash sample, so equal values are split too. A group gives about 10,000 at most.
    """
    wanted = max(bounds.percentile_rows / 2, largest / SLICES)
    share = min(1.0, SAMPLED / wanted)
    picked = F.pmod(F.xxhash64(point), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))
    step = max(1, round(share * wanted))
    sample = rows.where(picked).groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("sample"))
    return sample.select(*keys, F.filter("sample", lambda _, i: (i + 1) % step == 0).alias("splits"))


def _slices(
    rows: DataFrame, keys: list[str], value: str, tie: str | None, largest: int, bounds: SizeBounds
) -> DataFrame:
    """Adds the slice number of (value, tie) between the split points of its group."""
    point = F.struct(value) if tie is None else F.struct(value, tie)
    splits = _splits(rows, keys, point, largest, bounds)
    place = F.size(F.filter("splits", lambda s: s <= point))
    return rows.join(splits, keys, "left").withColumn(
        "slice", F.when(F.col("splits").isNull(), 0).otherwise(place)
    ).drop("splits")


def running_sums(
    rows: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, str],
    tie: str | None = None,
    bounds: SizeBounds = BOUNDS,
) -> DataFrame:
    """Adds, per entry name -> column, the sum over rows strictly before this one in (value, tie) order.

    Groups within bounds are ordered whole. Otherwise each group is cut into slices of (value, tie); slice totals give
    every slice its offset and rows are ordered inside their slice only. Without a tie, values must be distinct.
    """
    order = [value] if tie is None else [value, tie]

    def before(partition: list[str]):
        return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    largest = group_size(rows, keys, bounds)
    if largest <= bounds.percentile_rows:
        return rows.withColumns(
            {name: F.coalesce(F.sum(c).over(before(keys)), F.lit(0)) for name, c in sums.items()}
        )
    placed = _slices(rows, keys, value, tie, largest, bounds)
    totals = placed.groupBy(*keys, "slice").agg(*[F.sum(c).alias(f"total_{n}") for n, c in sums.items()])
    previous = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "slice", *[F.coalesce(F.sum(f"total_{n}").over(previous), F.lit(0)).alias(f"offset_{n}") for n in sums]
    )
    inside = before([*keys, "slice"])
    return (
        placed.join(offsets, [*keys, "slice"])
        .withColumns(
            {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"offset_{n}") for n, c in sums.items()}
        )
        .drop("slice", *[f"offset_{n}" for n in sums])
    )


def positions(
    rows: DataFrame, keys: list[str], value: str, tie: str, name: str = "position", bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """Adds the 0-based position of each row in (value, tie) order within its group."""
    counted = rows.withColumn("one", F.lit(1).cast("long"))
    return running_sums(counted, keys, value, {name: "one"}, tie, bounds).drop("one")
