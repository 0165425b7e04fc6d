"""Per-region composition, density and distance summaries (long feature rows unless stated)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators import neighbors as N
from cytoplane.operators.quantiles import exact_percentiles
from cytoplane.session import cut_lineage, measured
from cytoplane.settings import BOUNDS, ROLE_TERMS, SizeBounds


def feature(name: Column | str, value: Column) -> list[Column]:
    title = F.lit(name) if isinstance(name, str) else name
    return [F.col("region_id"), title.alias("name"), value.cast("double").alias("value")]


def melt(wide: DataFrame, names: list[str], key: str = "region_id") -> DataFrame:
    doubles = wide.select(key, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot([key], names, "name", "value")


def extent(cells: DataFrame) -> DataFrame:
    """Cell count, bounding-box area (at least 1e-6) and density."""
    width = F.max("x") - F.min("x")
    height = F.max("y") - F.min("y")
    return cells.groupBy("region_id").agg(
        F.count("*").cast("double").alias("cell_count"),
        F.greatest(width * height, F.lit(1e-6)).alias("bbox_area"),
        (F.count("*") / F.greatest(width * height, F.lit(1e-6))).alias("cell_density"),
    )


def proportions(cells: DataFrame, column: str, prefix: str) -> DataFrame:
    """Share of each value of ``column`` among all cells of the region; null values count in the total only."""
    counted = cells.groupBy("region_id", column).agg(F.count("*").alias("n"))
    totals = counted.groupBy("region_id").agg(F.sum("n").alias("total"))
    return (
        counted.where(F.col(column).isNotNull())
        .join(totals, "region_id")
        .select(*feature(F.concat(F.lit(prefix), C.slug(F.col(column))), F.col("n") / F.col("total")))
    )


def median_spacing(cells: DataFrame, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Median distance to the five nearest neighbours over all cells of the region; 1 where undefined."""
    bounds = measured(cells, bounds)
    lists = N.neighbour_lists(cells, 5, bounds=bounds)
    distances = lists.select("region_id", F.explode("dist").alias("d"))
    medians = exact_percentiles(distances, ["region_id"], "d", {"m": 0.5}, bounds, per_cell=5)
    scale = F.when((F.col("m") > 0) & ~F.isnan("m"), F.col("m")).otherwise(1.0)
    return (
        cells.select("region_id").distinct().join(medians, "region_id", "left")
        .select("region_id", F.coalesce(scale, F.lit(1.0)).alias("scale"))
    )


def normalize(cells: DataFrame, spacing: DataFrame | None = None, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Coordinates divided by the region's median spacing, which is kept as ``scale``.

    The spacing is one number per region but costs a neighbour search, so it is written once.
    """
    spacing = cut_lineage(median_spacing(cells, bounds)) if spacing is None else spacing
    return (
        cells.join(spacing, "region_id")
        .withColumn("x", F.col("x") / F.col("scale"))
        .withColumn("y", F.col("y") / F.col("scale"))
    )


def role_distances(
    cells: DataFrame,
    source: str = "tumor",
    targets: tuple[str, ...] = ("immune", "cd8", "macrophage"),
    role_terms: dict = ROLE_TERMS,
    bounds: SizeBounds = BOUNDS,
) -> DataFrame:
    """Nearest-target distance of every source-role cell (region_id, pair, src, dst, dist).

    A cell that plays both roles is its own nearest target, at distance zero.
    """
    lowered = cells.select("region_id", "cell_id", "x", "y", F.lower(F.coalesce("cell_type", F.lit(""))).alias("kind"))
    plays = {role: reduce(or_, [F.col("kind").contains(t) for t in role_terms[role]]) for role in {source, *targets}}
    flagged = lowered.select("region_id", "cell_id", "x", "y", *[test.alias(f"is_{role}") for role, test in plays.items()])
    pairs = F.array(
        *[F.struct(F.lit(f"{source}_to_{t}").alias("pair"), F.col(f"is_{t}").alias("is_target")) for t in targets]
    )
    points = flagged.select(
        "region_id", "cell_id", "x", "y", F.col(f"is_{source}").alias("is_query"), F.inline(pairs)
    ).where(F.col("is_query") | F.col("is_target"))
    return N.nearest_distance(points, ["region_id", "pair"], bounds, with_self=True)


def distance_summary(
    cells: DataFrame,
    source: str = "tumor",
    targets: tuple[str, ...] = ("immune", "cd8", "macrophage"),
    role_terms: dict = ROLE_TERMS,
    bounds: SizeBounds = BOUNDS,
) -> DataFrame:
    """Min, mean and median of the nearest-target distances; zero where a side is empty."""
    bounds = measured(cells, bounds)
    mins = role_distances(cells, source, targets, role_terms, bounds)
    keys = ["region_id", "pair"]
    found = exact_percentiles(
        mins, keys, "dist", {"median": 0.5}, bounds, also={"min": F.min("dist"), "mean": F.avg("dist")}
    )
    pairs = F.array(*[F.lit(f"{source}_to_{t}") for t in targets])
    every = cells.select("region_id").distinct().withColumn("pair", F.explode(pairs))
    wide = every.join(found, keys, "left")
    stats = F.array(*[F.struct(F.lit(s).alias("s"), F.coalesce(F.col(s), F.lit(0.0)).alias("v")) for s in ("min", "mean", "median")])
    return wide.select("region_id", "pair", F.explode(stats).alias("e")).select(
        *feature(F.concat("pair", F.lit("_"), "e.s"), F.col("e.v"))
    )


def patch_rollup(rows: DataFrame, prefix: str = "patch", bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Mean, population deviation and quartiles of each feature over a region's patches.

    ``rows`` is (region_id, patch..., name, value).
    """
    rolled = exact_percentiles(
        rows, ["region_id", "name"], "value", {"q25": 0.25, "q75": 0.75}, bounds,
        also={"mean": F.avg("value"), "std": F.stddev_pop("value")},
    )
    stats = F.array(
        *[F.struct(F.lit(s).alias("s"), C.finite_or(F.col(s)).alias("v")) for s in ("mean", "std", "q25", "q75")]
    )
    return (
        rolled.select("region_id", "name", F.explode(stats).alias("e"))
        .select(*feature(F.concat(F.lit(f"{prefix}_"), "name", F.lit("_"), "e.s"), F.col("e.v")))
    )


def pool(rows: DataFrame) -> DataFrame:
    """Mean, max and population variance per region and feature, with log(1 + cells)."""
    return rows.groupBy("region_id", "name").agg(
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.var_pop("value").alias("variance"),
        F.log1p(F.count("*").cast("double")).alias("log_count"),
    )
