"""Scaled coordinates, three-scale neighbour graphs and structural vectors of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.operators import neighbors as N
from cytoplane.operators.quantiles import exact_medians, exact_percentiles
from cytoplane.operators.ranking import positions
from cytoplane.session import cut_lineage, measured
from cytoplane.settings import BOUNDS, RegionGraphSettings, SizeBounds

SETTINGS = RegionGraphSettings()


def scale_coordinates(cells: DataFrame, k: int = 6, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Median-centred coordinates over the median of positive mean k-NN distances (at least 1e-3).

    Adds ``mean_nn`` in the same unit; a lone cell keeps scale 1 and mean 1. The means are written once, since
    they serve both the scale and the column.
    """
    region, bounds = ["region_id"], measured(cells, bounds)
    middle = exact_medians(cells, region, {"mid_x": "x", "mid_y": "y"}, bounds)
    lists = N.neighbour_lists(cells, k, bounds=bounds)
    total = F.aggregate("dist", F.lit(0.0), lambda a, d: a + d)
    means = cut_lineage(lists.where(F.size("dist") > 0).select("region_id", F.col("src").alias("cell_id"), (total / F.size("dist")).alias("raw_nn")))
    scale = exact_percentiles(means.where(F.col("raw_nn") > 0), region, "raw_nn", {"s": 0.5}, bounds)
    unit = F.greatest(F.coalesce(F.col("s"), F.lit(1.0)), F.lit(1e-3))
    return (
        cells.join(means, ["region_id", "cell_id"], "left")
        .join(scale, "region_id", "left")
        .join(middle, "region_id")
        .withColumn("scale", unit)
        .withColumn("x", (F.col("x") - F.col("mid_x")) / F.col("scale"))
        .withColumn("y", (F.col("y") - F.col("mid_y")) / F.col("scale"))
        .withColumn("mean_nn", F.coalesce(F.col("raw_nn") / F.col("scale"), F.lit(1.0)))
        .drop("raw_nn", "s", "mid_x", "mid_y")
    )


def subsample(scaled: DataFrame, max_cells: int = 160, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Keeps at most ``max_cells`` per region at even positions of the radius order."""
    sizes = scaled.groupBy("region_id").agg(F.count("*").alias("n"))
    small = scaled.join(sizes.where(F.col("n") <= max_cells).select("region_id"), "region_id", "left_semi")
    large = sizes.where(F.col("n") > max_cells)
    step = (F.col("n") - 1) / F.lit(float(max_cells - 1))
    index = F.explode(F.sequence(F.lit(0), F.lit(max_cells - 1)))
    wanted = large.withColumn("i", index).select(
        "region_id",
        F.when(F.col("i") == max_cells - 1, F.col("n") - 1).otherwise(F.floor(F.col("i") * step)).cast("long").alias("position"),
    ).distinct()
    radius = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    ordered = positions(
        scaled.join(large.select("region_id"), "region_id", "left_semi").withColumn("radius", radius),
        ["region_id"], "radius", "cell_id", bounds=bounds,
    )
    kept = ordered.join(wanted, ["region_id", "position"], "left_semi").select(*scaled.columns)
    return small.select(*scaled.columns).unionByName(kept)


def _median_of_first(dist: Column, count: Column) -> Column:
    """Median of the first ``count`` entries of an ascending array."""
    low = F.get(dist, F.floor((count - 1) / 2).cast("int"))
    high = F.get(dist, F.floor(count / 2).cast("int"))
    return (low + high) / 2


def neighbour_table(points: DataFrame, s: RegionGraphSettings = SETTINGS, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Neighbour lists long enough for every scale, with each cell's list sizes and own thresholds.

    Written once: every scale reads them, and whether any list is too short decides the plan.
    """
    reach = 2 * s.knn_k + max(s.global_max_neighbors, s.knn_k * s.global_knn_multiplier)
    size = F.size("dist")
    base = F.least(F.lit(s.knn_k), size)
    table = (
        N.neighbour_lists(points, reach, bounds=bounds)
        .where(size > 0)
        .withColumn("base_k", base)
        .withColumn("expanded_k", F.least(F.greatest(F.col("base_k") + 1, F.least(F.col("base_k") * 2, size)), size))
        .withColumn("global_k", F.least(F.greatest(F.col("expanded_k") + 1, F.least(F.col("base_k") * s.global_knn_multiplier, size)), size))
        .withColumn("near_limit", F.greatest(_median_of_first(F.col("dist"), F.col("base_k")), F.lit(1e-6)) * s.adaptive_factor)
        .withColumn("own_median", _median_of_first(F.col("dist"), F.col("expanded_k")))
        .withColumn("list_full", size >= reach)
    )
    return cut_lineage(table)


def _edges(table: DataFrame, scale: str, hits: Column) -> DataFrame:
    return table.select("region_id", "src", F.posexplode(hits).alias("pos", "hit")).select(
        "region_id", F.lit(scale).alias("scale"), "src", F.col("hit.dst").alias("dst"),
        F.col("hit.dist").alias("dist"), (F.col("pos") + 1).cast("int").alias("rank"),
    )


def base_graph(
    points: DataFrame, table: DataFrame, mode: str = "adaptive_knn", bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """k nearest neighbours, in adaptive mode joined with everything within 1.5 x their median distance."""
    if mode not in ("adaptive_knn", "knn"):
        raise ValueError(f"unknown neighbourhood mode {mode!r}")
    pairs = F.arrays_zip("dst", "dist")
    if mode == "knn":
        return _edges(table, "base", F.slice(pairs, F.lit(1), F.col("base_k")))
    within = F.size(F.filter("dist", lambda d: d <= F.col("near_limit")))
    short = F.col("list_full") & (F.element_at("dist", -1) <= F.col("near_limit"))
    listed = _edges(table.where(~short), "base", F.slice(pairs, F.lit(1), F.greatest(F.col("base_k"), within)))
    if table.where(short).isEmpty():
        return listed
    rest = _wider(points, table.where(short).withColumn("radius", F.col("near_limit")), "base", None, bounds)
    return listed.unionByName(rest)


def expanded_graph(table: DataFrame) -> DataFrame:
    return _edges(table, "expanded", F.slice(F.arrays_zip("dst", "dist"), F.lit(1), F.col("expanded_k")))


def _wider(points: DataFrame, asking: DataFrame, scale: str, cap: int | None, bounds: SizeBounds) -> DataFrame:
    """Edges of the few cells whose neighbour list is too short: an exact radius search for them alone."""
    flagged = points.join(
        asking.select("region_id", F.col("src").alias("cell_id"), "radius", "own_median"), ["region_id", "cell_id"], "left"
    ).select("region_id", "cell_id", "x", "y", F.col("radius").isNotNull().alias("is_query"), F.lit(True).alias("is_target"), F.col("radius").alias("own_radius"))
    found = N.within_radius(flagged, F.coalesce("own_radius", F.lit(0.0)), bounds=bounds)
    if cap is not None:
        found = found.join(asking.select("region_id", "src", "own_median"), ["region_id", "src"]).where(F.col("dist") > F.col("own_median"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("region_id", "src").orderBy("dist", "dst")))
    if cap is not None:
        ranked = ranked.where(F.col("rank") <= cap)
    return ranked.select("region_id", F.lit(scale).alias("scale"), "src", "dst", "dist", F.col("rank").cast("int").alias("rank"))


def global_graph(
    points: DataFrame, table: DataFrame, s: RegionGraphSettings = SETTINGS, bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """Long-range neighbours: beyond the cell's own expanded median, within 2.5 x the region's median distance.

    The nearest ``global_max_neighbors`` of them in (distance, id) order; a cell without any gets its
    ``global_k``-th neighbour.
    """
    near = table.select("region_id", F.explode(F.slice("dist", F.lit(1), F.col("base_k"))).alias("d"))
    limit = exact_percentiles(near, ["region_id"], "d", {"m": 0.5}, bounds, per_cell=s.knn_k).select(
        "region_id", F.greatest(F.col("m") * s.global_distance_multiplier, F.lit(1e-3)).alias("radius")
    )
    far = F.slice(
        F.filter(
            F.arrays_zip("dst", "dist"),
            lambda p: (p["dist"] > F.col("own_median")) & (p["dist"] <= F.col("radius")),
        ),
        1, s.global_max_neighbors,
    )
    limited = table.join(limit, "region_id").withColumn("far", far)
    short = (
        F.col("list_full") & (F.element_at("dist", -1) <= F.col("radius")) & (F.size("far") < s.global_max_neighbors)
    )
    single = F.slice(F.arrays_zip("dst", "dist"), F.col("global_k"), F.lit(1))
    hits = F.when(F.size("far") > 0, F.col("far")).otherwise(single)
    listed = _edges(limited.where(~short), "global", hits)
    if limited.where(short).isEmpty():
        return listed
    searched = _wider(points, limited.where(short), "global", s.global_max_neighbors, bounds)
    nothing = limited.where(short).join(searched.select("region_id", "src").distinct(), ["region_id", "src"], "left_anti")
    return listed.unionByName(searched).unionByName(_edges(nothing, "global", single))


def multiscale_graphs(points: DataFrame, s: RegionGraphSettings = SETTINGS, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Edges of all three scales."""
    bounds = measured(points, bounds)
    table = neighbour_table(points, s, bounds)
    return (
        base_graph(points, table, s.mode, bounds)
        .unionByName(expanded_graph(table))
        .unionByName(global_graph(points, table, s, bounds))
    )


def neighbour_types(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of each type among a cell's neighbours (region_id, src, cell_type, share)."""
    kinds = cells.select("region_id", F.col("cell_id").alias("dst"), "cell_type")
    counted = edges.join(kinds, ["region_id", "dst"]).groupBy("region_id", "src", "cell_type").agg(F.count("*").alias("n"))
    degrees = edges.groupBy("region_id", "src").agg(F.count("*").alias("degree"))
    return counted.join(degrees, ["region_id", "src"]).select(
        "region_id", "src", "cell_type", (F.col("n") / F.col("degree")).alias("share")
    )


def structural_vectors(scaled: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """x, y, radius, mean_nn, density, the cell's own type and its neighbours' types as columns."""
    kinds = scaled.select("region_id", F.col("cell_id").alias("dst"), "cell_type")
    shares = (
        edges.join(kinds, ["region_id", "dst"])
        .groupBy("region_id", F.col("src").alias("cell_id"))
        .agg(*[F.avg((F.col("cell_type") == t).cast("double")).alias(f"near_{t}") for t in types])
    )
    return scaled.join(shares, ["region_id", "cell_id"], "left").select(
        "region_id", "cell_id", "x", "y",
        F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("radius"),
        "mean_nn",
        (F.lit(1.0) / F.greatest(F.col("mean_nn"), F.lit(1e-3))).alias("density"),
        *[(F.col("cell_type") == t).cast("double").alias(f"is_{t}") for t in types],
        *[F.coalesce(F.col(f"near_{t}"), F.lit(0.0)).alias(f"near_{t}") for t in types],
    )


def hash_fraction(value: Column, seed: int) -> Column:
    """Repeatable number in [0, 1) from a seed and an id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def drop_cells(cells: DataFrame, rate: float = 0.15, seed: int = 42) -> DataFrame:
    """Cells surviving a repeatable random drop; a region losing all of them keeps its first."""
    if rate <= 0:
        return cells
    marked = cells.withColumn("survives", hash_fraction(F.col("cell_id"), seed) > rate)
    emptied = (
        marked.groupBy("region_id")
        .agg(F.max("survives").alias("any_left"), F.min("cell_id").alias("cell_id"))
        .where(~F.col("any_left"))
        .select("region_id", "cell_id")
    )
    rescued = cells.join(emptied, ["region_id", "cell_id"], "left_semi")
    return marked.where("survives").drop("survives").unionByName(rescued)


def surviving_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose two ends survive."""
    alive = kept.select("region_id", "cell_id")
    return edges.join(alive.withColumnRenamed("cell_id", "src"), ["region_id", "src"], "left_semi").join(
        alive.withColumnRenamed("cell_id", "dst"), ["region_id", "dst"], "left_semi"
    )
