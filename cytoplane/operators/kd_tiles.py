"""Tiles of bounded size for groups too large for one task: k-d cuts placed by counts.

A group is cut at quantiles of its wider axis, the pieces again, until no tile holds more targets than the bound. Counts
alone place the cuts, so neither dense spots nor far outliers make a tile large. The cuts are small tables, one row a cut
piece: places and circles descend through them by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.session import cut_lineage

#: Quantiles that a piece is described by, hence the most pieces that one cut makes.
GRID = 256
ROOT = "0"
SENT_VALUES = 200_000


def _quantiles(axis: str) -> Column:
    return F.percentile_approx(F.when(F.col("is_target"), F.col(axis)), [i / GRID for i in range(1, GRID)], GRID * 16)


def _cut_values(most: int) -> list[Column]:
    """Axis and cut values of a piece: at its wider axis, as many that pieces of about square shape result."""
    parts = F.col("n") / F.lit(float(most))
    inner = {a: F.get(f"{a}_grid", F.lit(GRID * 15 // 16 - 1)) - F.get(f"{a}_grid", F.lit(GRID // 16)) for a in "xy"}
    whole = {a: F.col(f"{a}_high") - F.col(f"{a}_low") for a in "xy"}
    # Widths without the outer sixteenths, so that outliers do not choose the axis; an axis of one value cannot be cut.
    wide = {a: F.when(whole[a] == 0, F.lit(-1.0)).otherwise(inner[a]) for a in "xy"}
    on_x = F.when((wide["x"] == 0) & (wide["y"] == 0), whole["x"] >= whole["y"]).otherwise(wide["x"] >= wide["y"])
    shape = F.greatest(F.lit(1.0), F.greatest(inner["x"], inner["y"]) / F.greatest(F.least(inner["x"], inner["y"]), F.lit(1e-300)))
    pieces = F.sqrt(parts * F.least(shape, parts))
    pieces = F.when(pieces > parts * 0.7, parts * 1.2).otherwise(pieces)
    pieces = F.greatest(F.lit(2), F.least(F.ceil(pieces), F.lit(GRID))).cast("int")

    def values(a: str) -> Column:
        above = lambda v: v > F.col(f"{a}_low")  # noqa: E731  a cut at the lowest value would leave its left side empty
        place = lambda i: F.get(f"{a}_grid", F.round(i * GRID / pieces).cast("int") - 1)
        even = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), pieces - 1), place), above))
        any_cut = F.slice(F.array_distinct(F.filter(F.col(f"{a}_grid"), above)), 1, 1)
        return F.when(F.size(even) > 0, even).when(F.size(any_cut) > 0, any_cut).otherwise(F.array(f"{a}_high"))

    return [on_x.alias("on_x"), F.when(on_x, values("x")).otherwise(values("y")).alias("cuts")]


def cuts(points: DataFrame, keys: list[str], most: int) -> list[DataFrame]:
    """Levels of cuts (keys, tile, on_x, cuts) until no tile has more than ``most`` targets.

    ``points`` has the keys, x, y and is_target, and is read once a level; at most ``most`` - 1 targets share a spot.
    """
    levels: list[DataFrame] = []
    while True:
        pieces = tiled(points, levels, keys).where("is_target").groupBy(*keys, "tile").agg(
            F.count("*").alias("n"), *[f(a).alias(f"{a}_{n}") for a in "xy" for n, f in (("low", F.min), ("high", F.max), ("grid", _quantiles))]
        )
        level = cut_lineage(pieces.where(F.col("n") > most).select(*keys, "tile", *_cut_values(most)))
        values = level.agg(F.sum(F.size("cuts"))).first()[0]
        if values is None:
            return levels
        # About one value a tile: sent to all tasks while it is a few megabytes, so that points are not shuffled to find their tile.
        levels.append(F.broadcast(level) if values <= SENT_VALUES else level)


def _place(value: Column) -> Column:
    """How many cuts are not above the value: its side of the cuts."""
    return F.size(F.filter("cuts", lambda cut: cut <= value))


def _below(side: Column) -> Column:
    return F.when(F.col("cuts").isNull(), F.col("tile")).otherwise(F.concat_ws(".", "tile", side.cast("string")))


def tiled(points: DataFrame, levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """The points with their tile."""
    found = points.withColumn("tile", F.lit(ROOT))
    for level in levels:
        value = F.when(F.col("on_x"), F.col("x")).otherwise(F.col("y"))
        found = found.join(level, [*keys, "tile"], "left").withColumn("tile", _below(_place(value))).drop("on_x", "cuts")
    return found


def met_tiles(circles: DataFrame, levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row for each tile that the square around a circle (x, y, radius) meets."""
    found = circles.withColumn("tile", F.lit(ROOT))
    for level in levels:
        value = F.when(F.col("on_x"), F.col("x")).otherwise(F.col("y"))
        sides = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(
            F.sequence(_place(value - F.col("radius")), _place(value + F.col("radius")))
        )
        found = found.join(level, [*keys, "tile"], "left").withColumn("side", F.explode(sides))
        found = found.withColumn("tile", _below(F.col("side"))).drop("on_x", "cuts", "side")
    return found


def boxes(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with their targets: (keys, tile, n, left, right, bottom, top)."""
    return placed.where("is_target").groupBy(*keys, "tile").agg(
        F.count("*").alias("n"), F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("bottom"), F.max("y").alias("top")
    )


def dealt(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Queries and targets of tiles in groups (keys, tile, block) of at most about ``most`` of each; a row has both flags.

    A tile with more queries has them dealt out by id; its targets, ``most`` at most, go to each of its blocks. Tiles
    without a query have no group.
    """
    tile = [*keys, "tile"]
    asked = rows.where("is_query").groupBy(*tile).agg(F.count("*").alias("asked"))
    blocks = F.when(F.col("asked") <= most, F.lit(1)).otherwise(F.ceil(F.col("asked") * 2 / most)).cast("int")
    home = F.pmod(F.xxhash64("cell_id"), F.col("blocks")).cast("int")
    everywhere = F.when(F.col("is_target"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
    spread = rows.join(asked.select(*tile, blocks.alias("blocks")), tile).withColumn("home", home).withColumn("block", F.explode(everywhere))
    return spread.select(*tile, "block", "cell_id", "x", "y", (F.col("is_query") & (F.col("block") == F.col("home"))).alias("is_query"), "is_target")
