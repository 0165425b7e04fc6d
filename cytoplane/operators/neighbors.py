"""Exact nearest-neighbour search inside groups, ordered by (distance, cell id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.operators.kd_tiles import boxes, cuts, dealt, met_tiles, tiled
from cytoplane.session import cut_lineage, group_size
from cytoplane.settings import BOUNDS, SizeBounds

MATRIX_ENTRIES = 2_000_000
RADIUS_TILE = 16  # times the bound of cells of a task: targets of a tile that a search by radius holds
ALIKE_CELLS = 256  # groups of up to this size are solved together with others of their size
BATCH_ROWS = 50_000
PATCH = 64  # queries, and targets, that a search inside a task takes together


def _nearest_rows(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k smallest finite entries per row; ties keep column order."""
    width = dist.shape[1]
    limit = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if k < width else np.full((dist.shape[0], 1), np.inf)
    rows, cols = np.nonzero((dist <= limit) & np.isfinite(dist))
    values = dist[rows, cols]
    order = np.lexsort((cols, values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    counts = np.bincount(rows, minlength=dist.shape[0])
    position = np.arange(rows.size) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = position < k
    return rows[keep], cols[keep], values[keep]


def _patches(x: np.ndarray, y: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of points that lie near each other, about so many a patch: strips of x, cut along y."""
    strips = max(1, round(np.sqrt(len(x) / size)))
    strip = np.empty(len(x), np.int64)
    strip[np.argsort(x, kind="stable")] = np.arange(len(x)) * strips // len(x)
    order = np.lexsort((y, strip))
    ends = np.flatnonzero(np.diff(strip[order])) + 1
    return [part for of in np.split(order, ends) for part in np.array_split(of, max(1, len(of) // size))]


def _searches(x: np.ndarray, y: np.ndarray, asks: np.ndarray, offered: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries (places in ``asks``) with the targets, in order, among which their k nearest surely are.

    Patches of queries first look at one patch of targets; the farthest k-th distance found there tells which others they need.
    """
    size = max(PATCH, 2 * (k + 1))
    if not (asks.size and offered.size):
        return
    if offered.size < 8 * size or not (np.isfinite(x).all() and np.isfinite(y).all()):
        step = max(1, MATRIX_ENTRIES // offered.size)
        for start in range(0, asks.size, step):
            yield np.arange(start, min(start + step, asks.size)), offered
        return
    patches = [offered[p] for p in _patches(x[offered], y[offered], size)]
    low_x, high_x, low_y, high_y = (np.array([f(v[p]) for p in patches]) for v in (x, y) for f in (np.min, np.max))
    for part in _patches(x[asks], y[asks], size):
        px, py = x[asks[part]], y[asks[part]]
        gap_x = np.maximum(np.maximum(low_x - px.max(), px.min() - high_x), 0.0)
        gap_y = np.maximum(np.maximum(low_y - py.max(), py.min() - high_y), 0.0)
        far_x, far_y = np.maximum(high_x, px.max()) - np.minimum(low_x, px.min()), np.maximum(high_y, py.max()) - np.minimum(low_y, py.min())
        first = patches[int(np.argmin(far_x * far_x + far_y * far_y))]
        dx, dy = px[:, None] - x[None, first], py[:, None] - y[None, first]
        reach = np.sqrt(np.partition(dx * dx + dy * dy, k, axis=1)[:, k].max()) * (1 + 1e-9) + 1e-300  # one of them may be the query
        met = np.flatnonzero(gap_x * gap_x + gap_y * gap_y <= reach * reach)
        yield part, np.sort(np.concatenate([patches[m] for m in met]))


def _list_kernel(keys: list[str], k: int, with_self: bool = False):
    """Arrow kernel for one bounded group: neighbour lists of its query points."""

    def run(table: pa.Table) -> pa.Table:
        ids = table["cell_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, y = (table[c].to_numpy()[order] for c in ("x", "y"))
        asks = np.flatnonzero(table["is_query"].to_numpy()[order])
        offered = np.flatnonzero(table["is_target"].to_numpy()[order])
        found_rows, found_cols, found_dist = [], [], []
        for part, near in _searches(x, y, asks, offered, k):
            dx = x[asks[part], None] - x[None, near]
            dy = y[asks[part], None] - y[None, near]
            dist = np.sqrt(dx * dx + dy * dy)
            if not with_self:
                dist[asks[part][:, None] == near[None, :]] = np.inf
            rows, cols, values = _nearest_rows(dist, k)
            found_rows.append(part[rows])
            found_cols.append(near[cols])
            found_dist.append(values)
        rows = np.concatenate(found_rows) if found_rows else np.zeros(0, dtype=np.int64)
        cols = np.concatenate(found_cols) if found_cols else np.zeros(0, dtype=np.int64)
        dist = np.concatenate(found_dist) if found_dist else np.zeros(0)
        back = np.argsort(rows, kind="stable")
        rows, cols, dist = rows[back], cols[back], dist[back]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=asks.size))]).astype(np.int32)
        id_column = table["cell_id"].combine_chunks()
        columns = {key: pa.repeat(table[key][0], asks.size) for key in keys}
        columns["src"] = id_column.take(pa.array(order[asks]))
        columns["dst"] = pa.ListArray.from_arrays(pa.array(offsets), id_column.take(pa.array(order[cols])))
        columns["dist"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(dist))
        return pa.table(columns)

    return run


def _alike_lists(table: pa.Table, starts: np.ndarray, n: int, keys: list[str], k: int, with_self: bool) -> Iterator[pa.Table]:
    """Neighbour lists of groups of n rows each, in id order from the rows ``starts`` on."""
    x, y, is_query, is_target = (table[c].to_numpy() for c in ("x", "y", "is_query", "is_target"))
    step = max(1, MATRIX_ENTRIES // (n * n))
    for first in range(0, len(starts), step):
        rows = starts[first : first + step, None] + np.arange(n)
        asks, targets = is_query[rows], is_target[rows]
        group, own = np.nonzero(asks)
        at = rows[group]
        src = rows[asks]
        dx, dy = x[src][:, None] - x[at], y[src][:, None] - y[at]
        dist = np.sqrt(dx * dx + dy * dy)
        dist[~targets[group]] = np.inf
        if not with_self:
            dist[np.arange(len(src)), own] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(dist, order, 1)
        found = np.isfinite(dist)
        offsets = pa.array(np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32))
        ids, src = table["cell_id"].combine_chunks(), pa.array(src)
        columns = {key: table[key].combine_chunks().take(src) for key in keys}
        columns["src"] = ids.take(src)
        columns["dst"] = pa.ListArray.from_arrays(offsets, ids.take(pa.array(np.take_along_axis(at, order, 1)[found])))
        columns["dist"] = pa.ListArray.from_arrays(offsets, pa.array(dist[found]))
        yield pa.table(columns)


def _lists_of(keys: list[str], k: int, with_self: bool) -> Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]:
    """Neighbour lists of all groups of a table; small ones of equal size together, larger ones each alone."""
    alone = _list_kernel(keys, k, with_self)

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        sizes = np.diff(np.append(starts, len(table)))
        for n in np.unique(sizes[sizes <= ALIKE_CELLS]).tolist():
            yield from _alike_lists(table, starts[sizes == n], n, keys, k, with_self)
        for at in np.flatnonzero(sizes > ALIKE_CELLS).tolist():
            yield alone(table.slice(starts[at], sizes[at]))

    return run


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a table in which these lie together."""
    changed = np.zeros(len(table), bool)
    changed[:1] = True
    for k in keys:
        code = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
        changed[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(changed)


def many_groups(keys: list[str], solve: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], rows: int = BATCH_ROWS):
    """Kernel over rows sorted by group: ``solve`` gets whole groups of about so many rows, the last one waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                starts = group_starts(table, keys)
                for found in solve(table.slice(0, starts[-1]), starts[:-1]):
                    yield from found.to_batches()
                held = table.slice(starts[-1]).to_batches()
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            for found in solve(table, group_starts(table, keys)):
                yield from found.to_batches()

    return run


def _schema(points: DataFrame, keys: list[str]) -> str:
    types = dict(points.dtypes)
    head = ", ".join(f"{key} {types[key]}" for key in keys)
    return f"{head}, src {types['cell_id']}, dst array<{types['cell_id']}>, dist array<double>"


def spread_groups(df: DataFrame, keys: list[str] | list[Column]) -> DataFrame:
    """Hash-partitions by the group keys into the session's full shuffle width.

    Work per row is quadratic in the group here, so merging partitions because they hold few bytes, as
    adaptive execution would, leaves cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sorted_groups(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows for a kernel over partitions: all of a group in one, together and in order.

    Partitions follow a hash of the keys and not the keys themselves. After a join by the keys Spark would leave such a
    repartition out, and when the join then turns into a broadcast while it runs, groups would be torn apart.
    """
    return spread_groups(df, [F.xxhash64(*keys)]).sortWithinPartitions(*keys, *order)


def _flagged(points: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    have = set(points.columns)
    return points.select(
        *keys, "cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"),
        (F.col("is_query") if "is_query" in have else F.lit(True)).alias("is_query"),
        (F.col("is_target") if "is_target" in have else F.lit(True)).alias("is_target"),
        *extra,
    )


def neighbour_lists(
    points: DataFrame, k: int, keys: list[str] | None = None, bounds: SizeBounds = BOUNDS, with_self: bool = False
) -> DataFrame:
    """One row per query point with its k nearest targets, as parallel arrays ``dst`` and ``dist``.

    A point that is both is not its own neighbour unless ``with_self``.

    ``points`` has the group keys, ``cell_id``, ``x``, ``y`` and optionally ``is_query`` / ``is_target``. Groups
    that fit one task are solved there; if any group is larger, the tiled plan is used for those groups.
    """
    keys = keys or ["region_id"]
    marked = _flagged(points, keys)

    def solved(rows: DataFrame) -> DataFrame:
        ordered = sorted_groups(rows, keys, "cell_id")
        return ordered.mapInArrow(many_groups(keys, _lists_of(keys, k, with_self)), _schema(points, keys))

    if group_size(points, keys, bounds) <= bounds.tile_cells:
        return solved(marked)
    sizes = marked.groupBy(*keys).agg((F.count("*") > bounds.tile_cells).alias("is_large"))
    sized = marked.join(sizes, keys)
    small = solved(sized.where(~F.col("is_large")).drop("is_large"))
    large = _tiled_lists(sized.where("is_large").drop("is_large"), k, keys, bounds, with_self)
    return small.unionByName(large)


def _tiled_lists(
    points: DataFrame, k: int, keys: list[str], bounds: SizeBounds, with_self: bool
) -> DataFrame:
    """Lists for groups beyond one task.

    Of cells at one and the same spot only the first k + 1 can ever be someone's neighbour, so only they
    enter the search; further copies have the first k as their neighbours at distance zero.

    Queries are answered inside their tile first. The k-th distance found there is a circle that holds all nearer
    targets, so only the other tiles that it meets are asked, and the lists are merged.
    """
    spot = [*keys, "x", "y"]
    seat = F.row_number().over(Window.partitionBy(*spot).orderBy(F.desc("is_target"), "cell_id"))
    ranked = cut_lineage(points.withColumn("is_seated", F.col("is_target") & (seat <= k + 1)))
    # A spot with more targets than k answers for its surplus copies without any search.
    full_spots = cut_lineage(
        ranked.where("is_seated").groupBy(*spot).agg(F.sort_array(F.collect_list("cell_id")).alias("front")).where(F.size("front") > k)
    )
    others = ranked.where(F.col("is_query") & ~F.col("is_seated"))
    surplus = others.join(full_spots, spot).select(
        *keys, F.col("cell_id").alias("src"), F.slice("front", 1, k).alias("dst"), F.array_repeat(F.lit(0.0), k).alias("dist")
    )
    lone = others.join(full_spots.select(*spot), spot, "left_anti")
    searching = ranked.where("is_seated").unionByName(lone).withColumn("is_target", F.col("is_seated"))
    most = max(bounds.tile_cells, 2 * (k + 2))
    cells = cut_lineage(searching.select(*keys, "cell_id", "x", "y", "is_query", "is_target"))
    levels = cuts(cells, keys, most)
    placed = tiled(cells, levels, keys)
    tile_keys = [*keys, "tile", "block"]

    def lists(rows: DataFrame) -> DataFrame:
        groups = spread_groups(dealt(rows, keys, most), tile_keys)
        return groups.groupBy(*tile_keys).applyInArrow(_list_kernel(tile_keys, k, with_self), _schema(groups, tile_keys))

    near = cut_lineage(lists(placed))
    circles = _circles(near, placed.where("is_query"), boxes(placed, keys), k, keys)
    beyond = met_tiles(circles, levels, keys).where("tile <> own").join(boxes(placed, keys), [*keys, "tile"])
    gap_x = F.greatest(F.col("left") - F.col("x"), F.col("x") - F.col("right"), F.lit(0.0))
    gap_y = F.greatest(F.col("bottom") - F.col("y"), F.col("y") - F.col("top"), F.lit(0.0))
    beyond = beyond.where(gap_x * gap_x + gap_y * gap_y <= F.col("radius") * F.col("radius"))
    fields = [*keys, "tile", "cell_id", "x", "y"]
    visits = beyond.select(*fields, F.lit(True).alias("is_query"), F.lit(False).alias("is_target"))
    offers = placed.where("is_target").select(*fields, F.lit(False).alias("is_query"), "is_target")
    far = lists(visits.unionByName(offers))
    return merge_lists(near.unionByName(far), k, keys).unionByName(surplus)


def _circles(near: DataFrame, asking: DataFrame, tiles: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Queries with their tile (``own``) and a radius that surely holds their k nearest.

    That is the k-th distance inside the tile, or, where the tile has too few targets, the farthest that any filled tile
    of the group can be from the queries of the tile.
    """
    found = near.select(*keys, F.col("src").alias("cell_id"), F.get("dist", F.lit(k - 1)).alias("kth"))
    rows = asking.select(*keys, "cell_id", "x", "y", F.col("tile").alias("own")).join(found, [*keys, "cell_id"])
    short = rows.where("kth is null").groupBy(*keys, "own").agg(
        *[f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("low", F.min), ("high", F.max))]
    )
    far_x = F.greatest(F.col("right"), F.col("high_x")) - F.least("left", "low_x")
    far_y = F.greatest(F.col("top"), F.col("high_y")) - F.least("bottom", "low_y")
    bound = short.join(tiles.where(F.col("n") > k), keys).groupBy(*keys, "own").agg(F.min(F.sqrt(far_x * far_x + far_y * far_y)).alias("bound"))
    radius = F.coalesce("kth", "bound", F.lit(float("inf"))) * (1 + 1e-9) + 1e-300
    return rows.join(bound, [*keys, "own"], "left").select(*keys, "cell_id", "x", "y", "own", radius.alias("radius"))


def merge_lists(partial: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Joins the lists a point got from several blocks: at most k entries from each block."""
    ordered = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("dist", "dst"))))
    best = F.slice(ordered, 1, k)
    return (
        partial.groupBy(*keys, "src")
        .agg(best.alias("best"))
        .select(*keys, "src", F.col("best.dst").alias("dst"), F.col("best.dist").alias("dist"))
    )


def explode_lists(lists: DataFrame, keys: list[str] | None = None, limit: Column | int | None = None) -> DataFrame:
    """Neighbour lists as edge rows (keys, src, dst, dist, rank)."""
    keys = keys or ["region_id"]
    pairs = F.arrays_zip("dst", "dist")
    if limit is not None:
        pairs = F.slice(pairs, F.lit(1), limit if isinstance(limit, Column) else F.lit(limit))
    return lists.select(*keys, "src", F.posexplode(pairs).alias("pos", "hit")).select(
        *keys, "src", F.col("hit.dst").alias("dst"), F.col("hit.dist").alias("dist"),
        (F.col("pos") + 1).cast("int").alias("rank"),
    )


def knn(points: DataFrame, k: int, keys: list[str] | None = None, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Directed edges to the k nearest other cells of the group (all of them in smaller groups)."""
    return explode_lists(neighbour_lists(points, k, keys, bounds), keys)


def within_radius(
    points: DataFrame, radius: Column, keys: list[str] | None = None, bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """Directed edges (keys, src, dst, dist) to every target within the query's own radius.

    ``radius`` is a column expression over ``points``. Each query looks at the 3 x 3 squares around it in a grid whose
    side is its own radius rounded up to a power of two, and targets enter every grid in use in their group. So the
    join is an equi-join on the square, and what it compares grows with what it returns, not with the widest query.
    Where a group is larger than ``bounds.tile_cells``, queries go to the k-d tiles that their circle meets instead.
    """
    keys = keys or ["region_id"]
    have = set(points.columns)
    marked = points.withColumn("radius", radius.cast("double"))
    marked = _flagged(marked, keys, "radius")
    if group_size(points, keys, bounds) > bounds.tile_cells:
        return _tiled_radius(marked, keys, bounds)
    asks = marked.where("is_query") if "is_query" in have else marked
    offers = marked.where("is_target") if "is_target" in have else marked
    level = F.ceil(F.log2(F.greatest(F.col("radius"), F.lit(1e-9)))).cast("int")
    asks = asks.withColumn("level", level)
    levels = asks.select(*keys, "level").distinct()
    square = lambda axis: F.floor(F.col(axis) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    around = lambda axis: F.explode(F.sequence(square(axis) - 1, square(axis) + 1))
    left = (
        asks.select(
            *keys, F.col("cell_id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), "radius", "level",
            around("x").alias("gx"), square("y").alias("hy"),
        )
        .withColumn("gy", F.explode(F.sequence(F.col("hy") - 1, F.col("hy") + 1)))
        .drop("hy")
    )
    right = offers.join(levels, keys).select(
        *keys, F.col("cell_id").alias("dst"), F.col("x").alias("dx"), F.col("y").alias("dy"), "level",
        square("x").alias("gx"), square("y").alias("gy"),
    )
    square_keys = [*keys, "level", "gx", "gy"]
    dist = F.sqrt(
        (F.col("sx") - F.col("dx")) * (F.col("sx") - F.col("dx"))
        + (F.col("sy") - F.col("dy")) * (F.col("sy") - F.col("dy"))
    )
    return (
        left.hint("merge").join(right, square_keys)
        .where(F.col("src") != F.col("dst"))
        .withColumn("dist", dist)
        .where(F.col("dist") <= F.col("radius"))
        .select(*keys, "src", "dst", "dist")
    )


def _tiled_radius(marked: DataFrame, keys: list[str], bounds: SizeBounds) -> DataFrame:
    """Pairs within the radius of queries for groups beyond one task.

    A tile holds as many targets as a task can search by strips, so that circles seldom reach beyond their own and a query
    is sent little more than once. Spots with more than half a tile of targets enter the search as one; pairs of a query and such a
    spot meet its targets in blocks afterwards.
    """
    most = RADIUS_TILE * bounds.tile_cells
    spot = [*keys, "x", "y"]
    cells = cut_lineage(marked.dropna(subset=keys))
    crowds = cells.where("is_target").groupBy(*spot).agg(F.count("*").alias("copies"), F.min("cell_id").alias("spot")).where(F.col("copies") > most // 2)
    crowds = cut_lineage(crowds.drop("copies"))
    if crowds.isEmpty():
        return _searched(cells, keys, most, False)
    named = cells.join(F.broadcast(crowds) if crowds.count() <= most else crowds, spot, "left")
    alone = named.withColumn("is_target", F.col("is_target") & F.col("spot").isNull()).drop("spot")
    asks = cells.where("is_query").withColumn("is_target", F.lit(False))
    spots = crowds.select(
        *keys, F.col("spot").alias("cell_id"), "x", "y", F.lit(False).alias("is_query"), F.lit(True).alias("is_target"), F.lit(0.0).alias("radius")
    )
    found = cut_lineage(_searched(asks.unionByName(spots), keys, most, True).withColumnRenamed("dst", "spot"))
    members = named.where(F.col("is_target") & F.col("spot").isNotNull()).select(*keys, "spot", F.col("cell_id").alias("dst"))
    left, right = _in_blocks(found, members, [*keys, "spot"], most)
    met = left.hint("merge").join(right, [*keys, "spot", "block_a", "block_b"]).where(F.col("src") != F.col("dst"))
    return _searched(alone, keys, most, False).unionByName(met.select(*keys, "src", "dst", "dist"))


def _searched(cells: DataFrame, keys: list[str], most: int, with_self: bool) -> DataFrame:
    """Pairs (keys, src, dst, dist) by tiles; fewer than ``most`` targets share a spot. Many queries of a tile are dealt out."""
    levels = cuts(cells, keys, most)
    fields = [*keys, "tile", "cell_id", "x", "y", "radius"]
    circles = cells.where("is_query").select(*keys, "cell_id", "x", "y", "radius")
    reach = (F.col("radius") * (1 + 1e-9) + 1e-300).alias("radius")
    asks = met_tiles(circles.select(*keys, "cell_id", "x", "y", F.col("radius").alias("own"), reach), levels, keys)
    asks = asks.withColumn("radius", F.col("own")).select(*fields, F.lit(True).alias("is_query"))
    offers = tiled(cells.where("is_target"), levels, keys).select(*fields, F.lit(False).alias("is_query"))
    tile = [*keys, "tile"]
    many = cut_lineage(asks.groupBy(*tile).agg(F.ceil(F.count("*") / (4 * most)).cast("int").alias("blocks")).where("blocks > 1"))
    group = [*tile, "block"]
    rows = asks.unionByName(offers).withColumn("block", F.lit(0))
    if not many.isEmpty():  # a small table: one row for each tile with many times as many queries as targets
        mine = F.array(F.pmod(F.xxhash64("cell_id"), F.col("blocks")).cast("int"))
        where = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.col("is_query"), mine).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.drop("block").join(many, tile, "left").withColumn("block", F.explode(where)).drop("blocks")
    types = dict(cells.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    ordered = sorted_groups(rows, group, "is_query", "cell_id")
    kernel = many_groups(group, _pairs_of(keys, with_self))
    return ordered.mapInArrow(kernel, f"{head}, src {types['cell_id']}, dst {types['cell_id']}, dist double")


def _pairs_of(keys: list[str], with_self: bool) -> Callable[[pa.Table, np.ndarray], Iterator[pa.Table]]:
    """Pairs of the queries and targets of every group of a table, in pieces of bounded size.

    Targets lie in strips as high as the radius (rounded up to a power of two) and in order of x inside; a query compares
    itself with those of each strip it meets whose x is near enough.
    """

    def run(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        ids = table["cell_id"].combine_chunks()
        _, code = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
        x, y, radius, asked = (table[c].to_numpy() for c in ("x", "y", "radius", "is_query"))
        names = {k: table[k].combine_chunks() for k in keys}
        for a, b in zip(starts, np.append(starts[1:], len(table))):
            targets = a + np.flatnonzero(~asked[a:b] & np.isfinite(x[a:b]) & np.isfinite(y[a:b]))
            asks = a + np.flatnonzero(asked[a:b] & (radius[a:b] >= 0) & np.isfinite(x[a:b]) & np.isfinite(y[a:b]))
            if not (targets.size and asks.size):
                continue
            low, high = y[targets].min(), y[targets].max()
            # Strips beyond those of the targets are not needed: no circle has to be wider than all that it can meet.
            wide = np.maximum(np.minimum(radius[asks], 2 * (high - low) + 1), (high - low) / 1e6 + 1e-300)
            level = np.ceil(np.log2(wide)).astype(int)
            for one in np.unique(level).tolist():
                height = 2.0**one
                strip = np.floor((y[targets] - low) / height).astype(np.int64)
                order = np.lexsort((x[targets], strip))
                rows, strip = targets[order], strip[order]
                tx = x[rows]
                mine = asks[level == one]
                reach = radius[mine] * (1 + 1e-9) + 1e-300
                bottom, top = (np.floor(np.clip((y[mine] + s * reach - low) / height, -1, strip[-1] + 1)).astype(np.int64) for s in (-1, 1))
                for k in range(int((top - bottom).max(initial=0)) + 1):
                    here = bottom + k
                    meets = np.flatnonzero((here >= 0) & (here <= top))
                    yield from _near(names, ids, code, x, y, radius, rows, strip, tx, mine[meets], reach[meets], here[meets], with_self)

    return run


def _near(names, ids, code, x, y, radius, rows, strip, tx, asks, reach, here, with_self: bool) -> Iterator[pa.Table]:
    """Pairs of queries with the targets of one strip each; targets are in order of strip and x."""
    first, end = np.empty(len(asks), np.int64), np.empty(len(asks), np.int64)
    for s in np.unique(here).tolist():
        of = np.flatnonzero(here == s)
        a, b = np.searchsorted(strip, [s, s + 1])
        first[of] = a + np.searchsorted(tx[a:b], x[asks[of]] - reach[of], "left")
        end[of] = a + np.searchsorted(tx[a:b], x[asks[of]] + reach[of], "right")
    total = np.cumsum(end - first)
    at = 0
    while at < len(asks):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MATRIX_ENTRIES, "right")))
        counts = end[at:upto] - first[at:upto]
        src = np.repeat(asks[at:upto], counts)
        place = np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[at:upto], counts)
        dst = rows[place]
        dx, dy = x[src] - x[dst], y[src] - y[dst]
        dist = np.sqrt(dx * dx + dy * dy)
        kept = dist <= radius[src]
        if not with_self:
            kept &= code[src] != code[dst]
        if kept.any():
            src, dst = pa.array(src[kept]), pa.array(dst[kept])
            yield pa.table({k: v.take(src) for k, v in names.items()} | {"src": ids.take(src), "dst": ids.take(dst), "dist": pa.array(dist[kept])})
        at = upto


def _in_blocks(left: DataFrame, right: DataFrame, square: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (block_a, block_b): a row goes to its own block of its side and to every block of the other.

    Squares that only one side has are left out. A block holds about ``most`` / 2 rows, so few exceed ``most``.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        blocks = F.when(F.count("*") <= most, F.lit(1)).otherwise(F.ceil(F.count("*") * 2 / most)).cast("int")
        return rows.groupBy(*square).agg(blocks.alias(name))

    sizes = counted(left, "blocks_a").join(counted(right, "blocks_b"), square)

    def placed(rows: DataFrame, cell: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(cell), F.col(f"blocks_{own}")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1))
        found = rows.join(sizes, square).withColumn(f"block_{own}", mine).withColumn(f"block_{other}", each)
        return found.drop("blocks_a", "blocks_b")

    return placed(left, "src", "a", "b"), placed(right, "dst", "b", "a")


def mutual(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Undirected edges (src < dst) present in both directions; one shuffle, no self-join."""
    keys = keys or ["region_id"]
    return (
        edges.groupBy(
            *keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
        )
        .agg(F.count("*").alias("directions"), F.min("dist").alias("dist"))
        .where(F.col("directions") == 2)
        .drop("directions")
    )


def undirected(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Directed neighbour rows as distinct edges with src < dst."""
    keys = keys or ["region_id"]
    return (
        edges.where(F.col("src") != F.col("dst"))
        .groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.min("dist").alias("dist"))
    )


def nearest_distance(
    points: DataFrame, keys: list[str] | None = None, bounds: SizeBounds = BOUNDS, with_self: bool = False
) -> DataFrame:
    """Distance from every query point to its nearest target."""
    keys = keys or ["region_id"]
    lists = neighbour_lists(points, 1, keys, bounds, with_self)
    return lists.where(F.size("dist") > 0).select(*keys, "src", F.get("dst", 0).alias("dst"), F.get("dist", 0).alias("dist"))
