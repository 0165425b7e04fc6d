"""Persistence diagrams of cell subsets and their summaries.

A group is (region_id, scope, subset): scope ``region`` or a patch, subset a role or a union of two roles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from heapq import heappop, heappush
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators.composition import patch_rollup
from cytoplane.operators.graphs import star_components
from cytoplane.operators.neighbors import many_groups, sorted_groups, spread_groups
from cytoplane.operators.triangulation import delaunay_pairs, spots_of, tiled_edges
from cytoplane.session import cut_lineage, largest_group, measured
from cytoplane.settings import BOUNDS, ROLE_TERMS, SUBSET_ROLES, FeatureSettings, SizeBounds

DENSE_POINTS = 2048
SEARCHED_POINTS = 50_000  # up to here a tree grown point by point takes less time than the Delaunay edges
ALIKE_POINTS = 128  # subsets of up to this size are solved together with others of their size
ALIKE_ENTRIES = 2_000_000
GROUP = ["region_id", "scope", "subset"]
DIAGRAM = [*GROUP, "dim"]
SUMMARY_STATS = (
    "count", "total_persistence", "entropy", "betti_area", "betti_peak", "betti_mean", "silhouette_mean", "silhouette_peak",
)


def subset_points(cells: DataFrame, role_terms: dict = ROLE_TERMS) -> DataFrame:
    """Cells once per subset they belong to (region_id, scope, subset, cell_id, x, y); a union holds either role.

    Types are lowered, roles tested and subsets listed in three projections, so no test is repeated.
    """
    scope = [F.col("scope")] if "scope" in cells.columns else [F.lit("region").alias("scope")]
    roles = sorted({role for needed in SUBSET_ROLES.values() for role in needed})
    lowered = cells.select("region_id", *scope, "cell_id", "x", "y", F.lower(F.coalesce("cell_type", F.lit(""))).alias("kind"))
    flagged = lowered.select(
        "region_id", "scope", "cell_id", "x", "y",
        *[reduce(or_, [F.col("kind").contains(t) for t in role_terms[r]]).alias(f"is_{r}") for r in roles],
    )
    named = [
        F.when(reduce(or_, [F.col(f"is_{role}") for role in needed]), F.lit(subset)) for subset, needed in SUBSET_ROLES.items()
    ]
    listed = flagged.select("region_id", "scope", F.explode(F.array(*named)).alias("subset"), "cell_id", "x", "y")
    return listed.where(F.col("subset").isNotNull())


def assign_patches(cells: DataFrame, patch_size: float = 12.0, minimum: int = 6) -> DataFrame:
    """Cells with the square patch they fall in, counted from the region's corner; small patches dropped."""
    corner = cells.groupBy("region_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    size = F.lit(max(patch_size, 1e-6))
    px = F.floor((F.col("x") - F.col("x0")) / size).cast("string")
    py = F.floor((F.col("y") - F.col("y0")) / size).cast("string")
    placed = cells.join(corner, "region_id").withColumn("scope", F.concat_ws("_", px, py)).drop("x0", "y0")
    kept = placed.groupBy("region_id", "scope").count().where(F.col("count") >= minimum).select("region_id", "scope")
    return placed.join(kept, ["region_id", "scope"], "left_semi")


def _edge_ranks(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs in (length, i, j) order."""
    i, j = (ends.astype(np.int32) for ends in np.triu_indices(dist.shape[0], 1))
    lengths = dist[i, j]
    order = np.argsort(lengths, kind="stable")
    return i[order], j[order], lengths[order]


def _tree_edges(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of the ordered edges that join two parts: the minimum spanning tree."""
    part = np.arange(n)
    tree: list[int] = []
    at = 0
    while len(tree) < n - 1:
        span = slice(at, at + 4 * n)
        for e in (at + np.flatnonzero(part[i[span]] != part[j[span]])).tolist():
            a, b = part[i[e]], part[j[e]]
            if a != b:
                part[part == b] = a
                tree.append(e)
        at += 4 * n
    return tree


def _tree_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spanning-tree lengths of finite points, shortest first. The part grows by its shortest way out; of all distances only the
    shortest into the part is held for each point left, so memory follows the points."""
    x, y, near = x[::-1].copy(), y[::-1].copy(), np.full(len(x), np.inf)
    lengths = np.empty(len(x) - 1)
    at = len(x) - 1
    for left in range(len(x) - 1, 0, -1):
        here_x, here_y = x[at], y[at]
        x[at], y[at], near[at] = x[left], y[left], near[left]  # the last takes the place of the joined one
        dx, dy = x[:left] - here_x, y[:left] - here_y
        np.minimum(near[:left], np.sqrt(dx * dx + dy * dy), out=near[:left])
        at = int(near[:left].argmin())
        lengths[left - 1] = near[at]
    return np.sort(lengths)


def _sparse_tree_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spanning-tree lengths of many points: the tree lies inside the Delaunay edges, so only those are joined."""
    spots = np.unique(np.stack([x, y], axis=1), axis=0)
    copies = np.zeros(x.size - len(spots))
    sx, sy = spots[:, 0], spots[:, 1]
    pairs = np.array(sorted(delaunay_pairs(sx, sy)), dtype=np.int64).reshape(-1, 2) if len(spots) > 2 else np.zeros((0, 2), np.int64)
    if len(pairs) == 0:  # on one line, neighbours in order are the tree
        pairs = np.stack([np.arange(len(spots) - 1), np.arange(1, len(spots))], axis=1)
    dx, dy = sx[pairs[:, 0]] - sx[pairs[:, 1]], sy[pairs[:, 0]] - sy[pairs[:, 1]]
    kept = _forest_lengths(pairs, np.sqrt(dx * dx + dy * dy), len(spots))
    if len(kept) != len(spots) - 1:
        raise AssertionError(f"{len(spots)} spots are joined by {len(kept)} edges")
    return np.concatenate([copies, kept])


def _forest_lengths(pairs: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the edges of a minimum spanning forest over n nodes, shortest first."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for e in np.argsort(lengths, kind="stable").tolist():
        a, b = root(int(pairs[e, 0])), root(int(pairs[e, 1]))
        if a != b:
            parent[b] = a
            kept.append(lengths[e])
    return np.array(kept, float)


def _forest_kernel(table: pa.Table) -> pa.Table:
    ends = pa.concat_arrays([table["src"].combine_chunks(), table["dst"].combine_chunks()]).to_numpy(zero_copy_only=False)
    nodes, at = np.unique(ends, return_inverse=True)
    kept = _forest_lengths(at.reshape(2, -1).T, table["dist"].to_numpy(), len(nodes))
    return pa.table({"region_id": pa.repeat(table["region_id"][0], len(kept)), "dist": pa.array(kept)})


def forest_lengths(edges: DataFrame, most: int) -> DataFrame:
    """Lengths (region_id, dist) of a minimum spanning forest of each region's edges (src, dst, dist), of any number.

    While a region has more than ``most`` edges, every part takes its shortest way out and joined parts become one node;
    of edges between the same two parts the shortest stays. This at least halves the parts, and what is left then is
    joined in one task a region.
    """
    kept = None
    open_ = cut_lineage(edges.select("region_id", "src", "dst", "dist", F.col("src").alias("u"), F.col("dst").alias("v")))
    while largest_group(open_, ["region_id"]) > most:
        name = F.struct("dist", "src", "dst", "u", "v").alias("way")
        ways = open_.select("region_id", F.col("u").alias("node"), name).unionByName(open_.select("region_id", F.col("v").alias("node"), name))
        shortest = cut_lineage(ways.groupBy("region_id", "node").agg(F.min("way").alias("way")).select("region_id", "way.*").distinct())
        taken = shortest.select("region_id", "dist")
        kept = taken if kept is None else kept.unionByName(taken)
        parts = star_components(shortest.select("region_id", F.col("u").alias("src"), F.col("v").alias("dst")))
        for end in ("u", "v"):
            named = parts.select("region_id", F.col("cell_id").alias(end), F.col("component").alias(f"{end}_part"))
            open_ = open_.join(named, ["region_id", end], "left").withColumn(end, F.coalesce(f"{end}_part", end)).drop(f"{end}_part")
        ordered = open_.where(F.col("u") != F.col("v")).select(
            "region_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct("dist", "src", "dst").alias("way")
        )
        open_ = cut_lineage(ordered.groupBy("region_id", "u", "v").agg(F.min("way").alias("way")).select("region_id", "u", "v", "way.*"))
    kind = dict(edges.dtypes)["region_id"]
    rest = spread_groups(open_.select("region_id", F.col("u").alias("src"), F.col("v").alias("dst"), "dist"), ["region_id"])
    rest = rest.groupBy("region_id").applyInArrow(_forest_kernel, f"region_id {kind}, dist double")
    return rest if kept is None else kept.unionByName(rest)


def _connected_bars(points: DataFrame, most: int) -> DataFrame:
    """H0 bars of groups of any size: zeros for copies, the tree inside the Delaunay edges, and one that never ends."""
    key = F.to_json(F.struct(*GROUP)).alias("region_id")
    named = cut_lineage(points.select(key, *[F.col(k).alias(f"of_{k}") for k in GROUP], "cell_id", "x", "y"))
    groups = named.groupBy("region_id", *[f"of_{k}" for k in GROUP]).agg(F.count("*").alias("n"))
    spots = cut_lineage(spots_of(named))
    edges = cut_lineage(tiled_edges(spots, most))
    flat = spots.join(edges.select("region_id").distinct(), "region_id", "left_anti")
    along = Window.partitionBy("region_id").orderBy("x", "y")  # on one line, neighbours in order are the tree
    gap = F.sqrt((F.col("x") - F.lag("x").over(along)) ** 2 + (F.col("y") - F.lag("y").over(along)) ** 2)
    line = flat.select("region_id", gap.alias("dist")).where(F.col("dist").isNotNull())
    lengths = forest_lengths(edges, most).unionByName(line).select("region_id", F.col("dist").alias("death"))
    copies = groups.join(spots.groupBy("region_id").agg(F.count("*").alias("spots")), "region_id").select(
        "region_id", F.explode(F.array_repeat(F.lit(0.0), (F.col("n") - F.col("spots")).cast("int"))).alias("death")
    )
    never = groups.select("region_id", F.lit(None).cast("double").alias("death"))
    deaths = lengths.unionByName(copies).unionByName(never)
    return deaths.join(groups, "region_id").select(
        *[F.col(f"of_{k}").alias(k) for k in GROUP], F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), "death"
    )


def _apexes(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """First vertex joined to both ends of each ordered edge by earlier edges, -1 where there is none."""
    joined = [0] * n  # bit v of joined[u]: an edge u, v came before
    apex = np.full(len(i), -1, np.int32)
    for at in range(0, len(i), 65536):
        found = []
        for a, b in zip(i[at : at + 65536].tolist(), j[at : at + 65536].tolist()):
            both = joined[a] & joined[b]
            found.append((both & -both).bit_length() - 1)
            joined[a] |= 1 << b
            joined[b] |= 1 << a
        apex[at : at + 65536] = found
    return apex


def _loop_bars(dist: np.ndarray, i: np.ndarray, j: np.ndarray, lengths: np.ndarray, tree: list[int]) -> list[tuple[float, float]]:
    """Birth and death of one-dimensional classes of the Rips filtration, by cohomology over Z2.

    A triangle is named by its longest edge and the vertex opposite. An edge that is the longest of some triangle
    dies at once with the first of them. Only edges that are the longest of none, and not in the tree, start a loop;
    from the longest down, their set of triangles is reduced until its first triangle belongs to no other edge, which
    ends the loop. The set is never written out: sorted triangles of its edges wait in a heap, two alike cancel. Past the
    enclosing radius every loop is closed, so longer edges are left out.
    """
    n = dist.shape[0]
    if n < 4:
        return []
    kept = int(np.searchsorted(lengths, dist.max(axis=1).min(), side="right"))
    i, j = i[:kept], j[:kept]
    apex = _apexes(n, i, j)
    starts = np.flatnonzero(apex < 0)
    starts = starts[~np.isin(starts, tree)]
    if not starts.size:
        return []
    rank = np.full((n, n), kept, np.int32)
    rank[i, j] = rank[j, i] = np.arange(kept, dtype=np.int32)
    return _reduced(i, j, lengths, apex, rank, starts)


def _reduced(
    i: np.ndarray, j: np.ndarray, lengths: np.ndarray, apex: np.ndarray, rank: np.ndarray, starts: np.ndarray
) -> list[tuple[float, float]]:
    """Bars of the loops that the edges ``starts`` begin, by the reduction told of above."""
    n, kept = len(rank), len(apex)

    def triangles_on(e: int) -> np.ndarray:
        a, b = i[e], j[e]
        v = np.flatnonzero(np.maximum(rank[a], rank[b]) < kept)  # neither a nor b: the rank of no edge is ``kept``
        to_a, to_b = rank[a, v].astype(np.int64), rank[b, v]
        longer = np.maximum(to_a, to_b)
        return np.sort(np.where(longer < e, e * n + v, longer * n + np.where(to_a > to_b, b, a)))

    owner: dict[int, set[int]] = {}
    bars = []
    for e in starts[::-1].tolist():
        edges = {e}
        waiting = [_Run(triangles_on(e))]
        while (first := _first(waiting)) is not None:
            edge, opposite = divmod(first, n)
            if apex[edge] == opposite:
                added = {edge}
            elif first in owner:
                added = owner[first]
            else:
                owner[first] = edges
                if lengths[edge] > lengths[e]:
                    bars.append((float(lengths[e]), float(lengths[edge])))
                break
            edges = edges ^ added
            for other in added:
                heappush(waiting, _Run(triangles_on(other)))
    return bars


class _Run:
    """A sorted run of triangles in a heap, by the one it stands at."""

    def __init__(self, triangles: np.ndarray):
        self.triangles, self.at = triangles, 0
        self.now = int(triangles[0]) if triangles.size else _PAST

    def __lt__(self, other: _Run) -> bool:
        return self.now < other.now

    def step(self) -> None:
        self.at += 1
        self.now = int(self.triangles[self.at]) if self.at < self.triangles.size else _PAST


_PAST = 2**63


def _first(waiting: list[_Run]) -> int | None:
    """The first triangle that the runs hold an odd number of times; the runs stay at it."""
    while waiting:
        now, held = waiting[0].now, []
        if now == _PAST:
            return None
        while waiting and waiting[0].now == now:
            held.append(heappop(waiting))
        if len(held) % 2:
            for run in held:
                heappush(waiting, run)
            return now
        for run in held:
            run.step()
            heappush(waiting, run)
    return None


def _diagram_kernel(dims: tuple[int, ...]):
    def run(table: pa.Table) -> pa.Table:
        names = np.array(table["subset"].to_pylist(), dtype=object)
        ids = table["cell_id"].to_numpy()
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        subset, dim, birth, death = [], [], [], []
        for name in sorted(set(names)):
            rows = np.flatnonzero(names == name)
            if rows.size < 2:
                continue
            rows = rows[np.argsort(ids[rows], kind="stable")]
            grown = rows.size <= SEARCHED_POINTS and bool(np.isfinite(x[rows]).all() and np.isfinite(y[rows]).all())
            if dims == (0,) and (grown or rows.size > DENSE_POINTS):
                deaths = [*(_tree_lengths if grown else _sparse_tree_lengths)(x[rows], y[rows]).tolist(), None]
                subset += [name] * len(deaths)
                dim += [0] * len(deaths)
                birth += [0.0] * len(deaths)
                death += deaths
                continue
            dx, dy = x[rows, None] - x[None, rows], y[rows, None] - y[None, rows]
            dist = np.sqrt(dx * dx + dy * dy)
            ends = _edge_ranks(dist)
            tree = _tree_edges(rows.size, ends[0], ends[1])
            bars = []
            if 0 in dims:
                bars += [(0, 0.0, d) for d in ends[2][tree].tolist()] + [(0, 0.0, None)]
            if 1 in dims:
                bars += [(1, b, d) for b, d in _loop_bars(dist, *ends, tree)]
            subset += [name] * len(bars)
            dim += [b[0] for b in bars]
            birth += [b[1] for b in bars]
            death += [b[2] for b in bars]
        total = len(subset)
        return pa.table(
            {
                "region_id": pa.repeat(table["region_id"][0], total),
                "scope": pa.repeat(table["scope"][0], total),
                "subset": pa.array(subset, pa.string()),
                "dim": pa.array(dim, pa.int32()),
                "birth": pa.array(birth, pa.float64()),
                "death": pa.array(death, pa.float64()),
            }
        )

    return run


def _alike(px: np.ndarray, py: np.ndarray, dims: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Tree lengths (a row for each subset) and loops (subset, birth, death) of subsets of the same size, a row each."""
    count, n = px.shape
    some, (i, j) = np.arange(count), np.triu_indices(n, 1)
    dx, dy = px[:, i] - px[:, j], py[:, i] - py[:, j]
    lengths = np.sqrt(dx * dx + dy * dy)
    past = len(i)
    order = np.argsort(lengths, axis=1, kind="stable")
    lengths = np.take_along_axis(lengths, order, 1)
    place = np.empty(order.shape, np.int32)
    np.put_along_axis(place, order, np.arange(past, dtype=np.int32)[None, :], 1)
    rank = np.full((count, n, n), past, np.int32)
    rank[:, i, j] = place
    rank[:, j, i] = place
    tree = np.empty((count, n - 1), np.int64)
    nearest, reached = rank[:, 0].copy(), np.zeros((count, n), bool)
    reached[:, 0] = True
    for k in range(n - 1):  # the part grows by its shortest way out
        nearest[reached] = past
        v = nearest.argmin(axis=1)
        tree[:, k] = nearest[some, v]
        reached[some, v] = True
        nearest = np.minimum(nearest, rank[some, v])
    loops: list[tuple[int, float, float]] = []
    if 1 in dims and n >= 4:
        farthest = np.where(rank == past, -1, rank).max(axis=2).min(axis=1)
        kept = (lengths <= lengths[some, farthest][:, None]).sum(axis=1)
        i, j = i[order].astype(np.int32), j[order].astype(np.int32)
        earlier = np.maximum(rank[some[:, None], i], rank[some[:, None], j]) < np.arange(past)[None, :, None]
        apex = np.where(earlier.any(axis=2), earlier.argmax(axis=2), -1)
        starting = (apex < 0) & (np.arange(past)[None, :] < kept[:, None])
        np.put_along_axis(starting, tree, False, 1)
        for g in np.flatnonzero(starting.any(axis=1)).tolist():
            m = int(kept[g])
            found = _reduced(i[g, :m], j[g, :m], lengths[g], apex[g, :m], np.minimum(rank[g], m), np.flatnonzero(starting[g]))
            loops += [(g, birth, death) for birth, death in found]
    return np.take_along_axis(lengths, tree, 1), loops


def _diagrams_of(table: pa.Table, starts: np.ndarray, dims: tuple[int, ...]) -> pa.Table:
    """Bars of all subsets of a table in (group, cell id) order; ``starts`` are the first rows of the subsets."""
    x, y = table["x"].to_numpy(), table["y"].to_numpy()
    sizes = np.diff(np.append(starts, len(x)))
    rows, dim, birth, death = [], [], [], []

    def add(at: np.ndarray, of: int, births: np.ndarray, deaths: np.ndarray) -> None:
        rows.append(at)
        dim.append(np.full(len(at), of, np.int32))
        birth.append(births)
        death.append(deaths)

    for n in np.unique(sizes[sizes > 1]).tolist():
        same = starts[sizes == n]
        step = max(1, ALIKE_ENTRIES // (n * n * (n if 1 in dims else 2))) if n <= ALIKE_POINTS else 1
        for at in range(0, len(same), step):
            part = same[at : at + step]
            px, py = (v[part[:, None] + np.arange(n)] for v in (x, y))
            if n <= ALIKE_POINTS:
                lengths, loops = _alike(px, py, dims)
            else:
                dx, dy = px[0][:, None] - px[0][None, :], py[0][:, None] - py[0][None, :]
                dist = np.sqrt(dx * dx + dy * dy)
                ends = _edge_ranks(dist)
                tree = _tree_edges(n, ends[0], ends[1])
                lengths = ends[2][tree][None, :]
                loops = [(0, b, d) for b, d in _loop_bars(dist, *ends, tree)] if 1 in dims else []
            if 0 in dims:
                add(np.repeat(part, n - 1), 0, np.zeros(lengths.size), lengths.ravel())
                add(part, 0, np.zeros(len(part)), np.full(len(part), np.nan))
            if loops:
                group, births, deaths = (np.array(v) for v in zip(*loops))
                add(part[group], 1, births, deaths)
    if not rows:
        rows, dim, birth, death = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(0)]
    first = pa.array(np.concatenate(rows))
    columns = {k: table[k].combine_chunks().take(first) for k in GROUP}
    columns |= {"dim": pa.array(np.concatenate(dim)), "birth": pa.array(np.concatenate(birth))}
    return pa.table(columns | {"death": pa.array(np.concatenate(death), from_pandas=True)})


def diagrams(points: DataFrame, dims: tuple[int, ...] = (0, 1), bounds: SizeBounds = BOUNDS, together: bool = False) -> DataFrame:
    """Persistence bars (region_id, scope, subset, dim, birth, death) of the Rips filtration; death null = never.

    Small subsets are solved many at a time, those of equal size together; a larger one has its own task. Connected parts of larger subsets come from tiled
    Delaunay edges and joins. Loops need the matrix of all distances, so their largest subset is checked first. Points are
    never thinned. ``together`` says that the rows of a scope lie in one partition of a checkpoint, so that they need no shuffle.
    """
    biggest = largest_group(points, GROUP)
    if 1 in dims and biggest > bounds.diagram_points:
        raise ValueError(f"a subset has {biggest} points, more than the {bounds.diagram_points} one task may hold")
    kind = dict(points.dtypes)["region_id"]
    schema = f"region_id {kind}, scope string, subset string, dim int, birth double, death double"
    rows = points.select(*GROUP, "cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def bounded(groups: DataFrame) -> DataFrame:
        few, alone = groups, None
        if biggest > bounds.shared_points:
            sizes = groups.groupBy(*GROUP).agg((F.count("*") > bounds.shared_points).alias("is_alone"))
            sized = groups.join(sizes, GROUP)
            few, alone = sized.where(~F.col("is_alone")).drop("is_alone"), sized.where("is_alone").drop("is_alone")
        placed = together and few is groups
        found = (few.sortWithinPartitions(*GROUP, "cell_id") if placed else sorted_groups(few, GROUP, "cell_id")).mapInArrow(
            many_groups(GROUP, lambda table, starts: iter([_diagrams_of(table, starts, dims)])), schema
        )
        if alone is None:
            return found
        return found.unionByName(spread_groups(alone, GROUP).groupBy(*GROUP).applyInArrow(_diagram_kernel(dims), schema))

    if biggest <= bounds.tree_points or dims != (0,):
        return bounded(rows)
    sizes = rows.groupBy(*GROUP).agg((F.count("*") > bounds.tree_points).alias("is_large"))
    sized = rows.join(sizes, GROUP)
    small, large = sized.where(~F.col("is_large")).drop("is_large"), sized.where("is_large").drop("is_large")
    return bounded(small).unionByName(_connected_bars(large, bounds.tree_points))


def lifetimes(bars: DataFrame) -> DataFrame:
    """Finite bars of positive length, with their lifetime."""
    return bars.where(F.col("death").isNotNull() & (F.col("death") > F.col("birth"))).withColumn(
        "life", F.col("death") - F.col("birth")
    )


def persistence_totals(lives: DataFrame) -> DataFrame:
    return lives.groupBy(*DIAGRAM).agg(
        F.count("*").cast("double").alias("count"),
        F.sum("life").alias("total_persistence"),
        F.min("birth").alias("first_birth"),
        F.max("death").alias("last_death"),
    )


def persistence_entropy(lives: DataFrame, totals: DataFrame) -> DataFrame:
    share = F.col("life") / F.col("total_persistence")
    return lives.join(totals.select(*DIAGRAM, "total_persistence"), DIAGRAM).groupBy(*DIAGRAM).agg(
        F.sum(C.entropy_term(share)).alias("entropy")
    )


def curve_stats(lives: DataFrame, totals: DataFrame, grid_size: int = 32) -> DataFrame:
    """Betti curve (area, peak, mean), silhouette (mean, peak) on an even grid over the range, and the entropy.

    A bar changes the curves at three grid points only: where it begins, past its middle, and past its end. Between such
    points the Betti number stays and the silhouette is a line in t, so prefix sums over the points give both, and runs
    of grid points between them give areas, means and peaks. No bar is spread over the grid.
    """
    last = grid_size - 1
    wide = totals.where(F.col("last_death") > F.col("first_birth"))
    step = (F.col("last_death") - F.col("first_birth")) / F.lit(float(last))
    bars = lives.join(wide.select(*DIAGRAM, "first_birth", "last_death", "total_persistence"), DIAGRAM).withColumn("step", step)

    def at(i: Column) -> Column:
        return F.when(i >= last, F.col("last_death")).otherwise(i * F.col("step") + F.col("first_birth"))

    def place(value: Column) -> Column:
        return (value - F.col("first_birth")) / F.col("step")

    def settled(guess: Column, ahead: Callable[[Column], Column]) -> Column:
        """The first grid point that ``ahead`` holds for, from a guess that rounding may have moved by one."""
        return F.when(ahead(guess - 1) & (guess > 0), guess - 1).when(~ahead(guess), guess + 1).otherwise(guess)

    bars = bars.withColumns(
        {
            "low": settled(F.ceil(place(F.col("birth"))), lambda i: at(i) >= F.col("birth")),
            "past": F.when(F.col("death") >= F.col("last_death"), F.lit(grid_size).cast("long")).otherwise(
                settled(F.floor(place(F.col("death"))) + 1, lambda i: at(i) > F.col("death"))
            ),
            "middle": F.floor(place((F.col("birth") + F.col("death")) / 2)) + 1,
            "weight": F.col("life") / F.greatest(F.col("total_persistence"), F.lit(1e-12)),
            "share": C.entropy_term(F.col("life") / F.col("total_persistence")),
        }
    ).withColumn("middle", F.least(F.greatest("middle", "low"), "past"))
    w, none = F.col("weight"), F.lit(0.0)

    def event(i: str, alive: float, height: Column, slope: Column, share: Column) -> Column:
        return F.struct(F.col(i).alias("i"), F.lit(alive).alias("alive"), height.alias("height"), slope.alias("slope"), share.alias("share"))

    seen = F.array(
        event("low", 1.0, -w * F.col("birth"), w, F.col("share")),
        event("middle", 0.0, w * (F.col("birth") + F.col("death")), -2.0 * w, none),
        event("past", -1.0, -w * F.col("death"), w, none),
    )
    unseen = F.array(F.struct(F.lit(0).cast("long").alias("i"), none.alias("alive"), none.alias("height"), none.alias("slope"), F.col("share").alias("share")))
    events = bars.select(*DIAGRAM, "step", "first_birth", F.explode(F.when(F.col("low") < F.col("past"), seen).otherwise(unseen)).alias("e"))
    summed = events.groupBy(*DIAGRAM, "e.i").agg(
        F.first("step").alias("step"), F.first("first_birth").alias("origin"), *[F.sum(f"e.{c}").alias(c) for c in ("alive", "height", "slope", "share")]
    )
    along = Window.partitionBy(*DIAGRAM).orderBy("i")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    runs = summed.withColumns({c: F.sum(c).over(so_far) for c in ("alive", "height", "slope")}).withColumn(
        "end", F.coalesce(F.lead("i").over(along), F.lit(grid_size).cast("long"))
    )
    points = F.greatest(F.least("end", F.lit(grid_size)) - F.col("i"), F.lit(0)).cast("double")
    middle_t = F.col("origin") + F.col("step") * (F.col("i") + F.col("end") - 1) / 2.0
    line = lambda i: F.when(points > 0, F.col("height") + F.col("slope") * (F.col("origin") + F.col("step") * i))
    ends = F.when(F.col("i") == 0, 0.5).otherwise(0.0) + F.when((F.col("end") == grid_size) & (points > 0), 0.5).otherwise(0.0)
    share_of = float(grid_size)
    return runs.groupBy(*DIAGRAM).agg(
        F.sum(F.col("alive") * (points - ends) * F.col("step")).alias("betti_area"),
        F.greatest(F.max(F.when(points > 0, F.col("alive"))), F.lit(0.0)).alias("betti_peak"),
        (F.sum(F.col("alive") * points) / share_of).alias("betti_mean"),
        F.greatest(F.sum((F.col("height") + F.col("slope") * middle_t) * points) / share_of, F.lit(0.0)).alias("silhouette_mean"),
        F.greatest(F.max(F.greatest(line(F.col("i")), line(F.col("end") - 1))), F.lit(0.0)).alias("silhouette_peak"),
        F.sum("share").alias("entropy"),
    )


def top_lifetimes(lives: DataFrame, k: int = 3) -> DataFrame:
    """The k longest lifetimes of each diagram with their rank."""
    order = Window.partitionBy(*DIAGRAM).orderBy(F.desc("life"), "birth")
    return lives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*DIAGRAM, "rank", "life")


def summary_names(k: int = 3, dims: tuple[int, ...] = (0, 1)) -> list[str]:
    stats = [*SUMMARY_STATS, *[f"top_lifetime_{i + 1}" for i in range(k)]]
    return [f"{s}_h{d}_{stat}" for s in SUBSET_ROLES for d in dims for stat in stats]


def diagram_summary(
    bars: DataFrame, scopes: DataFrame, grid_size: int = 32, k: int = 3, dims: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """Long rows (region_id, scope, name, value) for every scope, subset and dimension; absent values are 0."""
    return _named(summary_rows(bars, scopes, grid_size, k, dims), ["region_id", "scope"], k)


def summary_rows(
    bars: DataFrame, scopes: DataFrame, grid_size: int = 32, k: int = 3, dims: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """One row (region_id, scope, subset, dim) with a column a statistic, for every scope, subset and dimension; absent values are 0.

    The bars are written once: each statistic below is its own aggregate over them.
    """
    lives = lifetimes(cut_lineage(bars))
    totals = persistence_totals(lives)
    top = top_lifetimes(lives, k).groupBy(*DIAGRAM).agg(
        *[F.max(F.when(F.col("rank") == i + 1, F.col("life"))).alias(f"top_lifetime_{i + 1}") for i in range(k)]
    )
    found = (
        totals.join(curve_stats(lives, totals, grid_size), DIAGRAM, "left")
        .join(top, DIAGRAM, "left")
    )
    every = (
        scopes.select("region_id", "scope").distinct()
        .withColumn("subset", F.explode(F.array(*[F.lit(s) for s in SUBSET_ROLES])))
        .withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))
    )
    return every.join(found, DIAGRAM, "left").select(*DIAGRAM, *[C.finite_or(F.col(s)).alias(s) for s in _stats(k)])


def _stats(k: int) -> list[str]:
    return [*SUMMARY_STATS, *[f"top_lifetime_{i + 1}" for i in range(k)]]


def _named(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows with a column a statistic as long rows (keys, name, value)."""
    values = F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("v")) for s in _stats(k)])
    name = F.concat("subset", F.lit("_h"), F.col("dim").cast("string"), F.lit("_"), F.col("e.s"))
    return rows.select(*keys, "subset", "dim", F.explode(values).alias("e")).select(*keys, name.alias("name"), F.col("e.v").alias("value"))


def _patch_stats(rows: DataFrame, k: int) -> DataFrame:
    """``patch_rollup`` of summary rows whose regions have few enough patches to be listed: (region_id, name, value).

    A patch is one row here and not one for each of its statistics, so a tenth of the rows is shuffled and none is sorted by name.
    """
    names = _stats(k)
    lists = [F.sort_array(F.collect_list(s)).alias(f"{s}_list") for s in names]
    spread = [f(s).alias(f"{s}_{n}") for s in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    whole = rows.groupBy("region_id", "subset", "dim").agg(*lists, *spread)

    def quantile(s: str, p: float) -> Column:
        place = F.lit(p) * (F.size(f"{s}_list") - 1)
        low, high = (F.get(f"{s}_list", f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    of = {f"{s}_{n}": F.col(f"{s}_{n}") for s in names for n in ("mean", "std")} | {f"{s}_{n}": quantile(s, p) for s in names for n, p in (("q25", 0.25), ("q75", 0.75))}
    entries = F.array(*[F.struct(F.lit(n).alias("stat"), v.alias("value")) for n, v in of.items()])  # exploded, as an unpivot forgets that rows lie by region
    long = whole.select("region_id", "subset", "dim", F.explode(entries).alias("e")).select("region_id", "subset", "dim", "e.stat", "e.value")
    title = F.concat(F.lit("patch_"), "subset", F.lit("_h"), F.col("dim").cast("string"), F.lit("_"), "stat")
    return long.select("region_id", title.alias("name"), C.finite_or(F.col("value")).alias("value"))


def topology_features(
    normalized: DataFrame, settings: FeatureSettings = FeatureSettings(), bounds: SizeBounds = BOUNDS, dims: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """Summaries over the whole region, and their roll-up over its patches, as (region_id, name, value)."""
    return reduce(DataFrame.unionByName, topology_parts(normalized, settings, bounds, dims))


def topology_parts(
    normalized: DataFrame, settings: FeatureSettings = FeatureSettings(), bounds: SizeBounds = BOUNDS, dims: tuple[int, ...] = (0, 1)
) -> list[DataFrame]:
    """``topology_features`` of regions and of their patches, each of which lies by region, so that a join by region shuffles none of it.

    Region and patch scopes go through one pass: one diagram job, one summary.
    """
    bounds = measured(normalized, bounds)
    core = normalized.select("region_id", "cell_id", "cell_type", "x", "y")
    patches = assign_patches(core, settings.patch_size, settings.min_patch_cells)
    # A cell is shuffled once for each of its two scopes here, and not once for each of their subsets.
    scoped = cut_lineage(spread_groups(core.withColumn("scope", F.lit("region")).unionByName(patches), [F.xxhash64("region_id", "scope")]))
    bars = diagrams(subset_points(scoped, settings.role_terms), dims, bounds, together=True)
    k = settings.top_k_lifetimes
    rows = cut_lineage(summary_rows(bars, scoped.select("region_id", "scope"), settings.grid_size, k, dims))
    # Placed by region before they become many: the roll-up and the join with the regions' metadata take them where they are.
    whole = _named(spread_groups(rows.where(F.col("scope") == "region"), ["region_id"]), ["region_id"], k)
    patched = spread_groups(rows.where(F.col("scope") != "region"), ["region_id"])
    if bounds.largest_region <= bounds.percentile_rows:  # a region has fewer patches than cells
        return [whole, _patch_stats(patched, k)]
    return [whole, patch_rollup(_named(patched, ["region_id"], k), "patch", bounds)]
