"""Delaunay edges inside regions."""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.operators.neighbors import _nearest_rows, knn, mutual, spread_groups
from cytoplane.session import cut_lineage, group_size, largest_group
from cytoplane.settings import BOUNDS, SizeBounds

FRONT_ENTRIES = 100_000  # edges times points that are compared at once


class _Buckets:
    """Points of one region in square buckets of about four, to look near a spot only."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.left, self.bottom = float(x.min()), float(y.min())
        self.right, self.top = float(x.max()), float(y.max())
        spread = max((self.right - self.left) * (self.top - self.bottom), 1e-300)
        longest = max(self.right - self.left, self.top - self.bottom)
        self.side = max(math.sqrt(4.0 * spread / x.size), longest / 4096, 1e-300)
        self.rows = int((self.top - self.bottom) / self.side) + 1
        self.columns = int((self.right - self.left) / self.side) + 1
        bucket = self._column(x).astype(np.int64) * self.rows + self._row(y).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.starts = np.searchsorted(bucket[self.order], np.arange(self.rows * self.columns + 1))

    def _column(self, x):
        return np.clip(np.floor((x - self.left) / self.side), 0, self.columns - 1)

    def _row(self, y):
        return np.clip(np.floor((y - self.bottom) / self.side), 0, self.rows - 1)

    def covers(self, x0: float, x1: float, y0: float, y1: float) -> bool:
        return x0 <= self.left and x1 >= self.right and y0 <= self.bottom and y1 >= self.top

    def within(self, x0: float, x1: float, y0: float, y1: float) -> np.ndarray:
        """Positions, ascending, of a superset of the points in the box."""
        first, last = int(self._row(y0)), int(self._row(y1))
        parts = []
        for column in range(int(self._column(x0)), int(self._column(x1)) + 1):
            base = column * self.rows
            parts.append(self.order[self.starts[base + first] : self.starts[base + last + 1]])
        return np.sort(np.concatenate(parts))


def _left_of(x: np.ndarray, y: np.ndarray, a: int, b: int, c: int) -> Fraction:
    """Exactly twice the area of a, b, c: positive where c is left of the line from a to b."""
    ax, ay, bx, by, cx, cy = (Fraction(float(v)) for k in (a, b, c) for v in (x[k], y[k]))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _inside(x: np.ndarray, y: np.ndarray, a: int, b: int, c: int, d: int) -> Fraction:
    """Exactly the in-circle determinant: positive where d is inside the circle of a, b, c (in left turn), 0 on it."""
    dx, dy = Fraction(float(x[d])), Fraction(float(y[d]))
    rows = []
    for k in (a, b, c):
        u, v = Fraction(float(x[k])) - dx, Fraction(float(y[k])) - dy
        rows.append((u, v, u * u + v * v))
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = rows
    return a1 * (b2 * c3 - b3 * c2) - a2 * (b1 * c3 - b3 * c1) + a3 * (b1 * c2 - b2 * c1)


def delaunay_pairs(x: np.ndarray, y: np.ndarray, all_pairs_below: int = 400) -> set[tuple[int, int]]:
    """Edges (smaller position first) of the Delaunay triangulation of distinct points; empty for collinear input."""
    triangles, _ = delaunay_triangles(x, y, all_pairs_below)
    return {(min(u, v), max(u, v)) for a, b, c in triangles for u, v in ((a, b), (b, c), (c, a))}


def delaunay_triangles(
    x: np.ndarray, y: np.ndarray, all_pairs_below: int = 400
) -> tuple[list[tuple[int, int, int]], set[int]]:
    """Triangles of distinct points and the points on their hull, found by growing triangles over open edges.

    For an oriented edge the next vertex is the point on its left whose circle reaches least far to the left. Signs and
    comparisons that lie within the rounding error of their floats are settled exactly. Points on one circle are joined
    as a fan from the first of them, seen alike from every edge. Larger sets look in a window around the edge, and again
    in the box of the circle found if that sticks out, as only a point inside the circle could be better. Empty for
    collinear input.
    """
    everyone = np.arange(x.size)
    buckets = _Buckets(x, y) if x.size > all_pairs_below else None
    unit = 16 * np.finfo(float).eps

    def best(a: int, b: int, among: np.ndarray) -> tuple[int, float, bool]:
        """Vertex, its reach, and whether others share its circle."""
        ax, ay, bx, by = x[among] - x[a], y[among] - y[a], x[among] - x[b], y[among] - y[b]
        ex, ey = x[b] - x[a], y[b] - y[a]
        left = ex * ay - ey * ax
        slack = unit * (np.abs(ex * ay) + np.abs(ey * ax))
        sure = left > slack
        for k in np.flatnonzero((np.abs(left) <= slack) & (among != a) & (among != b)):
            sure[k] = _left_of(x, y, a, b, int(among[k])) > 0
        ahead = np.flatnonzero(sure)
        if ahead.size == 0:
            return -1, math.nan, False
        wide = left[ahead] > 2 * slack[ahead]
        area = np.where(wide, left[ahead], 1.0)
        reach = (ax[ahead] * bx[ahead] + ay[ahead] * by[ahead]) / area
        error = (unit * (np.abs(ax[ahead] * bx[ahead]) + np.abs(ay[ahead] * by[ahead])) + np.abs(reach) * slack[ahead]) / area * 2
        low, high = np.where(wide, reach - error, -np.inf), np.where(wide, reach + error, np.inf)
        close = np.flatnonzero(low <= high.min())
        at = int(close[np.argmin(high[close])])
        tied = [at]
        for k in close.tolist():
            if k != at:
                sign = _inside(x, y, a, b, int(among[ahead[at]]), int(among[ahead[k]]))
                if sign > 0:
                    at, tied = k, [k]
                elif sign == 0:
                    tied.append(k)
        at = min(tied, key=lambda k: among[ahead[k]])
        return int(among[ahead[at]]), float(reach[at]) if wide[at] else math.nan, len(tied) > 1

    def fan(a: int, b: int, c: int, among: np.ndarray) -> int:
        """The vertex left of a, b in the fan of the points on the circle of a, b, c."""
        cx, cy = centre(a, b, c)
        square = (x[a] - cx) ** 2 + (y[a] - cy) ** 2
        near = np.abs((x[among] - cx) ** 2 + (y[among] - cy) ** 2 - square) <= 1e-6 * square
        ring = {a, b, c, *(k for k in among[near].tolist() if k not in (a, b, c) and _inside(x, y, a, b, c, k) == 0)}
        first = min(ring)
        if first not in (a, b):
            return first
        left = [k for k in ring if k not in (a, b) and _left_of(x, y, a, b, k) > 0]
        k = left[0]  # next along the circle to the end that is not the fan's first: no other lies between
        for j in left[1:]:
            if (_left_of(x, y, b, k, j) if first == a else _left_of(x, y, k, a, j)) < 0:
                k = j
        return k

    def centre(a: int, b: int, c: int) -> tuple[float, float]:
        ux, uy, vx, vy = (Fraction(float(v)) for v in (x[b], y[b], x[c], y[c]))
        ax, ay = Fraction(float(x[a])), Fraction(float(y[a]))
        ux, uy, vx, vy = ux - ax, uy - ay, vx - ax, vy - ay
        d, u, v = 2 * (ux * vy - uy * vx), ux * ux + uy * uy, vx * vx + vy * vy
        return float(ax + (vy * u - uy * v) / d), float(ay + (ux * v - vx * u) / d)

    def within_circle(a: int, b: int, c: int) -> np.ndarray:
        if buckets is None:
            return everyone
        cx, cy = centre(a, b, c)
        r = math.hypot(cx - x[a], cy - y[a]) * (1 + 1e-6)
        return buckets.within(cx - r, cx + r, cy - r, cy + r)

    def third(a: int, b: int) -> int:
        if buckets is None:
            c, _, tied = best(a, b, everyone)
            return fan(a, b, c, everyone) if tied else c
        mx, my = (x[a] + x[b]) / 2, (y[a] + y[b]) / 2
        half = max(2.0 * math.hypot(x[b] - x[a], y[b] - y[a]), 2.0 * buckets.side)
        while True:
            window = (mx - half, mx + half, my - half, my + half)
            c, reach, tied = best(a, b, buckets.within(*window))
            if c >= 0:
                break
            if buckets.covers(*window):
                return -1
            half *= 4.0
        cx, cy = (mx - reach / 2 * (y[b] - y[a]), my + reach / 2 * (x[b] - x[a])) if math.isfinite(reach) else centre(a, b, c)
        r = math.hypot(cx - x[a], cy - y[a]) * (1 + 1e-9)
        if not (cx - r >= window[0] and cx + r <= window[1] and cy - r >= window[2] and cy + r <= window[3]):
            c, _, tied = best(a, b, within_circle(a, b, c))
        return fan(a, b, c, within_circle(a, b, c)) if tied else c

    def thirds(edges: list[tuple[int, int]]) -> list[int]:
        """``third`` of many edges at once; those that need an exact comparison are asked alone."""
        if buckets is not None:
            return [third(a, b) for a, b in edges]
        out: list[int] = []
        step = max(1, FRONT_ENTRIES // x.size)
        for k in range(0, len(edges), step):
            a, b = np.array(edges[k : k + step]).T
            ax, ay, bx, by = x - x[a, None], y - y[a, None], x - x[b, None], y - y[b, None]
            ex, ey = (x[b] - x[a])[:, None], (y[b] - y[a])[:, None]
            u, v = ex * ay, ey * ax
            left, slack = u - v, unit * (np.abs(u) + np.abs(v))
            ahead = left > slack
            narrow = (left <= 2 * slack) & (left >= -slack)
            rows = np.arange(len(a))
            narrow[rows, a] = narrow[rows, b] = False
            area = np.where(ahead, left, 1.0)
            p, q = ax * bx, ay * by
            reach = (p + q) / area
            error = (unit * (np.abs(p) + np.abs(q)) + np.abs(reach) * slack) / area * 2
            high = np.where(ahead, reach + error, np.inf)
            close = ahead & (reach - error <= high.min(axis=1)[:, None])
            found = np.where(ahead.any(axis=1), high.argmin(axis=1), -1)
            alone = narrow.any(axis=1) | (close.sum(axis=1) > 1)
            out += [third(int(a[i]), int(b[i])) if alone[i] else int(found[i]) for i in rows]
        return out

    near = (x[1:] - x[0]) ** 2 + (y[1:] - y[0]) ** 2
    start = (0, int(np.argmin(near)) + 1)
    waiting = deque([start, start[::-1]])
    closed: set[tuple[int, int]] = set()
    triangles: list[tuple[int, int, int]] = []
    hull: set[int] = set()
    known: dict[tuple[int, int], int] = {}
    while waiting:
        a, b = waiting.popleft()
        if (a, b) in closed:
            continue
        if (a, b) not in known:  # the whole front is asked at once
            front = [(a, b), *dict.fromkeys(e for e in waiting if e not in closed and e != (a, b))]
            known = dict(zip(front, thirds(front), strict=True))
        c = known[a, b]
        if c < 0:
            closed.add((a, b))
            hull.update((a, b))
            continue
        triangles.append((a, b, c))
        for u, v in ((a, b), (b, c), (c, a)):
            closed.add((u, v))
            if (v, u) not in closed:
                waiting.append((v, u))
    return triangles, hull


def _mutual_pairs(x: np.ndarray, y: np.ndarray, k: int) -> set[tuple[int, int]]:
    """Mutual k-NN pairs of a collinear set. Along the line the k nearest lie among the k next on either side."""
    if x.size > 2000:
        order = np.lexsort((np.arange(x.size), y, x))
        gaps, ends = [], []
        for shift in range(-k, k + 1):
            if shift:
                other = np.roll(order, -shift)
                d = np.hypot(x[order] - x[other], y[order] - y[other])
                wrapped = np.arange(x.size) + shift
                d[(wrapped < 0) | (wrapped >= x.size)] = np.inf
                gaps.append(d)
                ends.append(other)
        gap, end = np.stack(gaps, 1), np.stack(ends, 1)
        by_id = np.argsort(end, axis=1, kind="stable")
        gap, end = np.take_along_axis(gap, by_id, 1), np.take_along_axis(end, by_id, 1)
        rows, cols, _ = _nearest_rows(gap, k)
        directed = set(zip(order[rows].tolist(), end[rows, cols].tolist()))
        return {(i, j) for i, j in directed if i < j and (j, i) in directed}
    dist = np.sqrt((x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2)
    np.fill_diagonal(dist, np.inf)
    rows, cols, _ = _nearest_rows(dist, k)
    directed = set(zip(rows.tolist(), cols.tolist()))
    return {(i, j) for i, j in directed if i < j and (j, i) in directed}


def _kernel(table: pa.Table) -> pa.Table:
    id_column = table["cell_id"].combine_chunks()
    order = np.argsort(table["cell_id"].to_numpy(), kind="stable")
    x, y = (table[c].to_numpy()[order] for c in ("x", "y"))
    if x.size < 3:
        pairs = _mutual_pairs(x, y, 2) if x.size == 2 else set()
    else:
        spots = np.sort(np.unique(np.stack([x, y], axis=1), axis=0, return_index=True)[1])
        found = delaunay_pairs(x[spots], y[spots]) if spots.size > 2 else set()
        pairs = {(int(spots[i]), int(spots[j])) for i, j in found} or _mutual_pairs(x, y, 3)
    ends = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    dist = np.sqrt((x[ends[:, 0]] - x[ends[:, 1]]) ** 2 + (y[ends[:, 0]] - y[ends[:, 1]]) ** 2)
    return pa.table(
        {
            "region_id": pa.repeat(table["region_id"][0], len(ends)),
            "src": id_column.take(pa.array(order[ends[:, 0]])),
            "dst": id_column.take(pa.array(order[ends[:, 1]])),
            "dist": pa.array(dist),
        }
    )


_FOUND = (
    "region_id {region}, kind int, a {cell}, b {cell}, c {cell}, sides array<double>, mixed array<boolean>, "
    "x double, y double, owners array<long>"
)
SURE, OPEN, BORDER = 0, 1, 2


def _sure(x: np.ndarray, y: np.ndarray, corners: np.ndarray, box: tuple[float, ...]) -> np.ndarray:
    """Whether each triangle's circle lies within the box (left, right, bottom, top) for certain; slivers never do."""
    a, b, c = corners.T
    ux, uy, vx, vy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
    area = 2 * (ux * vy - uy * vx)
    wide = np.abs(area) > 2e-6 * (np.abs(ux * vy) + np.abs(uy * vx))
    area = np.where(wide, area, 1.0)
    u, v = ux * ux + uy * uy, vx * vx + vy * vy
    px, py = (vy * u - uy * v) / area, (ux * v - vx * u) / area
    lost = 1e-14 * ((np.abs(vy) + np.abs(vx)) * u + (np.abs(uy) + np.abs(ux)) * v) / np.abs(area)
    lost += 1e-14 * max(np.abs(x).max(), np.abs(y).max())
    r = np.hypot(px, py) * (1 + 1e-7) + 4 * lost
    cx, cy = x[a] + px, y[a] + py
    left, right, bottom, top = box
    return wide & (cx - r > left) & (cx + r < right) & (cy - r > bottom) & (cy + r < top)


def _triangle_kernel(whole: bool):
    """Triangles of one group of distinct points as SURE or OPEN rows, and the BORDER points that others may still join.

    A triangle is sure if its closed circle stays inside the tile, so no point elsewhere can touch it. With ``whole``
    the group is the full set and everything is sure. ``mixed`` says, for each level of tiles, whether the corners come
    from different ones.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = table["cell_id"].combine_chunks()
        order = np.argsort(table["cell_id"].to_numpy(), kind="stable")
        x, y = (table[c].to_numpy()[order] for c in ("x", "y"))
        owners = np.array(table["owners"].to_pylist(), np.int64).reshape(x.size, -1)[order]
        triangles, hull = delaunay_triangles(x, y) if x.size > 2 else ([], set())
        corners = np.sort(np.array(triangles, np.int64).reshape(-1, 3), axis=1)
        a, b, c = corners.T
        if whole:
            sure, border = np.ones(len(corners), bool), np.zeros(0, np.int64)
        else:
            sure = _sure(x, y, corners, tuple(table[k][0].as_py() for k in ("x_from", "x_to", "y_from", "y_to")))
            border = np.unique([*corners[~sure].ravel().tolist(), *hull]).astype(np.int64) if triangles else np.arange(x.size)

        def padded(values: pa.Array) -> pa.Array:
            return pa.concat_arrays([values, pa.nulls(len(border), values.type)])

        def named(at: np.ndarray) -> pa.Array:
            return ids.take(pa.array(order[at]))

        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))

        sides = np.stack([np.sqrt((x[u] - x[v]) ** 2 + (y[u] - y[v]) ** 2) for u, v in ((a, b), (a, c), (b, c))], axis=1)
        mixed = (owners[a] != owners[b]) | (owners[a] != owners[c])
        none = len(corners)
        return pa.table(
            {
                "region_id": pa.repeat(table["region_id"][0], none + len(border)),
                "kind": pa.array(np.concatenate([np.where(sure, SURE, OPEN), np.full(len(border), BORDER)]), pa.int32()),
                "a": pa.concat_arrays([named(a), named(border)]),
                "b": padded(named(b)),
                "c": padded(named(c)),
                "sides": padded(lists(sides, pa.float64())),
                "mixed": padded(lists(mixed, pa.bool_())),
                "x": pa.concat_arrays([pa.nulls(none, pa.float64()), pa.array(x[border])]),
                "y": pa.concat_arrays([pa.nulls(none, pa.float64()), pa.array(y[border])]),
                "owners": pa.concat_arrays([pa.nulls(none, pa.list_(pa.int64())), lists(owners[border], pa.int64())]),
            }
        )

    return run


def _cut(points: DataFrame, keys: list[str], axis: str, parts: Column) -> DataFrame:
    """Adds the slice of each point along the axis (``axis_part``) and its bounds; slices of a group hold about as many.

    ``parts`` is the wanted number of slices of a group from its number of points ``n``. The cuts are approximate
    percentiles at the resolution of the largest group; a slice runs from its cut, included, to the next.
    """
    wanted = points.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, parts.cast("int").alias("parts"))
    most = wanted.agg(F.max("parts")).first()[0] or 1
    if most == 1:
        cuts = wanted.select(*keys, F.expr("cast(array() as array<double>)").alias("cuts"))
    else:
        found = points.groupBy(*keys).agg(F.percentile_approx(axis, [k / most for k in range(1, most)], 100 * most).alias("every"))
        step = F.greatest(F.floor(F.lit(most) / F.col("parts")), F.lit(1))
        cuts = found.join(wanted, keys).withColumn("step", step).select(
            *keys, F.expr("array_distinct(filter(every, (v, i) -> (i + 1) % step = 0))").alias("cuts")
        )
    part = F.expr(f"size(filter(cuts, v -> {axis} >= v))")
    return points.join(cuts, keys).withColumn(f"{axis}_part", part).withColumns(
        {
            f"{axis}_from": F.coalesce(F.get("cuts", F.col(f"{axis}_part") - 1), F.lit(-math.inf)),
            f"{axis}_to": F.coalesce(F.get("cuts", F.col(f"{axis}_part")), F.lit(math.inf)),
        }
    ).drop("cuts")


def _triangles(points: DataFrame, most: int, before: int | None = None) -> DataFrame:
    """Triangles (region_id, a, b, c, sides, mixed) of distinct points (region_id, cell_id, x, y, owners).

    Sets of more than ``most`` points are cut into tiles. A triangle whose circle stays inside its tile is final. The
    corners of all others and of the tiles' hulls, some multiple of the tiles' circumference, are triangulated again as
    one set: of its triangles those that join tiles are final, and those within one tile if that tile found them too. A
    set that hardly shrinks this way (nearly all points on one line or curve) is triangulated as it is.
    """
    kind = dict(points.dtypes)
    schema = _FOUND.format(region=kind["region_id"], cell=kind["cell_id"])
    triangle = ["region_id", "a", "b", "c", "sides", "mixed"]
    biggest = largest_group(points, ["region_id"])
    if biggest <= most or before is not None and biggest > 0.9 * before:
        return spread_groups(points, ["region_id"]).groupBy("region_id").applyInArrow(_triangle_kernel(True), schema).select(*triangle)
    tiled = _cut(points, ["region_id"], "x", F.ceil(F.sqrt(F.col("n") / most)))
    tiled = _cut(tiled, ["region_id", "x_part"], "y", F.ceil(F.col("n") / most))
    tiled = tiled.withColumn("owners", F.concat("owners", F.array(F.shiftleft(F.col("x_part").cast("long"), 32) + F.col("y_part"))))
    tile = ["region_id", "x_part", "y_part"]
    found = cut_lineage(spread_groups(tiled, tile).groupBy(*tile).applyInArrow(_triangle_kernel(False), schema))
    border = found.where(F.col("kind") == BORDER).select("region_id", F.col("a").alias("cell_id"), "x", "y", "owners")
    again = cut_lineage(_triangles(border, most, biggest))
    joining = again.where(F.element_at("mixed", -1))
    agreed = again.where(~F.element_at("mixed", -1)).join(
        found.where(F.col("kind") == OPEN).select("region_id", "a", "b", "c"), ["region_id", "a", "b", "c"], "left_semi"
    )
    final = found.where(F.col("kind") == SURE).select(*triangle).unionByName(joining).unionByName(agreed)
    return final.withColumn("mixed", F.slice("mixed", F.lit(1), F.size("mixed") - 1))


def spots_of(cells: DataFrame) -> DataFrame:
    """The first cell of every spot."""
    return cells.groupBy("region_id", "x", "y").agg(F.min("cell_id").alias("cell_id"))


def tiled_edges(spots: DataFrame, most: int) -> DataFrame:
    """Delaunay edges (region_id, src < dst, dist) of regions of any size; none for a collinear region."""
    found = _triangles(spots.select("region_id", "cell_id", "x", "y", F.expr("cast(array() as array<bigint>)").alias("owners")), most)
    ends = [F.struct(F.col(u).alias("src"), F.col(v).alias("dst"), F.get("sides", k).alias("dist")) for k, (u, v) in enumerate(("ab", "ac", "bc"))]
    edges = found.select("region_id", F.inline(F.array(*ends)))
    return edges.groupBy("region_id", "src", "dst").agg(F.min("dist").alias("dist"))


def delaunay_edges(cells: DataFrame, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Undirected Delaunay edges per region (src < dst).

    Two cells are joined directly; a collinear region falls back to mutual 3-NN; of cells at one spot only the
    first is triangulated. A region within the bound is one task; larger ones are cut into tiles, with the same edges.
    """
    kind = dict(cells.dtypes)
    schema = f"region_id {kind['region_id']}, src {kind['cell_id']}, dst {kind['cell_id']}, dist double"
    points = cells.selectExpr("region_id", "cell_id", "cast(x as double) x", "cast(y as double) y")
    if group_size(cells, ["region_id"], bounds) <= bounds.triangulation_cells:
        return spread_groups(points, ["region_id"]).groupBy("region_id").applyInArrow(_kernel, schema)
    sizes = points.groupBy("region_id").agg((F.count("*") > bounds.triangulation_cells).alias("is_large"))
    sized = points.join(sizes, "region_id")
    small = sized.where(~F.col("is_large")).drop("is_large")
    large = sized.where("is_large").drop("is_large")
    edges = cut_lineage(tiled_edges(spots_of(large), bounds.triangulation_cells))
    flat = large.join(edges.select("region_id").distinct(), "region_id", "left_anti")
    line = mutual(knn(flat, 3, bounds=bounds)).select("region_id", "src", "dst", "dist")
    near = spread_groups(small, ["region_id"]).groupBy("region_id").applyInArrow(_kernel, schema)
    return near.unionByName(edges).unionByName(line)
