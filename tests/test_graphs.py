import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.operators import graphs, region_graphs, triangulation
from cytoplane.operators import neighbors as N
from cytoplane.operators.triangulation import delaunay_edges, delaunay_pairs
from cytoplane.settings import RegionGraphSettings, SizeBounds


def empty_circle_pairs(x, y):
    """Edges having a circle through both ends with no other point inside."""
    out = set()
    for a, b in itertools.combinations(range(len(x)), 2):
        low, high, open_ = -np.inf, np.inf, True
        for c in range(len(x)):
            if c in (a, b):
                continue
            turn = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
            dot = (x[c] - x[a]) * (x[c] - x[b]) + (y[c] - y[a]) * (y[c] - y[b])
            if turn > 0:
                high = min(high, dot / turn)
            elif turn < 0:
                low = max(low, dot / turn)
            elif dot < 0:
                open_ = False
        if open_ and low < high:
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_delaunay_matches_empty_circles(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.random(40), rng.random(40) ** 2
    assert delaunay_pairs(x, y) == empty_circle_pairs(x, y)


def test_bucketed_delaunay_equals_the_plain_one():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.random(700) * 100, rng.normal(50, 0.1, 300)])
    y = np.concatenate([rng.random(700) * 3, rng.normal(1, 0.1, 300)])
    assert delaunay_pairs(x, y) == delaunay_pairs(x, y, all_pairs_below=10_000)


def hull_size(points):
    """Points on the convex hull, those on its sides included, in exact arithmetic."""
    from fractions import Fraction

    p = sorted((Fraction(float(x)), Fraction(float(y))) for x, y in points)

    def chain(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) < (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return len({*chain(p), *chain(p[::-1])})


def difficult_points():
    rng = np.random.default_rng(0)
    grid = np.stack(np.meshgrid(np.arange(18.0), np.arange(18.0)), -1).reshape(-1, 2)
    turn = np.array([[np.cos(0.7), -np.sin(0.7)], [np.sin(0.7), np.cos(0.7)]])
    circle = [(3, 4), (4, 3), (5, 0), (4, -3), (3, -4), (0, -5), (-3, -4), (-4, -3), (-5, 0), (-4, 3), (-3, 4), (0, 5)]
    yield grid
    yield grid @ turn
    yield np.concatenate([rng.normal(0, 1e-5, (250, 2)), rng.uniform(-0.5, 0.5, (60, 2))])
    yield np.concatenate([rng.uniform(0, 1, (200, 2)), [[1e6, 3.0]]])
    yield np.array(circle, float)[rng.permutation(12)]


@pytest.mark.parametrize("below", [400, 0])
def test_delaunay_is_planar_and_full_on_difficult_points(below):
    for points in difficult_points():
        pairs = delaunay_pairs(points[:, 0], points[:, 1], below)
        assert len(pairs) == 3 * len(points) - 3 - hull_size(points)
        assert {v for pair in pairs for v in pair} == set(range(len(points)))


def test_fronts_of_the_triangulation_are_asked_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    grid = rng.permutation(np.argwhere(np.ones((7, 8)))).astype(float)
    for x, y in ((rng.random(90), rng.random(90)), (grid[:, 0], grid[:, 1])):
        monkeypatch.setattr(triangulation, "FRONT_ENTRIES", 1)
        alone = triangulation.delaunay_triangles(x, y)
        monkeypatch.setattr(triangulation, "FRONT_ENTRIES", 100_000)
        calls = []
        monkeypatch.setattr(triangulation.np, "array", lambda *a, make=np.array, **k: calls.append(1) or make(*a, **k))
        assert triangulation.delaunay_triangles(x, y) == alone
        monkeypatch.undo()
        assert 0 < len(calls) < len(alone[0]) / 3


def test_delaunay_of_small_and_flat_regions(spark):
    rows = [("two", i, float(i), 0.0) for i in range(2)] + [("one", 5, 0.0, 0.0)]
    rows += [("line", 10 + i, float(i), 2.0 * i) for i in range(5)]
    rows += [("square", 20 + i, float(i % 2), float(i // 2)) for i in range(4)] + [("square", 24, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "region_id string, cell_id long, x double, y double")
    got = {}
    for e in delaunay_edges(frame).collect():
        got.setdefault(e.region_id, set()).add((e.src, e.dst))
    assert got["two"] == {(0, 1)} and "one" not in got
    assert {(10, 11), (11, 12), (12, 13), (13, 14)} <= got["line"]
    assert len(got["square"]) == 5 and not any(24 in e for e in got["square"])
    for bound in (3, 4):  # the same edges where regions count as large
        cut = {(e.region_id, e.src, e.dst) for e in delaunay_edges(frame, SizeBounds(triangulation_cells=bound)).collect()}
        assert cut == {(region, *e) for region, edges in got.items() for e in edges}


def test_tiled_delaunay_equals_the_one_of_one_task(spark):
    rng = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(np.arange(40.0), np.arange(40.0)), -1).reshape(-1, 2)
    dense = np.concatenate([rng.normal(0, 1e-4, (700, 2)), rng.uniform(-0.5, 0.5, (900, 2)), [[1e5, 3.0]]])
    sets = {"even": rng.random((2500, 2)), "grid": grid[rng.permutation(len(grid))], "dense": dense, "small": rng.random((50, 2))}
    sets["copies"] = np.concatenate([rng.random((900, 2)), np.full((700, 2), 0.5)])
    line = np.arange(600.0)
    sets["line"] = np.stack([line, 2 * line], 1)
    rows = [(name, i, float(a), float(b)) for name, points in sets.items() for i, (a, b) in enumerate(points)]
    frame = spark.createDataFrame(rows, "region_id string, cell_id long, x double, y double")

    def edges(bound):
        found = delaunay_edges(frame, SizeBounds(triangulation_cells=bound)).collect()
        assert len({(e.region_id, e.src, e.dst) for e in found}) == len(found)
        return {(e.region_id, e.src, e.dst): e.dist for e in found}

    assert edges(400) == edges(10_000)


def random_edges(spark, seed=1, n=60, m=70):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(0, i) for i in range(1, 15)}
    edges = spark.createDataFrame([("r", a, b, 1.0) for a, b in pairs], "region_id string, src long, dst long, dist double")
    cells = spark.createDataFrame([("r", i) for i in range(n)], "region_id string, cell_id long")
    return pairs, edges, cells, n


def test_components_by_kernel_and_by_stars(spark):
    pairs, edges, cells, n = random_edges(spark)
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    for bounds in (SizeBounds(), SizeBounds(halo_rows=1)):
        got = {r.cell_id: r.component for r in graphs.components(edges, cells, bounds).collect()}
        assert got == dict(enumerate(label))


def test_triangles_with_a_hub_and_boundaries(spark):
    pairs, edges, cells, n = random_edges(spark, 2, 30, 90)
    want = {
        (a, b, c) for a, b, c in itertools.combinations(range(n), 3) if {(a, b), (a, c), (b, c)} <= pairs
    }
    rows = graphs.triangles(edges)
    assert {(t.a, t.b, t.c) for t in rows.collect()} == want and want
    b1, b2 = graphs.node_boundary(edges), graphs.edge_boundary(rows)
    assert graphs.multiply(b1, b2).isEmpty()
    laplacian = graphs.hodge_laplacians(b1, b2)["L0"]
    signal = cells.select("region_id", F.array("cell_id").alias("key"), (F.col("cell_id") % 5).alias("value"))
    once = {r.key[0]: r.value for r in graphs.apply_matrix(laplacian, signal).collect()}
    same = {r.key[0]: r.value for r in graphs.polynomial_filter(b1, signal, [0.0, 1.0], "row").collect()}
    assert {k: v for k, v in same.items() if v} == {k: v for k, v in once.items() if v}


def test_laplacians_shuffle_entries_only(spark):
    pairs, edges, cells, n = random_edges(spark, 3, 30, 90)
    far = edges.select(F.concat("region_id", F.lit("-far")).alias("region_id"), "src", "dst").where("src < 9 and dst < 9")
    edges = edges.select("region_id", "src", "dst").unionByName(far).localCheckpoint()
    b1, b2 = graphs.node_boundary(edges), graphs.edge_boundary(graphs.triangles(edges).localCheckpoint())
    rows_of = lambda frame: sorted((r.region_id, tuple(r["row"]), tuple(r["col"]), r.value) for r in frame.collect())
    whole = graphs.hodge_laplacians(b1, b2)
    mixed = graphs.hodge_laplacians(b1, b2, SizeBounds(percentile_rows=60))
    ends = {"L0": (b1, graphs.transpose(b1)), "L1_down": (graphs.transpose(b1), b1), "L1_up": (b2, graphs.transpose(b2)), "L2": (graphs.transpose(b2), b2)}
    for name, (left, right) in ends.items():
        want = rows_of(graphs.multiply(left, right))
        assert want and rows_of(whole[name]) == want and rows_of(mixed[name]) == want
        assert whole[name]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def graph_by_hand(points, s):
    """Three scales of one region with plain numpy, neighbours in (distance, id) order."""
    n = len(points)
    dist = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    order = [sorted((j for j in range(n) if j != i), key=lambda j: (dist[i, j], j)) for i in range(n)]
    k = min(s.knn_k, n - 1)
    wide = min(max(k + 1, min(2 * k, n - 1)), n - 1)
    last = min(max(wide + 1, min(k * s.global_knn_multiplier, n - 1)), n - 1)
    first = [dist[i, j] for i in range(n) for j in order[i][:k]]
    radius = max(np.median(first) * s.global_distance_multiplier, 1e-3)
    base, far = {}, {}
    for i in range(n):
        limit = 1.5 * max(np.median(dist[i, order[i][:k]]), 1e-6)
        base[i] = {j for rank, j in enumerate(order[i]) if rank < k or dist[i, j] <= limit}
        own = np.median(dist[i, order[i][:wide]])
        far[i] = [j for j in order[i] if own < dist[i, j] <= radius][: s.global_max_neighbors] or [order[i][last - 1]]
    return base, far


@pytest.mark.parametrize("copies", [0, 30])
def test_multiscale_graphs_against_numpy(spark, copies):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.random((70, 2)) * 10, np.full((copies, 2), 3.0)])
    s = RegionGraphSettings(knn_k=4, global_max_neighbors=6)
    frame = spark.createDataFrame([("r", i, float(x), float(y)) for i, (x, y) in enumerate(points)], "region_id string, cell_id long, x double, y double")
    base, far = graph_by_hand(points, s)
    got = {"base": {}, "global": {}, "expanded": {}}
    for e in region_graphs.multiscale_graphs(frame, s).collect():
        got[e.scale].setdefault(e.src, set()).add(e.dst)
    assert got["base"] == base
    assert got["global"] == {i: set(v) for i, v in far.items()}
    assert all(len(v) == 8 for v in got["expanded"].values())


def test_messages_by_hand(spark):
    edges = spark.createDataFrame([("r", 1, 2), ("r", 1, 3), ("r", 2, 1)], "region_id string, src long, dst long")
    state = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 3.0), ("r", 3, 8.0)], "region_id string, cell_id long, f double")
    read = lambda df: {r.cell_id: r.f for r in df.collect()}
    assert read(graphs.neighbour_mean(edges, state, ["f"])) == {1: 5.5, 2: 1.0, 3: 0.0}
    assert read(graphs.inclusive_mean(edges, state, ["f"])) == {1: 4.0, 2: 2.0, 3: 8.0}
    assert read(graphs.weighted_sum(edges, state, ["f"], 0.5)) == {1: 12.5, 2: 5.5, 3: 12.0}
    soft = read(graphs.attention(edges, state, ["f"]))
    w = np.exp(np.array([3.0, 8.0]) - 8.0)
    assert soft[1] == pytest.approx((w * [3, 8]).sum() / w.sum()) and soft[3] == 0.0


def test_drop_keeps_one_cell(spark):
    cells = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 500)], "region_id string, cell_id long")
    kept = region_graphs.drop_cells(cells, 0.999999, 1)
    assert {r.region_id for r in kept.collect()} == {"a", "b"}
    assert 120 < region_graphs.drop_cells(cells, 0.15, 1).count() < 195


def test_no_table_of_cells_is_broadcast(spark):
    _, edges, cells, _ = random_edges(spark)
    cells = cells.withColumn("cell_type", F.lit("t"))
    signal = cells.select("region_id", F.array("cell_id").alias("key"), F.lit(1.0).alias("value"))
    tri = graphs.triangles(edges)
    b1, b2 = graphs.node_boundary(edges), graphs.edge_boundary(tri)
    state = cells.withColumn("v", F.lit(1.0))
    frames = [
        *graphs.hodge_laplacians(b1, b2).values(), tri, graphs.apply_matrix(b1, signal), graphs.polynomial_filter(b1, signal, [1.0, 1.0], "row"),
        graphs.typed_edges(edges, cells), graphs.clustering(edges, cells), graphs.attention(edges, state, ["v"]),
    ]
    for frame in frames:
        frame.collect()
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
