import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cytoplane.operators import ingest, neighbors, topology
from cytoplane.settings import SizeBounds


def bars_by_triangle_columns(points):
    """Plain boundary-matrix reduction over all triangles, for comparison."""
    n = len(points)
    dist = np.array([[math.dist(p, q) for q in points] for p in points])
    edges = sorted((dist[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    rank = {(a, b): r for r, (_, a, b) in enumerate(edges)}
    triangles = sorted(
        (max(rank[a, b], rank[a, c], rank[b, c]), a, b, c) for a in range(n) for b in range(a + 1, n) for c in range(b + 1, n)
    )
    owner, bars = {}, []
    for longest, a, b, c in triangles:
        column = {rank[a, b], rank[a, c], rank[b, c]}
        while column:
            top = max(column)
            if top not in owner:
                owner[top] = column
                if edges[longest][0] > edges[top][0]:
                    bars.append((edges[top][0], edges[longest][0]))
                break
            column = column ^ owner[top]
    return sorted(bars)


def loops(points):
    dist = np.array([[math.dist(p, q) for q in points] for p in points])
    ends = topology._edge_ranks(dist)
    tree = topology._tree_edges(len(points), ends[0], ends[1])
    return sorted(topology._loop_bars(dist, *ends, tree)), sorted(ends[2][tree].tolist())


@pytest.mark.parametrize("seed", range(8))
def test_loops_match_plain_reduction(seed):
    rng = random.Random(seed)
    points = [(rng.random(), rng.random()) for _ in range(18)]
    if seed % 2:
        points = [(math.floor(x * 5), math.floor(y * 5)) for x, y in points]
    assert np.array(loops(points)[0]).ravel() == pytest.approx(np.array(bars_by_triangle_columns(points)).ravel())


def test_square_and_ring():
    found, tree = loops([(0, 0), (1, 0), (1, 1), (0, 1)])
    assert found == [(1.0, pytest.approx(math.sqrt(2)))]
    assert tree == [1.0, 1.0, 1.0]
    ring = [(math.cos(math.pi * k / 6), math.sin(math.pi * k / 6)) for k in range(12)]
    (bar,) = loops(ring)[0]
    assert bar == (pytest.approx(0.5176, abs=1e-4), pytest.approx(1.7321, abs=1e-4))


def test_diagrams_and_summary(spark):
    rows = [("r", "region", "tumor", i, x, y) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    rows += [("r", "region", "cd8", 9, 0, 0)]
    points = spark.createDataFrame(
        [(a, b, c, d, float(e), float(f)) for a, b, c, d, e, f in rows],
        "region_id string, scope string, subset string, cell_id long, x double, y double",
    )
    bars = topology.diagrams(points)
    got = sorted((b.dim, b.birth, b.death) for b in bars.collect() if b.death is not None)
    assert got == [(0, 0.0, 1.0)] * 3 + [(1, 1.0, pytest.approx(math.sqrt(2)))]
    values = {r.name: r.value for r in topology.diagram_summary(bars, points).collect()}
    assert set(values) == set(topology.summary_names())
    assert values["tumor_h0_count"] == 3 and values["cd8_h0_count"] == 0
    assert values["tumor_h0_entropy"] == pytest.approx(math.log(3))
    assert values["tumor_h1_top_lifetime_1"] == pytest.approx(math.sqrt(2) - 1)
    assert values["tumor_h0_betti_peak"] == 3 and values["tumor_h0_betti_area"] == pytest.approx(3.0)


def test_tree_of_many_points_from_delaunay_edges():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.random((150, 2)), np.full((5, 2), 0.5)])
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    ends = topology._edge_ranks(dist)
    want = ends[2][topology._tree_edges(len(points), ends[0], ends[1])]
    assert np.sort(topology._sparse_tree_lengths(points[:, 0], points[:, 1])) == pytest.approx(np.sort(want))
    half = np.concatenate([rng.normal(0, 1e-5, (1100, 2)), rng.uniform(-0.5, 0.5, (1100, 2))])  # above the bound
    dist = np.sqrt(((half[:, None] - half[None]) ** 2).sum(-1))
    ends = topology._edge_ranks(dist)
    want = ends[2][topology._tree_edges(len(half), ends[0], ends[1])]
    got = topology._sparse_tree_lengths(half[:, 0], half[:, 1])
    assert len(got) == len(half) - 1 and np.sort(got) == pytest.approx(np.sort(want))
    line = np.arange(20.0)
    assert topology._sparse_tree_lengths(line, 2 * line) == pytest.approx(np.full(19, math.sqrt(5)))


def test_connected_parts_hold_no_matrix_of_distances(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 1e-3, (800, 2)), rng.uniform(-0.5, 0.5, (800, 2)), np.full((60, 2), 0.25), rng.integers(0, 9, (240, 2))])
    n = len(points)
    table = pa.table({"region_id": [1] * n, "scope": ["region"] * n, "subset": ["a"] * n, "cell_id": np.arange(n), "x": points[:, 0], "y": points[:, 1]})
    tracemalloc.start()
    found = topology._diagram_kernel((0,))(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    ends = topology._edge_ranks(dist)
    want = np.sort(ends[2][topology._tree_edges(n, ends[0], ends[1])])
    deaths = found["death"].to_pylist()
    assert deaths.count(None) == 1 and sorted(d for d in deaths if d is not None) == pytest.approx(want, abs=0)
    assert peak < 4e6
    monkeypatch.setattr(topology, "SEARCHED_POINTS", 0)
    monkeypatch.setattr(topology, "DENSE_POINTS", 100)
    delaunay = topology._diagram_kernel((0,))(table)["death"].to_pylist()
    assert sorted(d for d in delaunay if d is not None) == pytest.approx(want)


def test_connected_parts_of_large_subsets(spark):
    """The same bars where subsets count as large: tiled edges and a tree by joins against one task."""
    rng = np.random.default_rng(8)
    cloud = np.concatenate([rng.normal(0, 1e-3, (500, 2)), rng.uniform(-0.5, 0.5, (700, 2)), np.full((4, 2), 0.25)])
    grid = np.stack(np.meshgrid(np.arange(30.0), np.arange(30.0)), -1).reshape(-1, 2)
    line = np.stack([np.arange(500.0), 3 * np.arange(500.0)], 1)
    sets = {"cloud": cloud, "grid": grid, "line": line, "small": rng.random((30, 2)), "spot": np.full((450, 2), 2.0)}
    rows = [("r", "region", name, i, float(a), float(b)) for name, p in sets.items() for i, (a, b) in enumerate(p)]
    points = spark.createDataFrame(rows, "region_id string, scope string, subset string, cell_id long, x double, y double")

    def bars(bound):
        found = {name: [] for name in sets}
        for b in topology.diagrams(points, (0,), SizeBounds(tree_points=bound)).collect():
            assert (b.region_id, b.scope, b.dim, b.birth) == ("r", "region", 0, 0.0)
            found[b.subset].append(math.inf if b.death is None else b.death)
        return {k: sorted(v) for k, v in found.items()}

    large, whole = bars(400), bars(10_000)
    for name, p in sets.items():
        assert len(large[name]) == len(p) and large[name] == pytest.approx(whole[name])


def test_curves_of_bars_against_every_grid_point(spark):
    """Events at three grid points a bar give what counting every bar at every grid point gives."""
    import numpy as np

    from cytoplane.operators import ingest, neighbors, topology

    r = np.random.default_rng(5)
    bars = []
    for d in range(40):
        n = int(r.integers(1, 30))
        birth = r.choice([0.0, 1.0, 2.5], size=n) if d % 2 else r.uniform(0, 3, size=n)
        length = r.choice([0.5, 1.0, 3.0], size=n) if d % 2 else r.exponential(0.3, size=n)
        bars += [(d, "region", "tumor", d % 3 % 2, float(b), float(b + w)) for b, w in zip(birth, length)]
    frame = spark.createDataFrame(bars, "region_id int, scope string, subset string, dim int, birth double, death double")
    lives = topology.lifetimes(frame)
    for size in (32, 5):
        for row in topology.curve_stats(lives, topology.persistence_totals(lives), size).collect():
            b, e = np.array([(x[4], x[5]) for x in bars if x[0] == row.region_id]).T
            grid = np.linspace(b.min(), e.max(), size)
            alive = ((grid >= b[:, None]) & (grid <= e[:, None])).sum(axis=0)
            share = (e - b) / (e - b).sum()
            tent = (share[:, None] * np.maximum(0, np.minimum(grid - b[:, None], e[:, None] - grid))).sum(axis=0)
            got = [row.betti_area, row.betti_peak, row.betti_mean, row.silhouette_mean, row.silhouette_peak, row.entropy]
            want = [np.trapezoid(alive, grid), alive.max(), alive.mean(), tent.mean(), tent.max(), -(share * np.log(share + 1e-12)).sum()]
            assert np.allclose(got, want, atol=1e-9)


def test_large_subsets_have_a_task_of_their_own(spark):
    import random

    from cytoplane.operators import ingest, neighbors, topology
    from cytoplane.settings import SizeBounds

    r = random.Random(3)
    points = [("a", "region", s, k, r.random(), r.random()) for s, n in (("tumor", 30), ("cd8", 5), ("treg", 2)) for k in range(n)]
    frame = spark.createDataFrame(points, "region_id string, scope string, subset string, cell_id long, x double, y double")
    whole = sorted(map(str, topology.diagrams(frame).collect()))
    assert sorted(map(str, topology.diagrams(frame, bounds=SizeBounds(shared_points=4)).collect())) == whole


@pytest.mark.parametrize("dims", [(0,), (0, 1), (1,)])
def test_many_small_subsets_at_a_time_give_the_bars_of_each_alone(dims):
    r = np.random.default_rng(1)
    parts = []
    for g in range(80):
        n = int(r.integers(1, 40)) if g else 140
        spots = r.random((n, 2)) * 10 if g % 3 else np.round(r.random((n, 2)) * 10)  # ties and copies too
        names = {"region_id": [g // 4] * n, "scope": ["region"] * n, "subset": [f"s{g % 4}"] * n, "cell_id": list(range(n))}
        parts.append(pa.table(names | {"x": spots[:, 0], "y": spots[:, 1]}))
    whole = pa.concat_tables(parts).combine_chunks()
    kernel = neighbors.many_groups(topology.GROUP, lambda table, starts: iter([topology._diagrams_of(table, starts, dims)]), rows=100)
    found = [row for b in kernel(iter(whole.to_batches(max_chunksize=33))) for row in b.to_pylist()]
    alone = [row for part in parts for row in topology._diagram_kernel(dims)(part).to_pylist()]
    order = lambda d: (d["region_id"], d["subset"], d["dim"], d["birth"], d["death"] is None, d["death"] or 0.0)
    assert sorted(found, key=order) == sorted(alone, key=order)


def test_patches_are_rolled_up_where_their_region_lies(spark):
    rng = random.Random(21)
    rows = [(i % 3, i, rng.uniform(0, 60), rng.uniform(0, 60), rng.choice(["tumor", "cd8", "vessel"])) for i in range(360)]
    cells = spark.createDataFrame(rows, "region_id long, cell_id long, x double, y double, cell_type string")
    kept = lambda parts: sorted((r.region_id, r["name"], round(r.value, 9)) for part in parts for r in part.collect())
    parts = topology.topology_parts(cells)
    by_rows = kept(topology.topology_parts(cells, bounds=SizeBounds(percentile_rows=50)))  # every statistic of a patch as a row of its own
    assert kept(parts) == by_rows and any(name == "patch_tumor_h0_entropy_q75" and value > 0 for _, name, value in by_rows)
    regions = spark.range(3).selectExpr("id as region_id", "'s' as sample_id", "'p' as patient_id", "'a' as label")
    for part in parts:
        plan = ingest.attach_metadata(part, regions, "F1")._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning(region_id")
