import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytoplane.operators import graphs, kd_tiles, neighbors
from cytoplane.settings import SizeBounds


def brute(rows, k):
    out = {}
    for r, i, x, y in rows:
        ranked = sorted(
            (math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for q, j, u, v in rows if q == r and j != i
        )
        out[(r, i)] = ranked[:k]
    return out


def clumpy(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for region, size in (("a", 120), ("b", 9), ("c", 1)):
        for _ in range(size):
            dense = rng.random() < 0.6
            x = rng.gauss(5, 0.05) if dense else rng.uniform(0, 100)
            y = rng.gauss(5, 0.05) if dense else rng.uniform(0, 100)
            rows.append((region, n, x, y))
            n += 1
    for _ in range(40):  # copies at one spot
        rows.append(("a", n, 50.0, 50.0))
        n += 1
    return rows


@pytest.mark.parametrize("cap,halo", [(4096, 65536), (8, 16)])
def test_knn_matches_brute_force(spark, cap, halo):
    rows = clumpy()
    points = spark.createDataFrame(rows, "region_id string, cell_id long, x double, y double")
    got = {}
    for e in neighbors.knn(points, 5, bounds=SizeBounds(tile_cells=cap, halo_rows=halo)).collect():
        got.setdefault((e.region_id, e.src), []).append((e["rank"], e.dist, e.dst))
    want = {key: value for key, value in brute(rows, 5).items() if value}
    assert set(got) == set(want)
    for key, value in want.items():
        assert [(d, j) for _, d, j in sorted(got[key])] == value


@pytest.mark.parametrize("cap", [8])
def test_nearest_of_a_role(spark, cap):
    rows = [(r, i, x, y, i % 3 == 0, i % 3 == 1) for r, i, x, y in clumpy(5)]
    rows += [("apart", 1000 + i, i * 0.7 % 11, 90.0 + i % 9, True, False) for i in range(40)]
    rows += [("apart", 2000 + i, 80.0 + i * 0.3 % 17, 1.0 + i % 7, False, True) for i in range(40)]
    points = spark.createDataFrame(
        rows, "region_id string, cell_id long, x double, y double, is_query boolean, is_target boolean"
    )
    got = {e.src: (e.dist, e.dst) for e in neighbors.nearest_distance(points, bounds=SizeBounds(tile_cells=cap)).collect()}
    want = {}
    for r, i, x, y, q, _ in rows:
        hits = [
            (math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for s, j, u, v, _, t in rows if t and s == r and i != j
        ]
        if q and hits:
            want[i] = min(hits)
    assert got == want


def sizes_of_groups(monkeypatch, module):
    """Rows of every group that the kernel of the tiled search is given."""
    found, deal = [], kd_tiles.dealt

    def counted(rows, keys, most):
        groups = deal(rows, keys, most)
        found.append([r["count"] for r in groups.groupBy(*keys, "tile", "block").count().collect()])
        return groups

    monkeypatch.setattr(module, "dealt", counted)
    return found


SHAPES = {
    "outlier": lambda r: [(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(2999)] + [(1e6, 1e6)],
    "dense spot": lambda r: [(r.gauss(5, 1e-4), r.gauss(5, 1e-4)) for _ in range(1500)] + [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(1500)],
    "one line": lambda r: [(7.0, r.uniform(0, 100)) for _ in range(3000)],
    "lattice": lambda r: [(float(i % 60), float(i // 60)) for i in range(3000)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_tiles_are_bounded_whatever_the_shape(spark, monkeypatch, shape):
    sizes = sizes_of_groups(monkeypatch, neighbors)
    spots = SHAPES[shape](random.Random(1))
    points = spark.createDataFrame([("a", k, x, y) for k, (x, y) in enumerate(spots)], "region_id string, cell_id long, x double, y double")
    lists = neighbors.neighbour_lists(points, 5, bounds=SizeBounds(tile_cells=64)).collect()
    assert max(n for step in sizes for n in step) <= 128
    assert sum(n for step in sizes for n in step) < 4 * len(spots)
    place = np.array(spots)
    assert len(lists) == len(spots)
    for row in lists:
        dist = np.sqrt(((place - place[row.src]) ** 2).sum(axis=1))
        dist[row.src] = np.inf
        assert row.dst == np.lexsort((np.arange(len(spots)), dist))[:5].tolist()


def test_many_askers_around_few_targets(spark, monkeypatch):
    sizes = sizes_of_groups(monkeypatch, neighbors)
    r = random.Random(6)
    rows = [("a", k, r.uniform(0, 9), r.uniform(0, 9), True, False) for k in range(1500)]
    rows += [("a", 5000 + k, 90 + k % 7 / 7, 90 + k / 40, False, True) for k in range(150)] + [("a", 9000, -500.0, 3.0, False, True)]
    points = spark.createDataFrame(rows, "region_id string, cell_id long, x double, y double, is_query boolean, is_target boolean")
    got = {x.src: x.dst for x in neighbors.neighbour_lists(points, 3, bounds=SizeBounds(tile_cells=64)).collect()}
    targets = [(i, x, y) for _, i, x, y, _, t in rows if t]
    for _, i, x, y, asks, _ in rows:
        if asks:
            assert got[i] == [j for _, j in sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in targets)[:3]]
    assert max(n for step in sizes for n in step) <= 128


def test_dense_squares_are_compared_in_blocks(spark):
    r = random.Random(2)
    spots = [(r.uniform(0, 1), r.uniform(0, 1)) for _ in range(700)] + [(5.0, 5.0), (5.2, 5.0)]
    points = spark.createDataFrame([("a", k, x, y) for k, (x, y) in enumerate(spots)], "region_id string, cell_id long, x double, y double")
    got = sorted((e.src, e.dst) for e in neighbors.within_radius(points, F.lit(0.9), bounds=SizeBounds(tile_cells=50)).collect())
    place = np.array(spots)
    apart = np.sqrt(((place[:, None] - place[None]) ** 2).sum(axis=2))
    assert got == [(i, j) for i, j in np.argwhere(apart <= 0.9).tolist() if i != j]
    whole = spark.range(3000).selectExpr("'a' as region_id", "id as src", "1 as level", "id % 3 as gx", "0 as gy")
    other = whole.selectExpr("region_id", "src as dst", "level", "gx div 2 as gx", "gy")
    square = ["region_id", "level", "gx", "gy"]
    for side in neighbors._in_blocks(whole, other, square, 100):
        assert side.groupBy(*square, "block_a", "block_b").count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize("tile", [1, 16])
def test_pairs_of_large_groups_send_a_query_to_few_tiles(spark, monkeypatch, tile):
    """Radii of all sizes, copies at one spot beyond a tile, ids as text; groups are counted as they reach the kernel."""
    monkeypatch.setattr(neighbors, "RADIUS_TILE", tile)
    kept, sent = neighbors.spread_groups, []
    monkeypatch.setattr(neighbors, "spread_groups", lambda df, keys: sent.append(df) or kept(df, keys))
    rows = [(r, f"c{i}", x, y, (0.3, 1.0, 5.0, 400.0, 0.0)[i % 5] if i % 3 else 0.4) for r, i, x, y in clumpy(9)]
    points = spark.createDataFrame(rows, "region_id string, cell_id string, x double, y double, own double")
    got = sorted((e.src, e.dst, e.dist) for e in neighbors.within_radius(points, F.col("own"), bounds=SizeBounds(tile_cells=16)).collect())
    want = []
    for r, i, x, y, radius in rows:
        near = [(i, j, math.sqrt((x - u) * (x - u) + (y - v) * (y - v))) for s, j, u, v, _ in rows if r == s and i != j]
        want += [p for p in near if p[2] <= radius]
    assert got == sorted(want)
    if tile == 16:
        assert sent and sent[-1].where("is_query").count() < 2 * len(rows)


def test_within_radius(spark):
    rows = clumpy(7)
    points = spark.createDataFrame(rows, "region_id string, cell_id long, x double, y double")
    got = {(e.src, e.dst) for e in neighbors.within_radius(points, F.lit(0.5) + F.col("cell_id") % 7).collect()}
    want = {
        (i, j)
        for r, i, x, y in rows
        for s, j, u, v in rows
        if r == s and i != j and math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 0.5 + i % 7
    }
    assert got == want


@pytest.mark.parametrize("with_self", [False, True])
def test_many_small_groups_at_a_time_give_the_lists_of_each_alone(with_self):
    r = np.random.default_rng(4)
    parts = []
    for g in range(40):
        n = int(r.integers(1, 30)) if g else 300
        spots = r.random((n, 2)) * 9 if g % 3 else np.round(r.random((n, 2)) * 9)  # ties and copies too
        flags = {"is_query": r.random(n) < 0.7, "is_target": r.random(n) < 0.6}
        names = {"region_id": pa.array([g // 2] * n), "pair": [None if g % 2 else "b"] * n, "cell_id": [f"{i:04}" for i in range(n)]}
        parts.append(pa.table(names | {"x": spots[:, 0], "y": spots[:, 1]} | flags).cast(
            pa.schema([("region_id", pa.int64()), ("pair", pa.string()), ("cell_id", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("is_query", pa.bool_()), ("is_target", pa.bool_())])
        ))
    whole, keys = pa.concat_tables(parts).combine_chunks(), ["region_id", "pair"]
    kernel = neighbors.many_groups(keys, neighbors._lists_of(keys, 4, with_self), rows=100)
    found = [row for b in kernel(iter(whole.to_batches(max_chunksize=33))) for row in b.to_pylist()]
    alone = [row for part in parts for row in neighbors._list_kernel(keys, 4, with_self)(part).to_pylist()]
    order = lambda d: (d["region_id"], d["pair"] or "", d["src"])
    assert sorted(found, key=order) == sorted(alone, key=order)


def test_patches_of_a_group_give_the_lists_of_all_pairs(monkeypatch):
    r = np.random.default_rng(6)
    spots = np.concatenate([r.normal(0, 1e-3, (500, 2)), r.random((700, 2)), r.integers(0, 9, (400, 2)), np.full((6, 2), 3.0), [[1e6, 0.0], [0.0, -1e7]]])
    n = len(spots)
    flags = r.random((2, n)) < [[0.9], [0.8]]
    table = pa.table({"g": [1] * n, "cell_id": r.permutation(n), "x": spots[:, 0], "y": spots[:, 1], "is_query": flags[0], "is_target": flags[1]})
    compared, nearest = [], neighbors._nearest_rows
    monkeypatch.setattr(neighbors, "_nearest_rows", lambda dist, k: compared.append(dist.size) or nearest(dist, k))
    for k, with_self in ((1, False), (5, False), (5, True), (40, False)):
        compared.clear()
        found = neighbors._list_kernel(["g"], k, with_self)(table)
        few = sum(compared)
        monkeypatch.setattr(neighbors, "PATCH", n)
        compared.clear()
        assert found.equals(neighbors._list_kernel(["g"], k, with_self)(table))
        assert few < sum(compared) / (1 if k == 40 else 2)
        monkeypatch.setattr(neighbors, "PATCH", 64)


@pytest.fixture
def late_broadcast(spark):
    """Joins are planned as merges and turn into broadcasts while they run; small partitions are not merged."""
    names = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "2KB", "adaptive.coalescePartitions.enabled": "false"}
    for name, value in names.items():
        spark.conf.set(f"spark.sql.{name}", value)
    yield
    for name in names:
        spark.conf.unset(f"spark.sql.{name}")


def test_groups_stay_whole_after_a_join_that_turns_into_a_broadcast(spark, late_broadcast):
    rng = random.Random(11)
    rows = [(i % 12, i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(480)]
    points = spark.createDataFrame(rows, "region_id long, cell_id long, x double, y double").repartition(7).localCheckpoint()
    scales = spark.createDataFrame([(r, 2.0) for r in range(12)], "region_id long, scale double")
    joined = points.join(scales, "region_id").withColumns({a: F.col(a) / F.col("scale") for a in "xy"})
    want = brute([(r, i, x / 2, y / 2) for r, i, x, y in rows], 4)
    got = {}
    for e in neighbors.knn(joined, 4).collect():
        got.setdefault((e.region_id, e.src), []).append((e.dist, e.dst))
    assert {key: sorted(value) for key, value in got.items()} == want


def test_pair_shares_after_a_join_that_turns_into_a_broadcast(spark, late_broadcast):
    rng = random.Random(12)
    rows = [(i % 6, i, rng.uniform(0, 50), rng.uniform(0, 50), rng.choice("ab")) for i in range(240)]
    points = spark.createDataFrame(rows, "region_id long, cell_id long, x double, y double, cell_type string").repartition(7).localCheckpoint()
    scales = spark.createDataFrame([(r, 2.0) for r in range(6)], "region_id long, scale double")
    joined = points.join(scales, "region_id").withColumns({a: F.col(a) / F.col("scale") for a in "xy"})
    lists = {key: {j for _, j in near} for key, near in brute([(r, i, x / 2, y / 2) for r, i, x, y, _ in rows], 4).items()}
    kind = {i: t for _, i, _, _, t in rows}
    pairs = [(r, "__".join(sorted(kind[i] + kind[j]))) for (r, i), near in lists.items() for j in near if i < j and i in lists[(r, j)]]
    counted = Counter(pairs)
    totals = Counter(r for r, _ in pairs)
    want = {(r, f"knn_pair_{name}"): n / totals[r] for (r, name), n in counted.items()}
    shares = graphs.pair_fractions(graphs.typed_edges(neighbors.mutual(neighbors.knn(joined, 4)), joined))
    assert {(e.region_id, e["name"]): e.value for e in shares.collect()} == pytest.approx(want)
