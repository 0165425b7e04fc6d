"""Statistics, boundary matrices and message passing on edge tables.

Undirected edges are (region_id, src, dst) with src < dst; directed ones are neighbour rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators.composition import feature
from cytoplane.operators.neighbors import spread_groups
from cytoplane.session import cut_lineage, group_size, largest_group
from cytoplane.settings import BOUNDS, SizeBounds


def by_merge(rows: DataFrame) -> DataFrame:
    """Side of a join that grows with the cells. Spark guesses its size from compressed files, far too low, and would
    pass it whole through the driver to broadcast it."""
    return rows.hint("merge")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every undirected edge in both directions, from one pass."""
    ways = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select("region_id", F.inline(ways))


def typed_edges(edges: DataFrame, cells: DataFrame) -> DataFrame:
    kinds = cells.select("region_id", "cell_id", "cell_type")
    a = kinds.select("region_id", F.col("cell_id").alias("src"), F.col("cell_type").alias("src_type"))
    b = kinds.select("region_id", F.col("cell_id").alias("dst"), F.col("cell_type").alias("dst_type"))
    return edges.select("region_id", "src", "dst").join(by_merge(a), ["region_id", "src"]).join(by_merge(b), ["region_id", "dst"])


def _type_pairs(typed: DataFrame) -> DataFrame:
    a, b = C.slug(F.col("src_type")), C.slug(F.col("dst_type"))
    return typed.groupBy("region_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.count("*").alias("n"))


def pair_fractions(typed: DataFrame) -> DataFrame:
    """Share of each unordered type pair among a region's edges."""
    counted = _type_pairs(typed)
    totals = counted.groupBy("region_id").agg(F.sum("n").alias("total"))
    name = F.concat(F.lit("knn_pair_"), "a", F.lit("__"), "b")
    return counted.join(totals, "region_id").select(*feature(name, F.col("n") / F.col("total")))


def mixing_entropy(typed: DataFrame, cells: DataFrame) -> DataFrame:
    """Entropy of the type pairs on edges; zero without edges."""
    counted = _type_pairs(typed)
    totals = counted.groupBy("region_id").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    found = counted.join(totals, "region_id").groupBy("region_id").agg(F.sum(C.entropy_term(share)).alias("e"))
    every = cells.select("region_id").distinct()
    return every.join(found, "region_id", "left").select(
        *feature("graph_edge_type_entropy", F.coalesce("e", F.lit(0.0)))
    )


def degrees(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Degree of every cell, isolated ones included."""
    counted = both_ways(edges).groupBy("region_id", F.col("src").alias("cell_id")).agg(F.count("*").alias("degree"))
    return cells.select("region_id", "cell_id").join(by_merge(counted), ["region_id", "cell_id"], "left").fillna(0, ["degree"])


def degree_summary(edges: DataFrame, cells: DataFrame) -> DataFrame:
    return degrees(edges, cells).groupBy("region_id").agg(
        F.avg("degree").alias("graph_degree_mean"),
        F.stddev_pop("degree").alias("graph_degree_std"),
        F.max("degree").cast("double").alias("graph_degree_max"),
    )


def triangles(edges: DataFrame) -> DataFrame:
    """Cliques of three as (region_id, a, b, c), a < b < c.

    Every edge points from its lower-degree end to the higher one, so no cell has more than about
    sqrt(2 * edges) outgoing edges and a hub does not multiply its neighbours with each other.
    """
    flat = edges.select("region_id", "src", "dst")
    count = both_ways(flat).groupBy("region_id", F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    sized = flat.join(
        by_merge(count.select("region_id", F.col("node").alias("src"), F.col("deg").alias("deg_s"))), ["region_id", "src"]
    ).join(by_merge(count.select("region_id", F.col("node").alias("dst"), F.col("deg").alias("deg_d"))), ["region_id", "dst"])
    swap = (F.col("deg_s") > F.col("deg_d")) | ((F.col("deg_s") == F.col("deg_d")) & (F.col("src") > F.col("dst")))
    out = sized.select(
        "region_id",
        F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("low"),
        F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("end"),
    )
    wedges = (
        out.select("region_id", "low", F.col("end").alias("p"))
        .join(by_merge(out.select("region_id", "low", F.col("end").alias("q"))), ["region_id", "low"])
        .where(F.col("p") < F.col("q"))
    )
    closed = wedges.join(
        by_merge(flat.select("region_id", F.col("src").alias("p"), F.col("dst").alias("q"))), ["region_id", "p", "q"], "left_semi"
    )
    ordered = F.sort_array(F.array("low", "p", "q"))
    return closed.select("region_id", ordered.alias("t")).select(
        "region_id", F.get("t", 0).alias("a"), F.get("t", 1).alias("b"), F.get("t", 2).alias("c")
    )


def clustering(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Average clustering coefficient over all cells; cells with fewer than two neighbours count as 0."""
    corners = triangles(edges).select("region_id", F.explode(F.array("a", "b", "c")).alias("cell_id"))
    closed = corners.groupBy("region_id", "cell_id").agg(F.count("*").alias("t"))
    d = F.col("degree")
    own = F.when(d >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return (
        degrees(edges, cells).join(by_merge(closed), ["region_id", "cell_id"], "left")
        .groupBy("region_id").agg(F.avg(own).alias("graph_clustering_mean"))
    )


def assortativity(typed: DataFrame, cells: DataFrame) -> DataFrame:
    """Attribute assortativity by type: (trace - sum of squared marginals) / (1 - the same); 0 if undefined."""
    ways = typed.select(
        "region_id",
        F.inline(
            F.array(
                F.struct(F.col("src_type").alias("p"), F.col("dst_type").alias("q")),
                F.struct(F.col("dst_type").alias("p"), F.col("src_type").alias("q")),
            )
        ),
    )
    mixing = ways.groupBy("region_id", "p", "q").agg(F.count("*").alias("n"))
    marginal = mixing.groupBy("region_id", "p").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("p") == F.col("q"), F.col("n")).otherwise(0)).alias("same")
    )
    total = marginal.groupBy("region_id").agg(
        F.sum("n").alias("total"), F.sum("same").alias("same"), F.sum(F.col("n") * F.col("n")).alias("squares")
    )
    expected = F.col("squares") / (F.col("total") * F.col("total"))
    value = F.when(expected < 1.0, (F.col("same") / F.col("total") - expected) / (1.0 - expected)).otherwise(0.0)
    every = cells.select("region_id").distinct()
    return every.join(total, "region_id", "left").select(
        *feature("graph_assortativity", F.coalesce(value, F.lit(0.0)))
    )


def _component_kernel(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """Smallest reachable id for the nodes of one bounded region."""
    id_column = nodes["cell_id"].combine_chunks()
    ids = nodes["cell_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    u = np.searchsorted(ordered, edges["src"].to_numpy())
    v = np.searchsorted(ordered, edges["dst"].to_numpy())
    label = np.arange(ids.size)
    while True:
        lower = label.copy()
        np.minimum.at(lower, u, label[v])
        np.minimum.at(lower, v, label[u])
        lower = lower[lower]
        if np.array_equal(lower, label):
            break
        label = lower
    rows = nodes.num_rows
    key = nodes["region_id"][0] if rows else pa.scalar(None, nodes.schema.field("region_id").type)
    return pa.table(
        {
            "region_id": pa.repeat(key, rows),
            "cell_id": id_column.take(pa.array(order)),
            "component": id_column.take(pa.array(order[label])),
        }
    )


def components(edges: DataFrame, cells: DataFrame, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Component of every cell, named by its smallest cell id (region_id, cell_id, component)."""
    nodes = cells.select("region_id", "cell_id")
    kind = dict(nodes.dtypes)
    schema = f"region_id {kind['region_id']}, cell_id {kind['cell_id']}, component {kind['cell_id']}"
    flat = edges.select("region_id", "src", "dst")
    if group_size(nodes, ["region_id"], bounds) <= bounds.halo_rows:
        left = spread_groups(nodes, ["region_id"]).groupBy("region_id")
        right = spread_groups(flat, ["region_id"]).groupBy("region_id")
        return left.cogroup(right).applyInArrow(_component_kernel, schema)
    stars = star_components(flat)
    return nodes.join(by_merge(stars), ["region_id", "cell_id"], "left").withColumn(
        "component", F.coalesce("component", "cell_id")
    )


def star_components(edges: DataFrame) -> DataFrame:
    """Node -> smallest node of its component, by alternating large-star and small-star steps.

    Each step is one grouped minimum and one join; the number of rounds grows with the logarithm of the graph.
    """
    current = cut_lineage(edges.where(F.col("src") != F.col("dst")).distinct())
    while True:
        ways = both_ways(current)
        low = ways.groupBy("region_id", "src").agg(F.min("dst").alias("low"))
        low = low.withColumn("low", F.least("low", "src"))
        large = ways.join(by_merge(low), ["region_id", "src"]).where(F.col("dst") > F.col("src")).select(
            "region_id", F.col("dst").alias("src"), F.col("low").alias("dst")
        ).distinct()
        high = large.select("region_id", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        floor = high.groupBy("region_id", "src").agg(F.min("dst").alias("low"))
        inner = high.join(by_merge(floor), ["region_id", "src"]).where(F.col("dst") != F.col("low")).select(
            "region_id", F.col("dst").alias("src"), F.col("low").alias("dst")
        )
        small = inner.unionByName(floor.withColumnRenamed("low", "dst"))
        following = cut_lineage(
            small.select("region_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        )
        changed = following.exceptAll(current).isEmpty() and current.exceptAll(following).isEmpty()
        current = following
        if changed:
            return current.select("region_id", F.col("dst").alias("cell_id"), F.col("src").alias("component"))


def component_count(edges: DataFrame, cells: DataFrame, bounds: SizeBounds = BOUNDS) -> DataFrame:
    found = components(edges, cells, bounds)
    return found.groupBy("region_id").agg(F.count_if(F.col("cell_id") == F.col("component")).cast("double").alias("graph_components"))


def _entry(row: Column, col: Column, value: float) -> Column:
    return F.struct(row.alias("row"), col.alias("col"), F.lit(value).alias("value"))


def node_boundary(edges: DataFrame) -> DataFrame:
    """B1 as rows (region_id, row = cell, col = edge, value): -1 at the edge's first end, +1 at its second.

    Cells, edges and triangles are named by the array of their one, two or three cell ids.
    """
    src, dst = F.col("src"), F.col("dst")
    ends = F.array(_entry(F.array(src), F.array(src, dst), -1.0), _entry(F.array(dst), F.array(src, dst), 1.0))
    return edges.select("region_id", F.inline(ends))


def edge_boundary(triangle_rows: DataFrame) -> DataFrame:
    """B2 as rows (region_id, row = edge, col = triangle, value): [b,c] - [a,c] + [a,b]."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    key = F.array(a, b, c)
    sides = F.array(_entry(F.array(b, c), key, 1.0), _entry(F.array(a, c), key, -1.0), _entry(F.array(a, b), key, 1.0))
    return triangle_rows.select("region_id", F.inline(sides))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select("region_id", F.col("col").alias("row"), F.col("row").alias("col"), "value")


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sparse product of coordinate rows; zero sums are left out."""
    a = left.select("region_id", "row", F.col("col").alias("mid"), F.col("value").alias("va"))
    b = right.select("region_id", F.col("row").alias("mid"), "col", F.col("value").alias("vb"))
    summed = a.join(by_merge(b), ["region_id", "mid"]).groupBy("region_id", "row", "col").agg(F.sum(F.col("va") * F.col("vb")).alias("value"))
    return summed.where(F.col("value") != 0)


def _products_in_regions(matrix: DataFrame, side: str) -> DataFrame:
    """Matrix times its transpose (side="row") or the transpose times the matrix (side="col"), each region in one task.

    Rows stay where one shuffle of the entries by region put them: neither the pairs nor their sums are shuffled. The
    product is symmetric, so each pair is summed once and then set at both places.
    """
    mid = "col" if side == "row" else "row"
    entries = spread_groups(matrix.where(F.col("region_id").isNotNull()).select("region_id", "row", "col", "value"), ["region_id"])
    of = F.sort_array(F.collect_list(F.struct(F.col(side).alias("key"), "value"))).alias("of")
    firsts = entries.groupBy("region_id", mid).agg(of).select("region_id", "of", F.posexplode("of").alias("at", "a"))
    pairs = firsts.select("region_id", "a", F.explode(F.slice("of", F.col("at") + 1, F.size("of"))).alias("b"))
    summed = pairs.groupBy("region_id", F.col("a.key").alias("u"), F.col("b.key").alias("v")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("value"))
    place = lambda row, col: F.struct(F.col(row).alias("row"), F.col(col).alias("col"), "value")
    places = F.when(F.col("u") == F.col("v"), F.array(place("u", "v"))).otherwise(F.array(place("u", "v"), place("v", "u")))
    return summed.where(F.col("value") != 0).select("region_id", F.inline(places))


def hodge_laplacians(b1: DataFrame, b2: DataFrame, bounds: SizeBounds = BOUNDS) -> dict[str, DataFrame]:
    """L0, both parts of L1, and L2 of boundary matrices with one row an entry.

    Regions with at most ``bounds.percentile_rows`` entries are multiplied in one task each, larger ones by joins.
    """
    found = {}
    for matrix, names in ((b1, ("L0", "L1_down")), (b2, ("L1_up", "L2"))):
        small, large = matrix, None
        if largest_group(matrix, ["region_id"]) > bounds.percentile_rows:
            sizes = matrix.groupBy("region_id").agg((F.count("*") > bounds.percentile_rows).alias("is_large"))
            sized = matrix.join(sizes, "region_id")
            small, large = sized.where(~F.col("is_large")).drop("is_large"), sized.where("is_large").drop("is_large")
        for name, side in zip(names, ("row", "col")):
            found[name] = _products_in_regions(small, side)
            if large is not None:
                ends = (large, transpose(large)) if side == "row" else (transpose(large), large)
                found[name] = found[name].unionByName(multiply(*ends))
    return found


def apply_matrix(matrix: DataFrame, signal: DataFrame, on: str = "col") -> DataFrame:
    """Matrix (or with on="row" its transpose) times a signal (region_id, key, value)."""
    out = "row" if on == "col" else "col"
    s = signal.select("region_id", F.col("key").alias(on), F.col("value").alias("f"))
    return matrix.join(by_merge(s), ["region_id", on]).groupBy("region_id", F.col(out).alias("key")).agg(
        F.sum(F.col("value") * F.col("f")).alias("value")
    )


def polynomial_filter(boundary: DataFrame, signal: DataFrame, coefficients: list[float], side: str) -> DataFrame:
    """Sum of c_j L^j f for L = B B' (side="row") or B' B (side="col").

    L is never built: each power is B applied after B', so a hub costs its degree and not the square of it.
    """
    first, second = ("row", "col") if side == "row" else ("col", "row")
    current = signal.select("region_id", "key", F.col("value").cast("double").alias("value"))
    terms = current.withColumn("value", F.col("value") * coefficients[0])
    for coefficient in coefficients[1:]:
        current = cut_lineage(apply_matrix(boundary, apply_matrix(boundary, current, first), second))
        terms = terms.unionByName(current.withColumn("value", F.col("value") * coefficient))
    return terms.groupBy("region_id", "key").agg(F.sum("value").alias("value"))


def gather(edges: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Neighbour state beside each directed edge."""
    there = state.select("region_id", F.col("cell_id").alias("dst"), *names)
    return edges.select("region_id", "src", "dst").join(by_merge(there), ["region_id", "dst"])


def _received(edges: DataFrame, state: DataFrame, names: list[str], aggregate) -> DataFrame:
    return gather(edges, state, names).groupBy("region_id", F.col("src").alias("cell_id")).agg(
        *[aggregate(n).alias(f"in_{n}") for n in names], F.count("*").alias("degree")
    )


def _updated(state: DataFrame, got: DataFrame, names: list[str], rule) -> DataFrame:
    joined = state.select("region_id", "cell_id", *names).join(by_merge(got), ["region_id", "cell_id"], "left")
    zero = F.lit(0.0)
    return joined.select(
        "region_id", "cell_id",
        *[rule(F.col(n), F.coalesce(F.col(f"in_{n}"), zero), F.coalesce("degree", F.lit(0))).alias(n) for n in names],
    )


def neighbour_mean(edges: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    return _updated(state, _received(edges, state, names, F.avg), names, lambda own, got, n: got)


def inclusive_mean(edges: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    return _updated(state, _received(edges, state, names, F.sum), names, lambda own, got, n: (got + own) / (n + 1))


def weighted_sum(edges: DataFrame, state: DataFrame, names: list[str], epsilon: float = 0.0) -> DataFrame:
    return _updated(state, _received(edges, state, names, F.sum), names, lambda own, got, n: own * (1.0 + epsilon) + got)


def attention(edges: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Neighbour state averaged with softmax weights of the scaled dot product of the two states.

    Weights are taken relative to each cell's largest score, which is aggregated first.
    """
    own = state.select("region_id", F.col("cell_id").alias("src"), *[F.col(n).alias(f"own_{n}") for n in names])
    score = sum((F.col(f"own_{n}") * F.col(n) for n in names), F.lit(0.0)) / F.sqrt(F.lit(float(len(names))))
    scored = gather(edges, state, names).join(by_merge(own), ["region_id", "src"]).withColumn("score", score)
    top = scored.groupBy("region_id", "src").agg(F.max("score").alias("top"))
    weight = F.exp(F.col("score") - F.col("top"))
    got = scored.join(by_merge(top), ["region_id", "src"]).groupBy("region_id", F.col("src").alias("cell_id")).agg(
        *[(F.sum(weight * F.col(n)) / F.sum(weight)).alias(f"in_{n}") for n in names], F.count("*").alias("degree")
    )
    return _updated(state, got, names, lambda own_, got_, n: got_)
