"""Persistence diagrams and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.operators import composition, topology
from cytoplane.settings import SUBSET_ROLES
from cytoplane.session import cut_lineage
from workload import views as V
from workload.q_composition import long_form
from workload.q_graphs import NORM, normalized
from workload.q_ingest import role_sql
from workload.registry import query, with_views

POINTS_SQL = "subset_points AS (" + " UNION ALL ".join(
    f"SELECT region_id, 'region' AS scope, '{subset}' AS subset, cell_id, x, y FROM norm WHERE "
    + " OR ".join(role_sql(role) for role in roles)
    for subset, roles in SUBSET_ROLES.items()
) + ")"

PATCH_SQL = """corner AS (SELECT region_id, min(x) AS x0, min(y) AS y0 FROM norm GROUP BY 1),
placed AS (SELECT n.region_id, CAST(CAST(floor((x - x0) / 12.0) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor((y - y0) / 12.0) AS BIGINT) AS VARCHAR) AS scope,
  cell_id, cell_type, x, y FROM norm n JOIN corner USING (region_id)),
patches AS (SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY region_id, scope) >= 6)"""

PATCH_POINTS_SQL = "subset_points AS (" + " UNION ALL ".join(
    f"SELECT region_id, scope, '{subset}' AS subset, cell_id, x, y FROM patches WHERE "
    + " OR ".join(role_sql(role) for role in roles)
    for subset, roles in SUBSET_ROLES.items()
) + ")"


def tree_sql(rounds: int = 6) -> str:
    """Minimum spanning tree per group: an edge is in it iff its rank is the minimax path value of its ends."""
    parts = [
        """lengths AS (SELECT a.region_id, a.scope, a.subset, a.cell_id AS u, b.cell_id AS v,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
  FROM subset_points a JOIN subset_points b ON a.region_id = b.region_id AND a.scope = b.scope AND a.subset = b.subset AND a.cell_id < b.cell_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY region_id, scope, subset ORDER BY d, u, v) AS r FROM lengths),
m0 AS (SELECT region_id, scope, subset, u, v, r FROM numbered UNION ALL SELECT region_id, scope, subset, v, u, r FROM numbered
  UNION ALL SELECT region_id, scope, subset, cell_id, cell_id, 0 FROM subset_points)"""
    ]
    for i in range(rounds):
        parts.append(
            f"""m{i + 1} AS (SELECT a.region_id, a.scope, a.subset, a.u, b.v, min(greatest(a.r, b.r)) AS r FROM m{i} a JOIN m{i} b
  ON a.region_id = b.region_id AND a.scope = b.scope AND a.subset = b.subset AND a.v = b.u GROUP BY ALL)"""
        )
    parts.append(
        f"""bars AS (SELECT n.region_id, n.scope, n.subset, 0 AS dim, 0.0::DOUBLE AS birth, n.d AS death FROM numbered n JOIN m{rounds} m
  ON n.region_id = m.region_id AND n.scope = m.scope AND n.subset = m.subset AND n.u = m.u AND n.v = m.v AND n.r = m.r),
lives AS (SELECT *, death - birth AS life FROM bars WHERE death > birth),
totals AS (SELECT region_id, scope, subset, CAST(count(*) AS DOUBLE) AS count, sum(life) AS total_persistence, min(birth) AS first_birth, max(death) AS last_death
  FROM lives GROUP BY 1, 2, 3)"""
    )
    return ",\n".join(parts)


CURVE_SQL = """grid AS (SELECT l.*, i, (last_death - first_birth) / 31.0::DOUBLE AS step, total_persistence,
  CASE WHEN i = 31 THEN last_death ELSE i * ((last_death - first_birth) / 31.0::DOUBLE) + first_birth END AS t
  FROM lives l JOIN totals USING (region_id, scope, subset) CROSS JOIN range(32) g(i) WHERE last_death > first_birth),
curve AS (SELECT region_id, scope, subset, i, step, CAST(count(*) FILTER (t >= birth AND t <= death) AS DOUBLE) AS betti,
  sum(life / greatest(total_persistence, 1e-12) * greatest(0, least(t - birth, death - t))) AS silhouette FROM grid GROUP BY 1, 2, 3, 4, 5),
curves AS (SELECT region_id, scope, subset, sum(betti * step * CASE WHEN i IN (0, 31) THEN 0.5::DOUBLE ELSE 1 END) AS betti_area, max(betti) AS betti_peak,
  avg(betti) AS betti_mean, avg(silhouette) AS silhouette_mean, max(silhouette) AS silhouette_peak FROM curve GROUP BY 1, 2, 3)"""

ENTROPY_SQL = """entropies AS (SELECT region_id, scope, subset, sum(-(life / total_persistence) * ln(life / total_persistence + 1e-12)) AS entropy
  FROM lives JOIN totals USING (region_id, scope, subset) GROUP BY 1, 2, 3)"""

TOP_SQL = """top AS (SELECT region_id, scope, subset, life, row_number() OVER (PARTITION BY region_id, scope, subset ORDER BY life DESC, birth) AS rank FROM lives)"""

STATS = [*topology.SUMMARY_STATS, "top_lifetime_1", "top_lifetime_2", "top_lifetime_3"]
SUMMARY_SQL = ",\n".join((CURVE_SQL, ENTROPY_SQL, TOP_SQL)) + f""",
tops AS (SELECT region_id, scope, subset, max(life) FILTER (rank = 1) AS top_lifetime_1, max(life) FILTER (rank = 2) AS top_lifetime_2,
  max(life) FILTER (rank = 3) AS top_lifetime_3 FROM top GROUP BY 1, 2, 3),
scaffold AS (SELECT region_id, scope, unnest([{", ".join(f"'{s}'" for s in SUBSET_ROLES)}]) AS subset FROM scopes),
wide AS (SELECT * FROM scaffold LEFT JOIN totals USING (region_id, scope, subset) LEFT JOIN entropies USING (region_id, scope, subset)
  LEFT JOIN curves USING (region_id, scope, subset) LEFT JOIN tops USING (region_id, scope, subset)),
summary_rows AS (""" + " UNION ALL ".join(
    f"SELECT region_id, scope, subset || '_h0_{s}' AS name, coalesce({s}, 0) AS value FROM wide" for s in STATS
) + ")"

TREE = (*NORM, POINTS_SQL, tree_sql())


def whole_points(spark, sf):
    cells, _ = normalized(spark, sf)
    return topology.subset_points(cells)


def connected_lives(spark, sf):
    lives = topology.lifetimes(cut_lineage(topology.diagrams(whole_points(spark, sf), (0,))))
    return lives, topology.persistence_totals(lives)


@query("t1_subset_points", with_views(*NORM, POINTS_SQL, "SELECT region_id, subset, cell_id FROM subset_points"))
def subset_points(spark, sf):
    return whole_points(spark, sf).select("region_id", "subset", "cell_id")


@query("t2_patches", with_views(*NORM, PATCH_SQL, "SELECT region_id, scope, cell_id FROM patches"))
def patches(spark, sf):
    cells, _ = normalized(spark, sf)
    return topology.assign_patches(cells).select("region_id", "scope", "cell_id")


@query(
    "t3_connected_diagrams",
    with_views(
        *TREE,
        """SELECT region_id, subset, CAST(dim AS INTEGER) AS dim, birth, round(death, 6) AS death FROM bars
           UNION ALL SELECT DISTINCT region_id, subset, 0::INTEGER, 0.0::DOUBLE, NULL::DOUBLE FROM subset_points""",
    ),
)
def connected_diagrams(spark, sf):
    bars = topology.diagrams(whole_points(spark, sf), (0,))
    return bars.select("region_id", "subset", "dim", "birth", F.round("death", 6).alias("death"))


VECTOR_TREE_SQL = "subset_points AS (SELECT region_id, 'region' AS scope, cell_type AS subset, cell_id, x, y FROM points)"


@query(
    "t3_vector_diagrams",
    with_views(V.POINTS_SQL, VECTOR_TREE_SQL, tree_sql(), "SELECT region_id, subset, count(*) AS bars, round(sum(death), 5) AS total FROM bars GROUP BY 1, 2"),
)
def vector_diagrams(spark, sf):
    points = V.vector_points(spark, sf).withColumnRenamed("cell_type", "subset").withColumn("scope", F.lit("region"))
    bars = topology.diagrams(points, (0,)).where(F.col("death").isNotNull())
    return bars.groupBy("region_id", "subset").agg(F.count("*").alias("bars"), F.round(F.sum("death"), 5).alias("total"))


@query("t4_loop_diagrams")
def loop_diagrams(spark, sf):
    bars = topology.diagrams(whole_points(spark, sf), (1,))
    return bars.select("region_id", "subset", "dim", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death"))


@query("t5_lifetimes", with_views(*TREE, "SELECT region_id, subset, round(life, 6) AS life FROM lives"))
def lifetimes(spark, sf):
    lives, _ = connected_lives(spark, sf)
    return lives.select("region_id", "subset", F.round("life", 6).alias("life"))


@query("t6_totals", with_views(*TREE, "SELECT region_id, subset, count, round(total_persistence, 6) AS total_persistence FROM totals"))
def totals(spark, sf):
    _, rows = connected_lives(spark, sf)
    return rows.select("region_id", "subset", "count", F.round("total_persistence", 6).alias("total_persistence"))


@query("t7_entropy", with_views(*TREE, ENTROPY_SQL, "SELECT region_id, subset, round(entropy, 6) AS entropy FROM entropies"))
def entropy(spark, sf):
    rows = topology.persistence_entropy(*connected_lives(spark, sf))
    return rows.select("region_id", "subset", F.round("entropy", 6).alias("entropy"))


@query("t8_betti_curves", with_views(*TREE, CURVE_SQL, "SELECT region_id, subset, round(betti_area, 6) AS area, betti_peak AS peak, round(betti_mean, 6) AS mean FROM curves"))
def betti_curves(spark, sf):
    rows = topology.curve_stats(*connected_lives(spark, sf))
    return rows.select("region_id", "subset", F.round("betti_area", 6).alias("area"), F.col("betti_peak").alias("peak"), F.round("betti_mean", 6).alias("mean"))


@query("t9_silhouettes", with_views(*TREE, CURVE_SQL, "SELECT region_id, subset, round(silhouette_mean, 6) AS mean, round(silhouette_peak, 6) AS peak FROM curves"))
def silhouettes(spark, sf):
    rows = topology.curve_stats(*connected_lives(spark, sf))
    return rows.select("region_id", "subset", F.round("silhouette_mean", 6).alias("mean"), F.round("silhouette_peak", 6).alias("peak"))


@query("t10_top_lifetimes", with_views(*TREE, TOP_SQL, "SELECT region_id, subset, CAST(rank AS INTEGER) AS rank, round(life, 6) AS life FROM top WHERE rank <= 3"))
def top_lifetimes(spark, sf):
    lives, _ = connected_lives(spark, sf)
    rows = topology.top_lifetimes(lives)
    return rows.select("region_id", "subset", "rank", F.round("life", 6).alias("life"))


SCOPES_SQL = "scopes AS (SELECT DISTINCT region_id, 'region' AS scope FROM norm)"


@query("t11_connected_summary", with_views(*TREE, SCOPES_SQL, SUMMARY_SQL, "SELECT region_id, name, round(value, 6) + 0.0::DOUBLE AS value FROM summary_rows"))
def connected_summary(spark, sf):
    cells, _ = normalized(spark, sf)
    scoped = cells.withColumn("scope", F.lit("region"))
    bars = topology.diagrams(topology.subset_points(scoped), (0,))
    return long_form(topology.diagram_summary(bars, scoped, dims=(0,)))


@query("t11_diagram_summary")
def diagram_summary(spark, sf):
    cells, _ = normalized(spark, sf)
    scoped = cells.withColumn("scope", F.lit("region"))
    return long_form(topology.diagram_summary(topology.diagrams(topology.subset_points(scoped)), scoped))


ROLLUP_SQL = """rolled AS (SELECT region_id, name, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.25) AS q25,
  quantile_cont(value, 0.75) AS q75 FROM summary_rows WHERE scope <> 'region' GROUP BY 1, 2),
rollup_rows AS (SELECT region_id, 'patch_' || name || '_' || s AS name, CASE s WHEN 'mean' THEN mean WHEN 'std' THEN std WHEN 'q25' THEN q25 ELSE q75 END AS value
  FROM rolled CROSS JOIN (VALUES ('mean'), ('std'), ('q25'), ('q75')) t(s))"""


@query(
    "a13_patch_rollup",
    with_views(
        *NORM, PATCH_SQL, PATCH_POINTS_SQL, tree_sql(), "scopes AS (SELECT DISTINCT region_id, scope FROM patches)",
        SUMMARY_SQL, ROLLUP_SQL, "SELECT region_id, name, round(value, 6) + 0.0::DOUBLE AS value FROM rollup_rows",
    ),
)
def patch_rollup(spark, sf):
    cells, bounds = normalized(spark, sf)
    placed = topology.assign_patches(cells)
    bars = topology.diagrams(topology.subset_points(placed), (0,))
    rows = cut_lineage(topology.diagram_summary(bars, placed, dims=(0,)))
    return long_form(composition.patch_rollup(rows, bounds=bounds))


BOTH_SCOPES = (
    PATCH_SQL,
    "region_points AS (" + POINTS_SQL.split("AS (", 1)[1],
    "patch_points AS (" + PATCH_POINTS_SQL.split("AS (", 1)[1],
    "subset_points AS (SELECT * FROM region_points UNION ALL SELECT * FROM patch_points)",
    tree_sql(),
    "scopes AS (SELECT DISTINCT region_id, 'region' AS scope FROM norm UNION ALL SELECT DISTINCT region_id, scope FROM patches)",
    SUMMARY_SQL, ROLLUP_SQL,
    "f1 AS (SELECT region_id, name, value FROM summary_rows WHERE scope = 'region' UNION ALL SELECT region_id, name, value FROM rollup_rows)",
)


@query("t12_connected_features", with_views(*NORM, *BOTH_SCOPES, "SELECT region_id, name, round(value, 6) + 0.0::DOUBLE AS value FROM f1"))
def connected_topology_features(spark, sf):
    """The part of the topology family that SQL can check: connected components, without loops."""
    cells, bounds = normalized(spark, sf)
    return long_form(topology.topology_features(cells, bounds=bounds, dims=(0,)))


@query("t12_topology_features")
def topology_features(spark, sf):
    cells, bounds = normalized(spark, sf)
    return long_form(topology.topology_features(cells, bounds=bounds))
