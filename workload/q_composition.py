"""Composition and distance features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.operators import composition
from cytoplane.session import measured
from workload import views as V
from workload.q_ingest import r6, role_sql
from workload.registry import query, with_views

EXTENT_SQL = """extent AS (SELECT region_id, CAST(count(*) AS DOUBLE) AS cell_count,
  greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-6::DOUBLE) AS bbox_area FROM cells GROUP BY 1)"""

PAIRS_SQL = """pairs AS (SELECT a.region_id, a.cell_id AS src, b.cell_id AS dst,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
  FROM cells a JOIN cells b ON a.region_id = b.region_id AND a.cell_id <> b.cell_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY region_id, src ORDER BY dist, dst) AS rank FROM pairs)"""

SPACING_SQL = """spacing AS (SELECT region_id, coalesce(CASE WHEN m > 0 THEN m ELSE 1 END, 1) AS scale FROM
  (SELECT region_id, quantile_cont(dist, 0.5) AS m FROM ranked WHERE rank <= 5 GROUP BY 1))"""


def long_form(rows):
    return rows.select("region_id", "name", r6(F.col("value"), "value"))


@query(
    "a5_extent",
    with_views(
        V.CELLS_SQL, EXTENT_SQL,
        """SELECT region_id, cell_count, round(bbox_area, 6) + 0.0::DOUBLE AS bbox_area,
           round(cell_count / bbox_area, 6) + 0.0::DOUBLE AS cell_density FROM extent""",
    ),
)
def extent(spark, sf):
    rows = composition.extent(V.cells(spark, sf))
    return rows.select("region_id", "cell_count", r6(F.col("bbox_area"), "bbox_area"), r6(F.col("cell_density"), "cell_density"))


def proportion_sql(column: str, prefix: str) -> str:
    return f"""SELECT region_id, '{prefix}' || replace(lower({column}), ' ', '_') AS name,
      round(count(*) / sum(count(*)) OVER (PARTITION BY region_id), 6) + 0.0::DOUBLE AS value FROM cells GROUP BY region_id, {column}"""


@query("a6_celltype_proportions", with_views(V.CELLS_SQL, proportion_sql("cell_type", "prop_celltype_")))
def celltype_proportions(spark, sf):
    return long_form(composition.proportions(V.cells(spark, sf), "cell_type", "prop_celltype_"))


@query("a7_compartment_proportions", with_views(V.CELLS_SQL, proportion_sql("compartment", "prop_compartment_")))
def compartment_proportions(spark, sf):
    return long_form(composition.proportions(V.cells(spark, sf), "compartment", "prop_compartment_"))


@query("a8_median_spacing", with_views(V.CELLS_SQL, PAIRS_SQL, SPACING_SQL, "SELECT region_id, round(scale, 6) AS scale FROM spacing"))
def median_spacing(spark, sf):
    return composition.median_spacing(V.cells(spark, sf)).select("region_id", F.round("scale", 6).alias("scale"))


ROLE_MINS_SQL = "mins AS (" + " UNION ALL ".join(
    f"""SELECT a.region_id, 'tumor_to_{target}' AS pair, a.cell_id AS src,
  min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / scale) AS dist
  FROM cells a JOIN cells b ON a.region_id = b.region_id JOIN spacing s ON a.region_id = s.region_id
  WHERE {role_sql('tumor', 'a.cell_type')} AND {role_sql(target, 'b.cell_type')} GROUP BY 1, 2, 3"""
    for target in ("immune", "cd8", "macrophage")
) + ")"


@query(
    "j6_nearest_of_role",
    with_views(V.CELLS_SQL, PAIRS_SQL, SPACING_SQL, ROLE_MINS_SQL, "SELECT region_id, pair, src, round(dist, 6) AS dist FROM mins"),
)
def nearest_of_role(spark, sf):
    cells = V.cells(spark, sf)
    bounds = measured(cells)
    rows = composition.role_distances(composition.normalize(cells, bounds=bounds), bounds=bounds)
    return rows.select("region_id", "pair", "src", F.round("dist", 6).alias("dist"))


DISTANCE_SQL = """distance_stats AS (SELECT region_id, pair, min(dist) AS min, avg(dist) AS mean, quantile_cont(dist, 0.5) AS median FROM mins GROUP BY 1, 2),
distance_scaffold AS (SELECT DISTINCT region_id, unnest(['tumor_to_immune', 'tumor_to_cd8', 'tumor_to_macrophage']) AS pair FROM cells),
distance_rows AS (SELECT region_id, pair || '_' || stat AS name, coalesce(CASE stat WHEN 'min' THEN min WHEN 'mean' THEN mean ELSE median END, 0) AS value
  FROM distance_scaffold LEFT JOIN distance_stats USING (region_id, pair) CROSS JOIN (VALUES ('min'), ('mean'), ('median')) t(stat))"""


@query(
    "a10_distance_summary",
    with_views(
        V.CELLS_SQL, PAIRS_SQL, SPACING_SQL, ROLE_MINS_SQL, DISTANCE_SQL,
        "SELECT region_id, name, round(value, 6) AS value FROM distance_rows",
    ),
)
def distance_summary(spark, sf):
    cells = V.cells(spark, sf)
    bounds = measured(cells)
    return long_form(composition.distance_summary(composition.normalize(cells, bounds=bounds), bounds=bounds))
