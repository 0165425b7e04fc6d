"""Neighbour graphs, graph statistics, boundary matrices and message passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.operators import composition, graphs, ingest
from cytoplane.operators import neighbors as N
from cytoplane.operators import region_graphs as R
from cytoplane.operators.triangulation import delaunay_edges
from cytoplane.session import cut_lineage, measured
from workload import views as V
from workload.q_composition import PAIRS_SQL, SPACING_SQL, long_form
from workload.q_ingest import r6
from workload.registry import query, with_views

BASE = (V.CELLS_SQL, PAIRS_SQL)


def pairs_of(source: str, prefix: str) -> str:
    return f"""{prefix}pairs AS (SELECT a.region_id, a.cell_id AS src, b.cell_id AS dst,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
  FROM {source} a JOIN {source} b ON a.region_id = b.region_id AND a.cell_id <> b.cell_id),
{prefix}ranked AS (SELECT *, row_number() OVER (PARTITION BY region_id, src ORDER BY dist, dst) AS rank,
  count(*) OVER (PARTITION BY region_id, src) AS others FROM {prefix}pairs)"""


NORM_SQL = """norm AS (SELECT c.region_id, cell_id, x / scale AS x, y / scale AS y, cell_type, compartment
  FROM cells c JOIN spacing USING (region_id))"""
NORM = (*BASE, SPACING_SQL, NORM_SQL)

MUTUAL_SQL = """mutual AS (SELECT region_id, least(src, dst) AS src, greatest(src, dst) AS dst, min(dist) AS dist
  FROM nranked WHERE rank <= 10 GROUP BY 1, 2, 3 HAVING count(*) = 2)"""

TRIANGULATION_SQL = """sides AS (SELECT a.region_id, a.cell_id AS src, b.cell_id AS dst,
    (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn,
    (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) AS dot
  FROM norm a JOIN norm b ON a.region_id = b.region_id AND a.cell_id < b.cell_id
  JOIN norm c ON a.region_id = c.region_id AND c.cell_id <> a.cell_id AND c.cell_id <> b.cell_id),
delaunay AS (SELECT region_id, src, dst FROM sides GROUP BY 1, 2, 3
  HAVING coalesce(max(CASE WHEN turn < 0 THEN dot / turn END), '-inf'::DOUBLE) < coalesce(min(CASE WHEN turn > 0 THEN dot / turn END), 'inf'::DOUBLE)
     AND count(*) FILTER (turn = 0 AND dot < 0) = 0),
typed AS (SELECT e.region_id, e.src, e.dst, a.cell_type AS src_type, b.cell_type AS dst_type FROM delaunay e
  JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst),
ways AS (SELECT region_id, src, dst FROM delaunay UNION ALL SELECT region_id, dst, src FROM delaunay),
degree AS (SELECT c.region_id, c.cell_id, count(w.dst) AS degree FROM cells c
  LEFT JOIN ways w ON c.region_id = w.region_id AND c.cell_id = w.src GROUP BY 1, 2)"""
DELAUNAY = (*NORM, TRIANGULATION_SQL)

UNDIRECTED_SQL = "und AS (SELECT DISTINCT region_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM ranked WHERE rank <= 6)"
TRIANGLES_SQL = """tri AS (SELECT e1.region_id, e1.src AS a, e1.dst AS b, e2.dst AS c FROM {e} e1
  JOIN {e} e2 ON e1.region_id = e2.region_id AND e1.dst = e2.src
  JOIN {e} e3 ON e1.region_id = e3.region_id AND e3.src = e1.src AND e3.dst = e2.dst)"""


def normalized(spark, sf):
    """Normalised cells with the measured bounds."""
    cells = V.cells(spark, sf)
    bounds = measured(cells)
    return composition.normalize(cells, bounds=bounds), bounds


def scaled_cells(spark, sf):
    cells = V.cells(spark, sf)
    bounds = measured(cells)
    return R.scale_coordinates(cells, bounds=bounds), bounds


def scaled_lists(spark, sf):
    scaled, bounds = scaled_cells(spark, sf)
    return scaled, R.neighbour_table(scaled, bounds=bounds), bounds


def edge_rows(edges):
    return edges.select("region_id", "src", "dst", r6(F.col("dist"), "dist"))


@query("j5_pairs_within_radius", with_views(*BASE, "SELECT region_id, src, dst, round(dist, 6) AS dist FROM pairs WHERE dist <= 8"))
def pairs_within_radius(spark, sf):
    return edge_rows(N.within_radius(V.cells(spark, sf), F.lit(8.0)))


KNN_SQL = with_views(*BASE, "SELECT region_id, src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")


@query("g1_knn", KNN_SQL)
def knn(spark, sf):
    return N.knn(V.cells(spark, sf), 10).withColumn("dist", F.round("dist", 6))


SKEWED_SQL = """cells AS (SELECT cell_id, if(region_id % 2 = 0, 0, region_id) AS region_id, if(cell_id % 4999 = 7, x + 1000000, x) AS x, y FROM single)"""
SKEWED = (V.CELLS_SQL.replace("cells AS", "single AS", 1), SKEWED_SQL, PAIRS_SQL)


def skewed_cells(spark, sf):
    """Half of all regions as one, with few cells far away."""
    cells = V.cells(spark, sf)
    region = F.when(F.col("region_id") % 2 == 0, F.lit(0).cast("long")).otherwise(F.col("region_id"))
    far = F.when(F.col("cell_id") % 4999 == 7, F.col("x") + 1e6).otherwise(F.col("x"))
    return cells.select("cell_id", region.alias("region_id"), far.alias("x"), "y")


@query("g1_knn_skewed", with_views(*SKEWED, "SELECT region_id, src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"))
def knn_skewed(spark, sf):
    return N.knn(skewed_cells(spark, sf), 5).withColumn("dist", F.round("dist", 6))


@query("j5_pairs_skewed", with_views(*SKEWED, "SELECT region_id, src, dst, round(dist, 6) AS dist FROM pairs WHERE dist <= 0.6"))
def pairs_skewed(spark, sf):
    return edge_rows(N.within_radius(skewed_cells(spark, sf), F.lit(0.6)))


@query("w1_k_smallest", with_views(*BASE, "SELECT region_id, src, round(max(dist), 6) AS kth FROM ranked WHERE rank <= 6 GROUP BY 1, 2"))
def k_smallest(spark, sf):
    lists = N.neighbour_lists(V.cells(spark, sf), 6)
    return lists.select("region_id", "src", F.round(F.element_at("dist", -1), 6).alias("kth"))


@query("w2_median_of_first_k", with_views(*BASE, "SELECT region_id, src, round(quantile_cont(dist, 0.5), 6) AS median FROM ranked WHERE rank <= 6 GROUP BY 1, 2"))
def median_of_first_k(spark, sf):
    lists = N.neighbour_lists(V.cells(spark, sf), 6)
    return lists.select("region_id", "src", F.round(R._median_of_first(F.col("dist"), F.size("dist")), 6).alias("median"))


@query("j9_mutual_edges", with_views(*NORM, pairs_of("norm", "n"), MUTUAL_SQL, "SELECT region_id, src, dst FROM mutual"))
def mutual_edges(spark, sf):
    cells, bounds = normalized(spark, sf)
    return N.mutual(N.knn(cells, 10, bounds=bounds)).select("region_id", "src", "dst")


@query("g2_mutual_knn", with_views(*NORM, pairs_of("norm", "n"), MUTUAL_SQL, "SELECT region_id, src, dst, round(dist, 6) AS dist FROM mutual"))
def mutual_knn(spark, sf):
    cells, bounds = normalized(spark, sf)
    return edge_rows(N.mutual(N.knn(cells, 10, bounds=bounds)))


@query(
    "a9_pair_fractions",
    with_views(
        *NORM, pairs_of("norm", "n"), MUTUAL_SQL,
        """named AS (SELECT e.region_id, 'knn_pair_' || least(a.cell_type, b.cell_type) || '__' || greatest(a.cell_type, b.cell_type) AS name
             FROM mutual e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst)
           SELECT region_id, name, round(count(*) / sum(count(*)) OVER (PARTITION BY region_id), 6) AS value FROM named GROUP BY 1, 2""",
    ),
)
def pair_fractions(spark, sf):
    cells, bounds = normalized(spark, sf)
    return long_form(graphs.pair_fractions(graphs.typed_edges(N.mutual(N.knn(cells, 10, bounds=bounds)), cells)))


SCALED_SQL = """centre AS (SELECT region_id, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM cells GROUP BY 1),
nn AS (SELECT region_id, src, avg(dist) AS raw FROM ranked WHERE rank <= 6 GROUP BY 1, 2),
unit AS (SELECT region_id, greatest(quantile_cont(raw, 0.5), 1e-3) AS unit FROM nn WHERE raw > 0 GROUP BY 1),
scaled AS (SELECT c.region_id, c.cell_id, (x - mx) / unit AS x, (y - my) / unit AS y, raw / unit AS mean_nn, cell_type
  FROM cells c JOIN centre USING (region_id) JOIN unit USING (region_id) JOIN nn ON nn.region_id = c.region_id AND nn.src = c.cell_id)"""
SCALED = (*BASE, SCALED_SQL)
SPAIRS = pairs_of("scaled", "s")

GRAPH_SQL = """meds AS (SELECT region_id, src, quantile_cont(dist, 0.5) FILTER (rank <= 6) AS base_median,
    quantile_cont(dist, 0.5) FILTER (rank <= 12) AS own_median FROM sranked GROUP BY 1, 2),
regional AS (SELECT region_id, greatest(2.5 * quantile_cont(dist, 0.5), 1e-3) AS radius FROM sranked WHERE rank <= 6 GROUP BY 1),
base AS (SELECT r.* FROM sranked r JOIN meds USING (region_id, src) WHERE rank <= 6 OR dist <= 1.5 * greatest(base_median, 1e-6)),
expanded AS (SELECT * FROM sranked WHERE rank <= 12),
far AS (SELECT r.region_id, r.src, r.dst, r.dist, row_number() OVER (PARTITION BY r.region_id, r.src ORDER BY r.dist, r.dst) AS rank
  FROM sranked r JOIN meds USING (region_id, src) JOIN regional USING (region_id) WHERE dist > own_median AND dist <= radius),
long_range AS (SELECT region_id, src, dst, dist, rank FROM far WHERE rank <= 24
  UNION ALL SELECT region_id, src, dst, dist, 1 FROM sranked r WHERE rank = least(24, others)
    AND NOT EXISTS (SELECT 1 FROM far f WHERE f.region_id = r.region_id AND f.src = r.src))"""
GRAPHS = (*SCALED, SPAIRS, GRAPH_SQL)


@query("g7_scaled_coordinates", with_views(*SCALED, """SELECT cell_id, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y,
  round(mean_nn, 6) AS mean_nn FROM scaled"""))
def scaled_coordinates(spark, sf):
    rows = R.scale_coordinates(V.cells(spark, sf))
    return rows.select("cell_id", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(F.col("mean_nn"), "mean_nn"))


SUBSAMPLE_SQL = """placed AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY sqrt(x * x + y * y), cell_id) - 1 AS position,
  count(*) OVER (PARTITION BY region_id) AS n FROM scaled),
wanted AS (SELECT DISTINCT region_id, CASE WHEN i = 59 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 59.0::DOUBLE)) AS BIGINT) END AS position
  FROM (SELECT DISTINCT region_id, n FROM placed) CROSS JOIN range(60) t(i))"""


@query(
    "w3_radial_subsample",
    with_views(*SCALED, SUBSAMPLE_SQL, "SELECT region_id, cell_id FROM placed p WHERE n <= 60 OR EXISTS (SELECT 1 FROM wanted w WHERE w.region_id = p.region_id AND w.position = p.position)"),
)
def radial_subsample(spark, sf):
    scaled, bounds = scaled_cells(spark, sf)
    return R.subsample(scaled, 60, bounds).select("region_id", "cell_id")


def graph_select(view: str, scale: str) -> str:
    return f"SELECT region_id, '{scale}' AS scale, src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM {view}"


def graph_rows(rows):
    return rows.select("region_id", "scale", "src", "dst", F.round("dist", 6).alias("dist"), "rank")


@query("g3_adaptive_knn", with_views(*GRAPHS, graph_select("base", "base")))
def adaptive_knn(spark, sf):
    scaled, table, bounds = scaled_lists(spark, sf)
    return graph_rows(R.base_graph(scaled, table, bounds=bounds))


@query("g4_plain_knn_mode", with_views(*GRAPHS, "SELECT region_id, 'base' AS scale, src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM sranked WHERE rank <= 6"))
def plain_knn_mode(spark, sf):
    scaled, table, bounds = scaled_lists(spark, sf)
    return graph_rows(R.base_graph(scaled, table, "knn", bounds))


@query("g5_expanded_knn", with_views(*GRAPHS, graph_select("expanded", "expanded")))
def expanded_knn(spark, sf):
    _, table, _ = scaled_lists(spark, sf)
    return graph_rows(R.expanded_graph(table))


@query("g6_global_graph", with_views(*GRAPHS, graph_select("long_range", "global")))
def global_graph(spark, sf):
    scaled, table, bounds = scaled_lists(spark, sf)
    return graph_rows(R.global_graph(scaled, table, bounds=bounds))


@query(
    "g21_region_examples",
    with_views(
        *GRAPHS, V.REGIONS_SQL,
        """counts AS (SELECT region_id, 'base' AS scale, count(*) AS n_edges, sum(dist) AS total FROM base GROUP BY 1
             UNION ALL SELECT region_id, 'expanded', count(*), sum(dist) FROM expanded GROUP BY 1
             UNION ALL SELECT region_id, 'global', count(*), sum(dist) FROM long_range GROUP BY 1)
           SELECT region_id, patient_id, label, scale, (SELECT count(*) FROM scaled s WHERE s.region_id = c.region_id) AS n_cells,
                  n_edges, round(total, 4) AS total_dist FROM counts c JOIN regions USING (region_id)""",
    ),
)
def region_examples(spark, sf):
    from cytoplane.plans.examples import region_examples as build

    example = build(V.cells(spark, sf), V.used_regions(spark, sf), V.CELL_TYPES)
    sizes = example.cells.groupBy("region_id", "patient_id", "label").agg(F.count("*").alias("n_cells"))
    totals = example.edges.groupBy("region_id", "scale").agg(
        F.count("*").alias("n_edges"), F.round(F.sum("dist"), 4).alias("total_dist")
    )
    return sizes.join(totals, "region_id").select(
        "region_id", "patient_id", "label", "scale", "n_cells", "n_edges", "total_dist"
    )


@query("g8_delaunay_edges", with_views(*DELAUNAY, "SELECT region_id, src, dst FROM delaunay"))
def delaunay(spark, sf):
    cells, bounds = normalized(spark, sf)
    return delaunay_edges(cells, bounds).select("region_id", "src", "dst")


@query(
    "a11_degree_summary",
    with_views(
        *DELAUNAY,
        """SELECT region_id, round(avg(degree), 6) AS graph_degree_mean, round(stddev_pop(degree), 6) AS graph_degree_std,
           CAST(max(degree) AS DOUBLE) AS graph_degree_max FROM degree GROUP BY 1""",
    ),
)
def degree_summary(spark, sf):
    cells, bounds = normalized(spark, sf)
    rows = graphs.degree_summary(delaunay_edges(cells, bounds), cells)
    return rows.select("region_id", r6(F.col("graph_degree_mean"), "graph_degree_mean"), r6(F.col("graph_degree_std"), "graph_degree_std"), "graph_degree_max")


@query(
    "a12_mixing_entropy",
    with_views(
        *DELAUNAY,
        """mixed AS (SELECT region_id, least(src_type, dst_type) AS a, greatest(src_type, dst_type) AS b, count(*) AS n FROM typed GROUP BY 1, 2, 3),
           shares AS (SELECT region_id, n / sum(n) OVER (PARTITION BY region_id) AS p FROM mixed)
           SELECT region_id, 'graph_edge_type_entropy' AS name, round(sum(-p * ln(p + 1e-12)), 6) AS value FROM shares GROUP BY 1""",
    ),
)
def mixing_entropy(spark, sf):
    cells, bounds = normalized(spark, sf)
    return long_form(graphs.mixing_entropy(graphs.typed_edges(delaunay_edges(cells, bounds), cells), cells))


SPARSE_SQL = """sparse AS (SELECT a.region_id, a.src, a.dst FROM ranked a JOIN ranked b
  ON a.region_id = b.region_id AND a.src = b.dst AND a.dst = b.src WHERE a.rank <= 3 AND b.rank <= 3)"""


@query(
    "g9_components",
    with_views(
        *BASE, SPARSE_SQL,
        "SELECT region_id, count(*) AS cells, count(DISTINCT component) AS components, CAST(sum(component) AS BIGINT) AS checksum FROM found GROUP BY 1",
    ).replace("WITH cells", "WITH RECURSIVE cells", 1).replace(
        "\nSELECT region_id, count(*) AS cells, count(DISTINCT",
        """, reach AS (SELECT region_id, cell_id, cell_id AS other FROM cells
             UNION SELECT r.region_id, r.cell_id, s.dst FROM reach r JOIN sparse s ON r.region_id = s.region_id AND r.other = s.src),
           found AS (SELECT region_id, cell_id, min(other) AS component FROM reach GROUP BY 1, 2)
SELECT region_id, count(*) AS cells, count(DISTINCT""", 1),
)
def components(spark, sf):
    cells = V.cells(spark, sf)
    found = graphs.components(N.mutual(N.knn(cells, 3)), cells)
    return found.groupBy("region_id").agg(
        F.count("*").alias("cells"), F.countDistinct("component").alias("components"), F.sum("component").alias("checksum")
    )


@query(
    "g10_clustering",
    with_views(
        *DELAUNAY, TRIANGLES_SQL.format(e="delaunay"),
        """corner AS (SELECT region_id, unnest([a, b, c]) AS cell_id FROM tri),
           closed AS (SELECT region_id, cell_id, count(*) AS t FROM corner GROUP BY 1, 2)
           SELECT region_id, round(avg(CASE WHEN degree >= 2 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS graph_clustering_mean
           FROM degree LEFT JOIN closed USING (region_id, cell_id) GROUP BY 1""",
    ),
)
def clustering(spark, sf):
    cells, bounds = normalized(spark, sf)
    rows = graphs.clustering(cut_lineage(delaunay_edges(cells, bounds)), cells)
    return rows.select("region_id", r6(F.col("graph_clustering_mean"), "graph_clustering_mean"))


@query(
    "g11_assortativity",
    with_views(
        *DELAUNAY,
        """tw AS (SELECT region_id, src_type AS p, dst_type AS q FROM typed UNION ALL SELECT region_id, dst_type, src_type FROM typed),
           m AS (SELECT region_id, p, count(*) AS n, count(*) FILTER (p = q) AS same FROM tw GROUP BY 1, 2),
           s AS (SELECT region_id, sum(n) AS t, sum(same) AS same, sum(n * n) AS sq FROM m GROUP BY 1)
           SELECT region_id, 'graph_assortativity' AS name, round((same / t - sq / (t * t)) / (1 - sq / (t * t)), 6) + 0.0::DOUBLE AS value FROM s""",
    ),
)
def assortativity(spark, sf):
    cells, bounds = normalized(spark, sf)
    return long_form(graphs.assortativity(graphs.typed_edges(delaunay_edges(cells, bounds), cells), cells))


def undirected(spark, sf):
    return N.undirected(N.knn(V.cells(spark, sf), 6))


@query("g12_undirected_edges", with_views(*BASE, UNDIRECTED_SQL, "SELECT * FROM und"))
def undirected_edges(spark, sf):
    return undirected(spark, sf).select("region_id", "src", "dst")


HODGE = (*BASE, UNDIRECTED_SQL, TRIANGLES_SQL.format(e="und"))


@query("j8_triangles", with_views(*HODGE, "SELECT region_id, a, b, c FROM tri"))
def triangles(spark, sf):
    return graphs.triangles(undirected(spark, sf))


B_SQL = """e AS (SELECT region_id, CAST(src AS VARCHAR) AS u, CAST(dst AS VARCHAR) AS v FROM und),
t AS (SELECT region_id, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(c AS VARCHAR) AS c FROM tri),
b1 AS (SELECT region_id, u AS "row", u || '|' || v AS col, -1.0::DOUBLE AS value FROM e UNION ALL SELECT region_id, v, u || '|' || v, 1.0 FROM e),
b2 AS (SELECT region_id, b || '|' || c AS "row", a || '|' || b || '|' || c AS col, 1.0::DOUBLE AS value FROM t
  UNION ALL SELECT region_id, a || '|' || c, a || '|' || b || '|' || c, -1.0 FROM t
  UNION ALL SELECT region_id, a || '|' || b, a || '|' || b || '|' || c, 1.0 FROM t)"""


def boundaries(spark, sf):
    edges = cut_lineage(undirected(spark, sf).select("region_id", "src", "dst"))
    return graphs.node_boundary(edges), graphs.edge_boundary(cut_lineage(graphs.triangles(edges)))


@query("g13_boundary_matrices", with_views(*HODGE, B_SQL, """SELECT 'B1' AS matrix, * FROM b1 UNION ALL SELECT 'B2', * FROM b2"""))
def boundary_matrices(spark, sf):
    b1, b2 = boundaries(spark, sf)
    rows = b1.withColumn("matrix", F.lit("B1")).unionByName(b2.withColumn("matrix", F.lit("B2")))
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("row", "col")})


def product_sql(name: str, left: str, right: str) -> str:
    return f"""SELECT '{name}' AS matrix, region_id, count(*) AS entries, CAST(sum(value) AS DOUBLE) AS total, CAST(sum(value * value) AS DOUBLE) AS squares
      FROM (SELECT l.region_id, l.r, m.c, sum(l.v * m.v) AS value FROM {left} l JOIN {right} m ON l.region_id = m.region_id AND l.c = m.r
            GROUP BY 1, 2, 3 HAVING sum(l.v * m.v) <> 0) GROUP BY region_id"""


def turned(name: str, straight: bool) -> str:
    return f"""(SELECT region_id, {'"row"' if straight else 'col'} AS r, {'col' if straight else '"row"'} AS c, value AS v FROM {name})"""


@query(
    "g14_hodge_laplacians",
    with_views(
        *HODGE, B_SQL,
        " UNION ALL ".join(
            (
                product_sql("L0", turned("b1", True), turned("b1", False)),
                product_sql("L1_down", turned("b1", False), turned("b1", True)),
                product_sql("L1_up", turned("b2", True), turned("b2", False)),
                product_sql("L2", turned("b2", False), turned("b2", True)),
            )
        ),
    ),
)
def hodge_laplacians(spark, sf):
    parts = [
        m.groupBy("region_id").agg(
            F.count("*").alias("entries"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares")
        ).withColumn("matrix", F.lit(name))
        for name, m in graphs.hodge_laplacians(*boundaries(spark, sf)).items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "g15_polynomial_filter",
    with_views(
        *HODGE,
        """w AS (SELECT region_id, src, dst FROM und UNION ALL SELECT region_id, dst, src FROM und),
           f0 AS (SELECT region_id, cell_id, marker_v AS f FROM cells),
           f1 AS (SELECT a.region_id, a.cell_id, count(*) * any_value(a.f) - sum(b.f) AS f FROM f0 a JOIN w ON w.src = a.cell_id JOIN f0 b ON b.cell_id = w.dst GROUP BY 1, 2),
           f2 AS (SELECT a.region_id, a.cell_id, count(*) * any_value(a.f) - sum(b.f) AS f FROM f1 a JOIN w ON w.src = a.cell_id JOIN f1 b ON b.cell_id = w.dst GROUP BY 1, 2)
           SELECT f0.region_id, CAST(f0.cell_id AS VARCHAR) AS key, round(0.5 * f0.f + 0.3 * f1.f + 0.2 * f2.f, 5) + 0.0::DOUBLE AS value
           FROM f0 JOIN f1 USING (cell_id) JOIN f2 USING (cell_id)""",
    ),
)
def polynomial_filter(spark, sf):
    b1 = graphs.node_boundary(cut_lineage(undirected(spark, sf).select("region_id", "src", "dst")))
    signal = V.cells(spark, sf).select("region_id", F.array("cell_id").alias("key"), F.col("marker_v").alias("value"))
    rows = graphs.polynomial_filter(b1, signal, [0.5, 0.3, 0.2], "row")
    return rows.select("region_id", F.get("key", 0).cast("string").alias("key"), (F.round("value", 5) + 0.0).alias("value"))


STATE = ["marker_k", "marker_v"]


def message_sql(k: str, v: str) -> str:
    return with_views(
        *BASE,
        f"""got AS (SELECT r.region_id, r.src, avg(c.marker_k) AS mk, avg(c.marker_v) AS mv, sum(c.marker_k) AS sk, sum(c.marker_v) AS sv, count(*) AS n
              FROM ranked r JOIN cells c ON c.cell_id = r.dst WHERE r.rank <= 6 GROUP BY 1, 2)
            SELECT c.region_id, c.cell_id, round({k}, 6) + 0.0::DOUBLE AS marker_k, round({v}, 6) + 0.0::DOUBLE AS marker_v
            FROM cells c JOIN got ON got.src = c.cell_id""",
    )


def state_rows(rows):
    return rows.select("region_id", "cell_id", *[r6(F.col(n), n) for n in STATE])


@query("j7_neighbour_gather", with_views(*BASE, "SELECT r.region_id, r.src, r.dst, c.marker_k, c.marker_v FROM ranked r JOIN cells c ON c.cell_id = r.dst WHERE rank <= 6"))
def neighbour_gather(spark, sf):
    cells = V.cells(spark, sf)
    return graphs.gather(N.knn(cells, 6), cells, STATE)


@query("g16_neighbour_mean", message_sql("mk", "mv"))
def neighbour_mean(spark, sf):
    cells = V.cells(spark, sf)
    return state_rows(graphs.neighbour_mean(N.knn(cells, 6), cells, STATE))


@query("g17_inclusive_mean", message_sql("(sk + marker_k) / (n + 1)", "(sv + marker_v) / (n + 1)"))
def inclusive_mean(spark, sf):
    cells = V.cells(spark, sf)
    return state_rows(graphs.inclusive_mean(N.knn(cells, 6), cells, STATE))


@query("g18_weighted_sum", message_sql("marker_k * 1.25 + sk", "marker_v * 1.25 + sv"))
def weighted_sum(spark, sf):
    cells = V.cells(spark, sf)
    return state_rows(graphs.weighted_sum(N.knn(cells, 6), cells, STATE, 0.25))


@query(
    "g19_attention",
    with_views(
        *BASE,
        """st AS (SELECT region_id, cell_id, marker_k / 100 AS marker_k, marker_v / 100 AS marker_v FROM cells),
           sc AS (SELECT r.region_id, r.src, b.marker_k AS k, b.marker_v AS v, (a.marker_k * b.marker_k + a.marker_v * b.marker_v) / sqrt(2.0::DOUBLE) AS s
             FROM ranked r JOIN st a ON a.cell_id = r.src JOIN st b ON b.cell_id = r.dst WHERE r.rank <= 6),
           mx AS (SELECT *, exp(s - max(s) OVER (PARTITION BY region_id, src)) AS e FROM sc)
           SELECT region_id, src AS cell_id, round(sum(e * k) / sum(e), 6) + 0.0::DOUBLE AS marker_k, round(sum(e * v) / sum(e), 6) + 0.0::DOUBLE AS marker_v FROM mx GROUP BY 1, 2""",
    ),
)
def attention(spark, sf):
    cells = V.cells(spark, sf)
    state = cells.select("region_id", "cell_id", *[(F.col(n) / 100).alias(n) for n in STATE])
    return state_rows(graphs.attention(N.knn(cells, 6), state, STATE))


DROP_SQL = """survivors AS (SELECT region_id, cell_id FROM cells
  WHERE ('0x' || substr(md5('42:' || CAST(cell_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE > 0.15)"""


@query(
    "g20_cell_drop",
    with_views(
        *BASE, DROP_SQL,
        """SELECT region_id, src, dst FROM ranked WHERE rank <= 6 AND src IN (SELECT cell_id FROM survivors) AND dst IN (SELECT cell_id FROM survivors)""",
    ),
)
def cell_drop(spark, sf):
    cells = V.cells(spark, sf)
    kept = R.drop_cells(cells, 0.15, 42)
    return R.surviving_edges(N.knn(cells, 6), kept).select("region_id", "src", "dst")


@query(
    "a14_neighbour_types",
    with_views(
        *GRAPHS,
        """n AS (SELECT b.region_id, b.src, c.cell_type, count(*) AS n FROM base b JOIN cells c ON c.cell_id = b.dst GROUP BY 1, 2, 3)
           SELECT region_id, src, cell_type, round(n / sum(n) OVER (PARTITION BY region_id, src), 6) AS share FROM n""",
    ),
)
def neighbour_types(spark, sf):
    scaled, table, bounds = scaled_lists(spark, sf)
    rows = R.neighbour_types(R.base_graph(scaled, table, bounds=bounds), scaled)
    return rows.select("region_id", "src", "cell_type", F.round("share", 6).alias("share"))


STRUCTURE = ["x", "y", "radius", "mean_nn", "density", *[f"is_{t}" for t in V.CELL_TYPES], *[f"near_{t}" for t in V.CELL_TYPES]]


@query(
    "a15_structural_vectors",
    with_views(
        *GRAPHS,
        "near AS (SELECT b.region_id, b.src, " + ", ".join(f"avg(CASE WHEN c.cell_type = '{t}' THEN 1.0::DOUBLE ELSE 0 END) AS near_{t}" for t in V.CELL_TYPES)
        + " FROM base b JOIN cells c ON c.cell_id = b.dst GROUP BY 1, 2),"
        + " v AS (SELECT s.region_id, s.cell_id, x, y, sqrt(x * x + y * y) AS radius, mean_nn, 1 / greatest(mean_nn, 1e-3) AS density, "
        + ", ".join(f"CASE WHEN cell_type = '{t}' THEN 1.0::DOUBLE ELSE 0 END AS is_{t}" for t in V.CELL_TYPES)
        + ", " + ", ".join(f"near_{t}" for t in V.CELL_TYPES) + " FROM scaled s JOIN near n ON n.src = s.cell_id)"
        + " SELECT region_id, cell_id, " + ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in STRUCTURE) + " FROM v",
    ),
)
def structural_vectors(spark, sf):
    scaled, table, bounds = scaled_lists(spark, sf)
    rows = R.structural_vectors(scaled, R.base_graph(scaled, table, bounds=bounds), V.CELL_TYPES)
    return rows.select("region_id", "cell_id", *[r6(F.col(n), n) for n in STRUCTURE])


@query(
    "a16_region_pooling",
    with_views(
        *BASE,
        """got AS (SELECT r.region_id, r.src, avg(c.marker_k) AS marker_k, avg(c.marker_v) AS marker_v
             FROM ranked r JOIN cells c ON c.cell_id = r.dst WHERE r.rank <= 6 GROUP BY 1, 2),
           l AS (SELECT region_id, 'marker_k' AS name, marker_k AS value FROM got UNION ALL SELECT region_id, 'marker_v', marker_v FROM got)
           SELECT region_id, name, round(avg(value), 9) AS mean, round(max(value), 6) AS max, round(var_pop(value), 5) AS variance,
                  round(ln(1 + count(*)), 6) AS log_count FROM l GROUP BY 1, 2""",
    ),
)
def region_pooling(spark, sf):
    cells = V.cells(spark, sf)
    state = graphs.neighbour_mean(N.knn(cells, 6), cells, STATE)
    rows = composition.pool(state.unpivot(["region_id", "cell_id"], STATE, "name", "value"))
    return rows.select(
        "region_id", "name", F.round("mean", 9).alias("mean"), F.round("max", 6).alias("max"),
        F.round("variance", 5).alias("variance"), F.round("log_count", 6).alias("log_count"),
    )
