"""Feature tables, models, the cross-validated study, reports, and round trips through storage."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators import composition, graphs, learning, scoring, topology
from cytoplane.operators import neighbors as N
from cytoplane.operators.ingest import attach_metadata, encode
from cytoplane.plans import features as P
from cytoplane.plans import report
from cytoplane.plans.study import Head, compare_families, cross_validate
from cytoplane.session import cut_lineage, measured, shared_folder
from cytoplane.settings import StudySettings
from cytoplane.sources import tables
from workload import views as V
from workload.q_composition import DISTANCE_SQL, EXTENT_SQL, ROLE_MINS_SQL, long_form
from workload.q_graphs import DELAUNAY, MUTUAL_SQL, NORM, STATE, TRIANGLES_SQL, pairs_of
from workload.q_ingest import r6
from workload.q_scoring import MEANS_SQL, METRICS_SQL, metric_means, metric_rows
from workload.q_topology import BOTH_SCOPES, POINTS_SQL, SCOPES_SQL, SUMMARY_SQL, tree_sql
from workload.registry import query, with_views

F0_SQL = (
    *DELAUNAY, EXTENT_SQL, ROLE_MINS_SQL, DISTANCE_SQL, pairs_of("norm", "n"), MUTUAL_SQL, TRIANGLES_SQL.format(e="delaunay"),
    """tri_corner AS (SELECT region_id, unnest([a, b, c]) AS cell_id FROM tri),
closed AS (SELECT region_id, cell_id, count(*) AS t FROM tri_corner GROUP BY 1, 2),
reach AS (SELECT region_id, cell_id, cell_id AS other FROM cells
  UNION SELECT r.region_id, r.cell_id, w.dst FROM reach r JOIN ways w ON r.region_id = w.region_id AND r.other = w.src),
component AS (SELECT region_id, cell_id, min(other) AS component FROM reach GROUP BY 1, 2),
pair_names AS (SELECT e.region_id, 'knn_pair_' || least(a.cell_type, b.cell_type) || '__' || greatest(a.cell_type, b.cell_type) AS name
  FROM mutual e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst),
tw AS (SELECT region_id, src_type AS p, dst_type AS q FROM typed UNION ALL SELECT region_id, dst_type, src_type FROM typed),
am AS (SELECT region_id, p, count(*) AS n, count(*) FILTER (p = q) AS same FROM tw GROUP BY 1, 2),
asum AS (SELECT region_id, sum(n) AS t, sum(same) AS same, sum(n * n) AS sq FROM am GROUP BY 1),
mixed AS (SELECT region_id, least(src_type, dst_type) AS a, greatest(src_type, dst_type) AS b, count(*) AS n FROM typed GROUP BY 1, 2, 3),
mixed_share AS (SELECT region_id, n / sum(n) OVER (PARTITION BY region_id) AS p FROM mixed),
f0 AS (
  SELECT region_id, 'cell_count' AS name, cell_count AS value FROM extent
  UNION ALL SELECT region_id, 'bbox_area', bbox_area FROM extent
  UNION ALL SELECT region_id, 'cell_density', cell_count / bbox_area FROM extent
  UNION ALL SELECT region_id, 'median_5nn_scale', scale FROM spacing
  UNION ALL SELECT region_id, 'prop_celltype_' || cell_type, count(*) / sum(count(*)) OVER (PARTITION BY region_id) FROM cells GROUP BY region_id, cell_type
  UNION ALL SELECT region_id, 'prop_compartment_' || compartment, count(*) / sum(count(*)) OVER (PARTITION BY region_id) FROM cells GROUP BY region_id, compartment
  UNION ALL SELECT region_id, name, count(*) / sum(count(*)) OVER (PARTITION BY region_id) FROM pair_names GROUP BY region_id, name
  UNION ALL SELECT region_id, name, value FROM distance_rows
  UNION ALL SELECT region_id, 'graph_degree_mean', avg(degree) FROM degree GROUP BY 1
  UNION ALL SELECT region_id, 'graph_degree_std', stddev_pop(degree) FROM degree GROUP BY 1
  UNION ALL SELECT region_id, 'graph_degree_max', max(degree) FROM degree GROUP BY 1
  UNION ALL SELECT region_id, 'graph_components', count(DISTINCT component) FROM component GROUP BY 1
  UNION ALL SELECT region_id, 'graph_clustering_mean', avg(CASE WHEN degree >= 2 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END)
    FROM degree LEFT JOIN closed USING (region_id, cell_id) GROUP BY 1
  UNION ALL SELECT region_id, 'graph_assortativity', (same / t - sq / (t * t)) / (1 - sq / (t * t)) FROM asum
  UNION ALL SELECT region_id, 'graph_edge_type_entropy', sum(-p * ln(p + 1e-12)) FROM mixed_share GROUP BY 1)""",
)


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("a20_baseline_features", recursive(with_views(*F0_SQL, "SELECT region_id, name, round(value, 6) + 0.0::DOUBLE AS value FROM f0")))
def baseline_features(spark, sf):
    return long_form(P.baseline_features(V.cells(spark, sf)))


@query(
    "t13_connected_feature_table",
    recursive(
        with_views(
            *F0_SQL, *BOTH_SCOPES, V.REGIONS_SQL,
            """families AS (SELECT region_id, 'F0' AS feature_family, name, value FROM f0 UNION ALL SELECT region_id, 'F1', name, value FROM f1)
               SELECT region_id, sample_id, patient_id, label, 'unassigned' AS split, feature_family, name, round(value, 6) + 0.0::DOUBLE AS value
               FROM families JOIN regions USING (region_id)""",
        )
    ),
)
def connected_feature_table(spark, sf):
    table = P.feature_table(V.cells(spark, sf), V.regions(spark, sf), dims=(0,))
    return table.withColumn("value", F.round("value", 6) + 0.0)


@query("t13_feature_table")
def feature_table(spark, sf):
    table = P.feature_table(V.cells(spark, sf), V.regions(spark, sf))
    return table.withColumn("value", F.round("value", 6))


def connected_features(spark, sf):
    """Extent and composition with the connected-component side of the topology family."""
    cells = V.cells(spark, sf)
    bounds = measured(cells)
    normalized = composition.normalize(cells, bounds=bounds)
    scoped = normalized.withColumn("scope", F.lit("region"))
    bars = topology.diagrams(topology.subset_points(scoped), (0,), bounds)
    f0 = composition.melt(composition.extent(cells), ["cell_count", "bbox_area", "cell_density"]).unionByName(
        composition.proportions(cells, "cell_type", "prop_celltype_")
    )
    f1 = topology.diagram_summary(bars, scoped, dims=(0,)).drop("scope")
    regions = V.regions(spark, sf)
    return attach_metadata(f0, regions, "F0").unionByName(attach_metadata(f1, regions, "F1"))


WIDE = ["cell_count", "cell_density", *[f"prop_celltype_{t}" for t in V.CELL_TYPES], "tumor_h0_count", "treg_h0_entropy", "union_tumor_cd8_h0_betti_area"]


@query(
    "j4_joined_families",
    with_views(
        *NORM, EXTENT_SQL, POINTS_SQL, tree_sql(), SCOPES_SQL, SUMMARY_SQL,
        """long_rows AS (SELECT region_id, 'cell_count' AS name, cell_count AS value FROM extent
             UNION ALL SELECT region_id, 'cell_density', cell_count / bbox_area FROM extent
             UNION ALL SELECT region_id, 'prop_celltype_' || cell_type, count(*) / sum(count(*)) OVER (PARTITION BY region_id) FROM cells GROUP BY region_id, cell_type
             UNION ALL SELECT region_id, name, value FROM summary_rows)
           SELECT region_id, """ + ", ".join(f"round(coalesce(max(value) FILTER (name = '{n}'), 0), 6) + 0.0::DOUBLE AS {n}" for n in WIDE)
        + " FROM long_rows GROUP BY 1",
    ),
)
def joined_families(spark, sf):
    wide, _ = P.engineered_features(cut_lineage(connected_features(spark, sf)))
    return wide.select("region_id", *[r6(F.col(n), n) for n in WIDE])


CASE_SQL = "union_tumor_cd8_h0_total_persistence"


@query(
    "w5_extreme_regions",
    with_views(
        *NORM, POINTS_SQL, tree_sql(), SCOPES_SQL, SUMMARY_SQL,
        f"""c AS (SELECT region_id, value FROM summary_rows WHERE name = '{CASE_SQL}')
           SELECT * FROM (SELECT 'lowest' AS "case", region_id, round(value, 6) AS value FROM c ORDER BY c.value, region_id LIMIT 1)
           UNION ALL SELECT * FROM (SELECT 'highest', region_id, round(value, 6) FROM c ORDER BY c.value DESC, region_id DESC LIMIT 1)""",
    ),
)
def extreme_regions(spark, sf):
    rows = report.extreme_regions(connected_features(spark, sf), CASE_SQL)
    return rows.select("case", "region_id", F.round("value", 6).alias("value"))


@query(
    "e22_runs_table",
    with_views(
        V.SCORES_SQL, METRICS_SQL, MEANS_SQL,
        "SELECT run, " + ", ".join(f"round(max(mean) FILTER (metric = '{m}'), 6) AS {m}" for m in ("auroc", "balanced_accuracy", "macro_f1", "brier_score"))
        + ", NULL::DOUBLE AS feature_stability FROM means GROUP BY 1",
    ),
)
def runs_table(spark, sf):
    rows = report.runs_table(metric_means(spark, sf))
    return rows.select("run", *[F.round(c, 6).alias(c) for c in rows.columns if c != "run"])


@query("e6_platt_fit")
def platt_fit(spark, sf):
    rows = learning.fit_platt(V.scores(spark, sf), ["run", "fold"], "main_logit")
    return rows.select("run", "fold", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("e9_calibrated_scores")
def calibrated_scores(spark, sf):
    """Parameters fitted on two folds of each run, applied to all of them."""
    scores = V.scores(spark, sf)
    _, parameters = learning.calibrate(scores.where("fold < 2"), ["run"], "main_logit", fit=True)
    applied, _ = learning.calibrate(scores, ["run"], "main_logit", parameters=parameters)
    return applied.select("run", "row_id", F.round("p", 6).alias("p"))


@query("e13_meta_combiner")
def meta_combiner(spark, sf):
    scores = V.scores(spark, sf)
    model = learning.fit_meta(scores, ["run"], ["main_p", "aux_p"])
    rows = learning.apply_meta(scores, ["run"], ["main_p", "aux_p"], model)
    return rows.select("run", "row_id", F.round("meta_p", 6).alias("meta_p"))


def light_features(spark, sf):
    """Extent and composition per region, wide."""
    cells = V.cells(spark, sf)
    rows = composition.melt(composition.extent(cells), ["cell_count", "bbox_area", "cell_density"]).unionByName(
        composition.proportions(cells, "cell_type", "prop_celltype_")
    )
    names = ["cell_count", "bbox_area", "cell_density", *[f"prop_celltype_{t}" for t in V.CELL_TYPES]]
    return P.widen(rows, names).na.fill(0.0), names


def engineered_rows(spark, sf):
    wide, names = light_features(spark, sf)
    return cut_lineage(wide.join(encode(V.used_regions(spark, sf), "label", "y"), "region_id")), names


@query("e14_engineered_classifier")
def engineered_classifier(spark, sf):
    rows, names = engineered_rows(spark, sf)
    scored = learning.score_engineered(learning.fit_engineered(rows, [], names), rows, [], names)
    return scored.select("region_id", "y", F.round("logit", 5).alias("logit"))


_BALANCE = "CASE WHEN y = 1 THEN n / (2.0 * positives) ELSE n / (2.0 * (n - positives)) END"
_LIGHT = ["cell_count", "bbox_area", "cell_density", *[f"prop_celltype_{t}" for t in V.CELL_TYPES]]


@query(
    "e14_optimality",
    with_views(
        V.CELLS_SQL, V.USED_REGIONS_SQL, EXTENT_SQL,
        """long_rows AS (SELECT region_id, 'cell_count' AS feature, cell_count::DOUBLE AS value FROM extent
             UNION ALL SELECT region_id, 'bbox_area', bbox_area FROM extent UNION ALL SELECT region_id, 'cell_density', cell_count / bbox_area FROM extent
             UNION ALL SELECT region_id, 'prop_celltype_' || cell_type, count(*) / sum(count(*)) OVER (PARTITION BY region_id) FROM cells GROUP BY region_id, cell_type),
           coded AS (SELECT region_id, CASE WHEN label = 'DII' THEN 1 ELSE 0 END AS y FROM used_regions),
           shape AS (SELECT count(*) AS n, sum(y) AS positives FROM coded),
           weighed AS (SELECT region_id, y, """ + _BALANCE + """ AS w FROM coded, shape)
           SELECT feature, round(sum(w * value), 3) AS weighted, round(sum(w * (0.5 - y) * value), 3) + 0.0::DOUBLE AS start_slope, 0.0::DOUBLE AS residual
           FROM long_rows JOIN weighed USING (region_id) GROUP BY 1""",
    ),
)
def optimality(spark, sf):
    """For each feature its weighted sum, the slope of the loss at zero, and how far the fit is from its optimality condition
    (relative to the weighted sum)."""
    rows, names = engineered_rows(spark, sf)
    model = learning.fit_engineered(rows, [], names)
    balance = learning.class_balance(rows, [])
    weight = F.when(F.col("y") == 1, F.col("weight_1")).otherwise(F.col("weight_0"))
    scored = learning.score_engineered(model, rows, [], names).crossJoin(F.broadcast(balance)).withColumn("w", weight)  # one row
    scored = scored.withColumn("error", C.sigmoid(F.col("logit")) - F.col("y"))
    long = scored.select("w", "y", "error", *names).unpivot(["w", "y", "error"], names, "feature", "value")
    sums = long.groupBy("feature").agg(
        F.sum(F.col("w") * F.col("value")).alias("weighted"), F.sum(F.col("w") * (0.5 - F.col("y")) * F.col("value")).alias("start"),
        F.sum(F.col("w") * F.col("error") * F.col("value")).alias("slope"),
    )
    whole = sums.join(learning.coefficients(model, [], names), "feature")
    slope = F.col("slope") + 0.5 * F.col("coefficient")
    zero = F.greatest(F.abs(slope) - 0.5, F.lit(0.0))
    off = F.when(F.col("coefficient") == 0, zero).otherwise(F.abs(slope + 0.5 * F.signum("coefficient")))
    return whole.select(
        "feature", F.round("weighted", 3).alias("weighted"), (F.round("start", 3) + 0.0).alias("start_slope"), F.round(off / (1 + F.col("weighted")), 6).alias("residual")
    )


def pooled_state(spark, sf):
    """Pooled neighbour means per region, wide."""
    cells = V.cells(spark, sf)
    logs = cells.select("region_id", "cell_id", *[C.log_marker(F.col(n)).alias(n) for n in STATE])
    state = graphs.neighbour_mean(N.knn(cells, 6), logs, STATE)
    pooled = composition.pool(state.unpivot(["region_id", "cell_id"], STATE, "name", "value"))
    stats = ["mean", "max", "variance"]
    wide = pooled.groupBy("region_id").pivot("name", STATE).agg(*[F.first(s).alias(s) for s in stats])
    return wide, [f"{n}_{s}" for n in STATE for s in stats]


def family_heads(spark, sf):
    """The feature table as heads: F0 alone, and F0 with F1 (loops included)."""
    table = P.feature_table(V.cells(spark, sf), V.regions(spark, sf))
    table = cut_lineage(table.select("region_id", "feature_family", "name", "value"))  # a thousand rows a region are written and read again
    names = P.names_by_family(table)
    base = P.feature_vectors(table.where("feature_family = 'F0'"), {"F0": names["F0"]})
    full = P.feature_vectors(table, names)
    return table, {"f0_logistic": Head(*base), "f0f1_logistic": Head(*full)}


@query("e23_cross_validated_study")
def cross_validated_study(spark, sf):
    """Full feature table as the main head, pooled neighbour means and F0 alone beside it."""
    _, families = family_heads(spark, sf)
    heads = {"main": families["f0f1_logistic"], "graph": Head(*pooled_state(spark, sf)), "engineered": families["f0_logistic"]}
    result = cross_validate(V.used_regions(spark, sf), heads, "features+graph+f0", StudySettings())
    return result.fold_metrics.unionByName(result.summary.select("run", F.lit(-1).cast("long").alias("fold"), "metric", F.col("mean").alias("value")))


@query("e22_report")
def report_query(spark, sf):
    """All report tables of F0 against F0 with F1: (section, run, name, value)."""
    table, families = family_heads(spark, sf)
    results = compare_families(V.used_regions(spark, sf), families, StudySettings())
    base, full = results["f0_logistic"], results["f0f1_logistic"]
    summary = cut_lineage(base.summary.unionByName(full.summary))
    models = base.models.unionByName(full.models)
    shown = report.report_tables(summary, table.select("region_id", "name", "value"), base.summary, models)
    metrics = [c for c in shown["runs"].columns if c != "run"]
    none = F.lit(None).cast("string")
    gain = report.added_value(base.fold_metrics, full.fold_metrics)
    parts = [
        shown["runs"].unpivot("run", metrics, "name", "value").select(F.lit("runs").alias("section"), "run", "name", "value"),
        shown["best_run"].select(F.lit("best run").alias("section"), "run", none.alias("name"), F.col("score").alias("value")),
        shown["auroc_delta"].select(F.lit("gain over f0_logistic").alias("section"), "run", F.col("metric").alias("name"), F.col("delta").alias("value")),
        gain.select(F.lit("gain by fold").alias("section"), F.lit("f0f1_logistic").alias("run"), F.col("metric").alias("name"), F.col("mean").alias("value")),
        shown["top_features"].select(F.lit("top features").alias("section"), "run", F.col("feature").alias("name"), F.col("score").alias("value")),
        shown["cases"].select(F.lit("cases").alias("section"), F.col("case").alias("run"), F.col("region_id").cast("string").alias("name"), "value"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("value", F.round("value", 6))


def scratch(spark) -> str:
    """A fresh folder in the cluster's shared scratch space."""
    return f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"


STUDY_SQL = """SELECT CAST(cell_id AS VARCHAR) AS cell_id, CAST(region_id AS VARCHAR) AS region_id, sample_id, patient_id, cell_type, compartment,
  label, round(x, 6) AS x, y FROM cells JOIN regions USING (region_id)"""
STUDY_COLUMNS = ["cell_id", "region_id", "sample_id", "patient_id", "cell_type", "compartment", "label"]


def labelled_cells(spark, sf):
    return V.cells(spark, sf).join(V.regions(spark, sf), "region_id")


@query("s1_cell_csv", with_views(V.CELLS_SQL, V.REGIONS_SQL, STUDY_SQL.replace(" AS x, y FROM", " AS x, y, round(marker_k, 6) AS marker_k, round(marker_v, 6) AS marker_v FROM")))
def cell_csv(spark, sf):
    folder = f"{scratch(spark)}/cells.csv"
    measures = ("x", "y", "marker_k", "marker_v")
    cells = labelled_cells(spark, sf).select(*STUDY_COLUMNS, *measures)
    cells.write.option("header", True).csv(folder)
    schema = ", ".join(f"{c} string" for c in STUDY_COLUMNS) + "".join(f", {c} double" for c in measures)
    study = tables.load_cell_study(spark, folder, schema=schema)
    return study.cells.select(*STUDY_COLUMNS, "y", *[F.round(c, 6).alias(c) for c in measures if c != "y"])


@query(
    "s2_region_label_csv",
    with_views(V.CELLS_SQL, V.REGIONS_SQL, "SELECT CAST(cell_id AS VARCHAR) AS cell_id, CAST(region_id AS VARCHAR) AS region_id, label FROM cells JOIN regions USING (region_id)"),
)
def region_label_csv(spark, sf):
    folder = scratch(spark)
    labelled_cells(spark, sf).drop("label").write.parquet(f"{folder}/cells.parquet")
    V.regions(spark, sf).select("region_id", "label").write.option("header", True).csv(f"{folder}/regions.csv")
    study = tables.load_cell_study(spark, f"{folder}/cells.parquet", f"{folder}/regions.csv")
    return study.cells.select("cell_id", "region_id", "label")


@query(
    "s3_annotation_tsv",
    """SELECT 'P' || CASE WHEN c_nationkey < 10 THEN '0' ELSE '' END || CAST(c_nationkey AS VARCHAR) AS patient_id, max(c_nationkey % 3)::VARCHAR AS label
       FROM customer GROUP BY c_nationkey""",
)
def annotation_tsv(spark, sf):
    folder = f"{scratch(spark)}/notes.tsv"
    notes = V.table(spark, sf, "customer").select(
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("patient_id"), (F.col("c_nationkey") % 3).alias("label")
    )
    notes.write.option("header", True).option("sep", "\t").csv(folder)
    return tables.read_annotations(spark, folder)


@query("s4_channel_names", "SELECT event_type AS channel, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS position FROM (SELECT DISTINCT event_type FROM events)")
def channel_names(spark, sf):
    folder = scratch(spark)
    kinds = V.table(spark, sf, "events").select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("k"))
    kinds.select(F.concat(F.lit(" "), F.array_join("k", " \n\n "))).coalesce(1).write.text(folder)
    names = tables.read_channel_names(spark, folder)
    return spark.createDataFrame(list(enumerate(names)), "position int, channel string")


@query("s5_type_dictionary", "SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS cell_type_id, event_type AS cell_type FROM (SELECT DISTINCT event_type FROM events)")
def type_dictionary(spark, sf):
    folder = scratch(spark)
    kinds = V.table(spark, sf, "events").select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("k"))
    entries = F.transform("k", lambda v, i: F.concat(i.cast("string"), F.lit(": '"), v, F.lit("'")))
    kinds.select(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))).coalesce(1).write.text(folder)
    return tables.read_type_dictionary(spark, folder)


@query(
    "w4_sorted_region_table",
    with_views(V.CELLS_SQL, V.REGIONS_SQL, "SELECT region_id, sample_id, patient_id, label, count(*) AS n_cells FROM cells JOIN regions USING (region_id) GROUP BY ALL ORDER BY region_id"),
)
def sorted_region_table(spark, sf):
    return tables.make_study(labelled_cells(spark, sf), "events", {"source": sf}).regions.orderBy("region_id")


@query(
    "s7_s8_study_round_trip",
    with_views(V.CELLS_SQL, V.REGIONS_SQL, "SELECT region_id, sample_id, patient_id, label, count(*) AS n_cells, round(sum(x), 8) AS total_x FROM cells JOIN regions USING (region_id) GROUP BY ALL"),
)
def study_round_trip(spark, sf):
    folder = scratch(spark)
    tables.save_study(tables.make_study(labelled_cells(spark, sf), "events", {"source": sf}), folder)
    study = tables.load_study(spark, folder)
    totals = study.cells.groupBy("region_id").agg(F.round(F.sum("x"), 8).alias("total_x"))
    return study.regions.join(totals, "region_id")


@query(
    "s9_feature_round_trip",
    with_views(V.CELLS_SQL, V.REGIONS_SQL, EXTENT_SQL, "SELECT region_id, label, name, round(value, 6) AS value FROM extent JOIN regions USING (region_id), LATERAL (VALUES ('cell_count', cell_count), ('bbox_area', bbox_area)) v(name, value)"),
)
def feature_round_trip(spark, sf):
    folder = scratch(spark)
    counts = composition.melt(composition.extent(V.cells(spark, sf)), ["cell_count", "bbox_area"])
    tables.save_features(attach_metadata(counts, V.regions(spark, sf), "F0"), folder)
    return tables.load_features(spark, folder).select("region_id", "label", "name", F.round("value", 6).alias("value"))


@query(
    "s10_s11_result_round_trip",
    with_views(V.SCORES_SQL, METRICS_SQL, MEANS_SQL, "SELECT m.run, round(m.mean - b.mean, 6) + 0.0::DOUBLE AS delta FROM means m JOIN means b ON m.metric = 'auroc' AND b.metric = 'auroc' AND b.run = 'en'"),
)
def result_round_trip(spark, sf):
    folder = scratch(spark)
    rows = cut_lineage(metric_rows(spark, sf))
    tables.save_results(rows, scoring.summarize_folds(rows, n_boot=50), folder)
    _, summary = tables.load_results(spark, folder)
    delta = scoring.delta_to_baseline(summary, summary.where(F.col("run") == "en"))
    return delta.select("run", r6(F.col("delta"), "delta"))
