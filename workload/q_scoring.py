"""Folds, metrics, thresholds, gates, blends and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators import scoring as S
from cytoplane.operators import splits
from workload import views as V
from workload.q_ingest import r6
from workload.registry import query, with_views

PATIENTS_SQL = "pt AS (SELECT patient_id, min(label) AS label FROM used_regions GROUP BY 1)"
FOLDS = (V.USED_REGIONS_SQL, PATIENTS_SQL)
LOPO_SQL = """seats AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || patient_id), patient_id) - 1 AS seat FROM pt),
lopo AS (SELECT 0 AS repeat, CAST(row_number() OVER (ORDER BY seat, label) - 1 AS INTEGER) AS fold, patient_id FROM seats)"""
PAIRED_SQL = """seats AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || patient_id), patient_id) - 1 AS seat FROM pt),
paired AS (SELECT 0 AS repeat, CAST(seat AS INTEGER) AS fold, patient_id FROM seats WHERE seat < 4)"""


@query("a18_patients_per_label", with_views(V.USED_REGIONS_SQL, "SELECT label, count(DISTINCT patient_id) AS patients FROM used_regions GROUP BY 1"))
def patients_per_label(spark, sf):
    return splits.patients_per_label(V.used_regions(spark, sf))


def mixed_regions(spark, sf):
    """Scored rows as regions whose patients carry both labels."""
    return V.scores(spark, sf).select(
        F.col("row_id").alias("region_id"), "patient_id", F.col("y").cast("string").alias("label"), "y"
    )


@query("a19_pure_patients", "SELECT o_custkey AS patient_id, min(o_orderstatus) AS label FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def pure_patients(spark, sf):
    rows = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("label"))
    return splits.pure_patients(rows)


@query("v1_leave_one_patient_out", with_views(*FOLDS, LOPO_SQL, "SELECT CAST(repeat AS INTEGER) AS repeat, fold, patient_id FROM lopo"))
def leave_one_patient_out(spark, sf):
    return splits.leave_one_patient_out(V.used_regions(spark, sf))


@query("v2_grouped_as_many_as_patients", with_views(*FOLDS, LOPO_SQL, "SELECT CAST(repeat AS INTEGER) AS repeat, fold, patient_id FROM lopo"))
def grouped_as_many_as_patients(spark, sf):
    return splits.grouped_splits(V.used_regions(spark, sf), 100, 3, 42)


@query(
    "v3_paired_folds",
    with_views(
        *FOLDS,
        """seats AS (SELECT r AS repeat, patient_id, row_number() OVER (PARTITION BY r, label ORDER BY md5(CAST(42 + r AS VARCHAR) || ':' || patient_id), patient_id) - 1 AS seat
             FROM pt CROSS JOIN range(2) t(r))
           SELECT CAST(repeat AS INTEGER) AS repeat, CAST(seat AS INTEGER) AS fold, patient_id FROM seats WHERE seat < 4""",
    ),
)
def paired_folds(spark, sf):
    return splits.grouped_splits(V.used_regions(spark, sf), 4, 2, 42)


DEALT_SQL = """counted AS (SELECT patient_id, CAST(y AS VARCHAR) AS label, count(*) AS n FROM scores GROUP BY 1, 2),
dominant AS (SELECT patient_id, label FROM counted QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, label) = 1),
dealing AS (SELECT patient_id, row_number() OVER (ORDER BY label, md5('42:' || patient_id), patient_id) - 1 AS o FROM dominant),
dealt AS (SELECT 0 AS repeat, CAST(CASE WHEN (o // 4) % 2 = 0 THEN o % 4 ELSE 3 - o % 4 END AS INTEGER) AS fold, patient_id FROM dealing),
slots AS (SELECT DISTINCT repeat, fold FROM dealt),
assigned AS (SELECT s.repeat, s.fold, c.row_id AS region_id, c.y, CASE WHEN d.patient_id IS NULL THEN 'train' ELSE 'test' END AS role
  FROM scores c CROSS JOIN slots s LEFT JOIN dealt d ON d.patient_id = c.patient_id AND d.fold = s.fold)"""


@query("v4_dealt_folds", with_views(V.SCORES_SQL, DEALT_SQL, "SELECT CAST(repeat AS INTEGER) AS repeat, fold, patient_id FROM dealt"))
def dealt_folds(spark, sf):
    return splits.grouped_splits(mixed_regions(spark, sf), 4)


BALANCED_SQL = """counted AS (SELECT patient_id, count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b FROM scores GROUP BY 1),
totals AS (SELECT sum(a)::HUGEINT AS ta, sum(b)::HUGEINT AS tb, greatest(ta, tb) AS most FROM counted),
queue AS (SELECT *, (1024 * most * most) // (ta * ta) AS wa, (1024 * most * most) // (tb * tb) AS wb,
  row_number() OVER (ORDER BY -((a - b) * (a - b)), a = 0, CASE WHEN a > 0 THEN a ELSE b END, b) AS i FROM counted, totals),
greedy AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0]::HUGEINT[] AS ha, [0, 0, 0, 0]::HUGEINT[] AS hb, 0 AS fold
  UNION ALL
  SELECT i, [ha[f] + CASE WHEN f = best THEN a ELSE 0 END for f in [1, 2, 3, 4]]::HUGEINT[],
    [hb[f] + CASE WHEN f = best THEN b ELSE 0 END for f in [1, 2, 3, 4]]::HUGEINT[], best
  FROM (SELECT q.i, q.a, q.b, g.ha, g.hb, list_sort([struct_pack(
      score := g.ha[f] * q.a * q.wa + g.hb[f] * q.b * q.wb, size := g.ha[f] + g.hb[f], f := f) for f in [1, 2, 3, 4]])[1].f AS best
    FROM greedy g JOIN queue q ON q.i = g.i + 1)),
seats AS (SELECT a, b, fold - 1 AS fold, row_number() OVER (PARTITION BY a, b ORDER BY fold) AS place FROM greedy JOIN queue USING (i)),
takers AS (SELECT patient_id, a, b, row_number() OVER (PARTITION BY a, b ORDER BY md5('42:' || patient_id), patient_id) AS place FROM counted)"""


@query(
    "v4_balanced_folds",
    with_views(
        V.SCORES_SQL, BALANCED_SQL,
        "SELECT 0::INTEGER AS repeat, CAST(fold AS INTEGER) AS fold, patient_id FROM takers JOIN seats USING (a, b, place)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def balanced_folds(spark, sf):
    return splits.grouped_splits(mixed_regions(spark, sf), 4, balance=True)


@query("j11_fold_roles", with_views(V.SCORES_SQL, DEALT_SQL, "SELECT CAST(repeat AS INTEGER) AS repeat, fold, region_id, role FROM assigned"))
def fold_roles(spark, sf):
    regions = mixed_regions(spark, sf)
    return splits.assign_roles(regions, splits.grouped_splits(regions, 4)).select("repeat", "fold", "region_id", "role")


@query(
    "v7_usable_folds",
    with_views(
        V.SCORES_SQL, DEALT_SQL,
        """c AS (SELECT repeat, fold, role, count(DISTINCT y) AS n FROM assigned GROUP BY 1, 2, 3)
           SELECT CAST(repeat AS INTEGER) AS repeat, fold FROM c GROUP BY 1, 2 HAVING min(n) >= 2 AND count(*) = 2""",
    ),
)
def usable_folds(spark, sf):
    regions = mixed_regions(spark, sf)
    return splits.usable_from_counts(regions, splits.grouped_splits(regions, 4))


INNER_SQL = """slots AS (SELECT DISTINCT fold FROM paired),
training AS (SELECT s.fold AS outer_fold, p.patient_id, p.label FROM pt p CROSS JOIN slots s
  WHERE NOT EXISTS (SELECT 1 FROM paired t WHERE t.fold = s.fold AND t.patient_id = p.patient_id)),
inner_seats AS (SELECT outer_fold, patient_id, row_number() OVER (PARTITION BY outer_fold, label ORDER BY md5('42:' || patient_id), patient_id) - 1 AS seat FROM training)"""


@query(
    "v5_nested_folds",
    with_views(
        *FOLDS, PAIRED_SQL, INNER_SQL,
        """SELECT 0::INTEGER AS outer_repeat, outer_fold, 0::INTEGER AS repeat, CAST(seat AS INTEGER) AS fold, patient_id FROM inner_seats WHERE seat < 3""",
    ),
)
def nested_folds(spark, sf):
    return splits.nested_splits(V.used_regions(spark, sf), 4, 3)[1]


@query(
    "v6_validation_patients",
    with_views(*FOLDS, PAIRED_SQL, INNER_SQL, "SELECT 0::INTEGER AS repeat, outer_fold AS fold, patient_id FROM inner_seats WHERE seat = 0"),
)
def validation_patients(spark, sf):
    regions = V.used_regions(spark, sf)
    return splits.validation_patients(regions, splits.grouped_splits(regions, 4))


def area_sql(name: str, source: str, keys: str, p: str) -> str:
    pairs = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    listed = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    chosen = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (SELECT {listed}, coalesce(w.auroc, 0.5) AS auroc FROM (SELECT DISTINCT {keys} FROM {source}) g LEFT JOIN
  (SELECT {chosen}, sum(CASE WHEN a.{p} > b.{p} THEN 1.0::DOUBLE WHEN a.{p} = b.{p} THEN 0.5 ELSE 0 END) / count(*) AS auroc
   FROM {source} a JOIN {source} b ON {pairs} AND a.y = 1 AND b.y = 0 GROUP BY ALL) w USING ({keys}))"""


BALANCED_SQL = """CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn) ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END"""
MACRO_SQL = """CASE WHEN tp + fn + fp = 0 THEN 2 * tn / (2 * tn + fp + fn) WHEN tn + fn + fp = 0 THEN 2 * tp / (2 * tp + fp + fn)
  ELSE (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 END"""


def counts_sql(name: str, source: str, keys: str, p: str, threshold: str) -> str:
    return f"""{name} AS (SELECT {keys}, count(*) FILTER (y = 1 AND {p} >= {threshold}) AS tp, count(*) FILTER (y = 1 AND {p} < {threshold}) AS fn,
  count(*) FILTER (y = 0 AND {p} >= {threshold}) AS fp, count(*) FILTER (y = 0 AND {p} < {threshold}) AS tn,
  avg(({p} - y) * ({p} - y)) AS brier FROM {source} GROUP BY ALL)"""


METRICS_SQL = ",\n".join(
    (
        area_sql("area", "scores", "run, fold", "main_p"),
        counts_sql("counts", "scores", "run, fold", "main_p", "0.5"),
        f"""metric_wide AS (SELECT run, fold, auroc, {BALANCED_SQL} AS balanced_accuracy, {MACRO_SQL} AS macro_f1, brier AS brier_score
  FROM area JOIN counts USING (run, fold))""",
        "fold_metrics AS (" + " UNION ALL ".join(f"SELECT run, fold, '{m}' AS metric, {m} AS value FROM metric_wide" for m in ("auroc", "balanced_accuracy", "macro_f1", "brier_score")) + ")",
    )
)
METRICS = ["auroc", "balanced_accuracy", "macro_f1", "brier_score"]
KEYS = ["run", "fold"]


def metric_wide(spark, sf):
    return S.score_binary(V.scores(spark, sf), KEYS, "main_p")


def metric_rows(spark, sf):
    return S.melt_metrics(metric_wide(spark, sf), KEYS, METRICS)


@query("e1_auroc", with_views(V.SCORES_SQL, METRICS_SQL, "SELECT run, fold, round(auroc, 6) AS auroc FROM area"))
def auroc(spark, sf):
    return S.auroc(V.scores(spark, sf), KEYS, "main_p").select("run", "fold", F.round("auroc", 6).alias("auroc"))


@query("e2_balanced_accuracy", with_views(V.SCORES_SQL, METRICS_SQL, "SELECT run, fold, round(balanced_accuracy, 6) AS balanced_accuracy FROM metric_wide"))
def balanced_accuracy(spark, sf):
    counts = S.confusion(V.scores(spark, sf), KEYS, "main_p")
    return counts.select("run", "fold", F.round(S.balanced_accuracy(*S._counts()), 6).alias("balanced_accuracy"))


@query("e3_macro_f1", with_views(V.SCORES_SQL, METRICS_SQL, "SELECT run, fold, round(macro_f1, 6) AS macro_f1 FROM metric_wide"))
def macro_f1(spark, sf):
    counts = S.confusion(V.scores(spark, sf), KEYS, "main_p")
    return counts.select("run", "fold", F.round(S.macro_f1(*S._counts()), 6).alias("macro_f1"))


@query("e4_brier_score", with_views(V.SCORES_SQL, METRICS_SQL, "SELECT run, fold, round(brier_score, 6) AS brier_score FROM metric_wide"))
def brier_score(spark, sf):
    return metric_wide(spark, sf).select("run", "fold", F.round("brier_score", 6).alias("brier_score"))


def grid_sql(values) -> str:
    return "[" + ", ".join(f"'{v!r}'::DOUBLE" for v in values) + "]"


def best_threshold_sql(name: str, source: str, keys: str, p: str, score: str = BALANCED_SQL) -> str:
    return f"""{name}_grid AS (SELECT s.*, unnest({grid_sql(S.THRESHOLDS)}) AS threshold FROM {source} s),
{counts_sql(name + '_counts', name + '_grid', keys + ', threshold', p, 'threshold')},
{name} AS (SELECT {keys}, threshold, {score} AS balanced_accuracy FROM {name}_counts
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, threshold) = 1)"""


@query(
    "e5_best_threshold",
    with_views(V.SCORES_SQL, best_threshold_sql("best", "scores", "run, fold", "main_p"), "SELECT run, fold, round(threshold, 6) AS threshold, round(balanced_accuracy, 6) AS balanced_accuracy FROM best"),
)
def best_threshold(spark, sf):
    rows = S.best_threshold(V.scores(spark, sf), KEYS, "main_p")
    return rows.select("run", "fold", F.round("threshold", 6).alias("threshold"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query("w7_first_best_threshold", with_views(V.SCORES_SQL, best_threshold_sql("best", "scores", "run", "aux_p"), "SELECT run, round(threshold, 6) AS threshold FROM best"))
def first_best_threshold(spark, sf):
    return S.best_threshold(V.scores(spark, sf), ["run"], "aux_p").select("run", F.round("threshold", 6).alias("threshold"))


@query("e7_platt_apply", with_views(V.SCORES_SQL, "SELECT row_id, round(1 / (1 + exp(-(1.7 * main_logit - 0.4))), 9) AS p FROM scores"))
def platt_apply(spark, sf):
    return V.scores(spark, sf).select("row_id", F.round(C.platt(F.col("main_logit"), F.lit(1.7), F.lit(-0.4)), 9).alias("p"))


@query(
    "e8_confidence_temperature",
    with_views(
        V.SCORES_SQL,
        """SELECT row_id, round(1 / (1 + exp(-main_logit / 0.5)), 9) AS plain,
           round(1 / (1 + exp(-main_logit / (0.5 * (1 + 0.75 * power(abs(1 / (1 + exp(-main_logit / 0.5)) - 0.5) * 2, 2))))), 9) AS confident FROM scores""",
    ),
)
def confidence_temperature(spark, sf):
    z = F.col("main_logit")
    return V.scores(spark, sf).select(
        "row_id", F.round(C.temperature_probability(z, mode="temperature"), 9).alias("plain"),
        F.round(C.temperature_probability(z), 9).alias("confident"),
    )


@query(
    "e10_head_gate",
    with_views(
        V.SCORES_SQL, "heads AS (SELECT run, 'main' AS head, y, main_p AS p FROM scores UNION ALL SELECT run, 'aux', y, aux_p FROM scores)",
        area_sql("area", "heads", "run, head", "p"),
        """best AS (SELECT *, max(auroc) OVER (PARTITION BY run) AS best FROM area)
           SELECT run, head, round(auroc, 6) AS auroc, auroc >= 0.55 AND best - auroc <= 0.2 AS eligible FROM best""",
    ),
)
def head_gate(spark, sf):
    heads = V.scores(spark, sf).select("run", "y", F.col("main_p").alias("main"), F.col("aux_p").alias("aux")).unpivot(
        ["run", "y"], ["main", "aux"], "head", "p"
    )
    return S.gate_heads(heads, ["run"]).select("run", "head", F.round("auroc", 6).alias("auroc"), "eligible")


BLEND_SQL = f"""mixing AS (SELECT run, y, main_p, aux_p, unnest({grid_sql(S.ALPHAS)}) AS alpha FROM scores),
blended AS (SELECT run, alpha, y, alpha * main_p + (1.0::DOUBLE - alpha) * aux_p AS p FROM mixing),
{area_sql('blend_area', 'blended', 'run, alpha', 'p')},
{best_threshold_sql('blend_best', 'blended', 'run, alpha', 'p')},
blends AS (SELECT run, alpha, auroc, threshold, 0.65 * balanced_accuracy + 0.35 * auroc AS score FROM blend_area JOIN blend_best USING (run, alpha))"""


@query(
    "e11_best_blend",
    with_views(
        V.SCORES_SQL, BLEND_SQL,
        """SELECT run, round(alpha, 6) AS alpha, round(threshold, 6) AS threshold, round(score, 6) AS score FROM blends
           QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, alpha) = 1""",
    ),
)
def best_blend(spark, sf):
    rows = S.best_blend(V.scores(spark, sf), ["run"], "main_p", "aux_p")
    return rows.select("run", *[F.round(c, 6).alias(c) for c in ("alpha", "threshold", "score")])


@query(
    "e12_safe_blend",
    with_views(
        V.SCORES_SQL, BLEND_SQL, area_sql("main_area", "scores", "run", "main_p"), best_threshold_sql("alone", "scores", "run", "main_p"),
        """chosen AS (SELECT b.run, alpha, threshold FROM blends b JOIN main_area m ON b.run = m.run WHERE b.auroc >= m.auroc - 0.005
             QUALIFY row_number() OVER (PARTITION BY b.run ORDER BY score DESC, alpha) = 1)
           SELECT run, round(coalesce(c.alpha, 1.0), 6) AS alpha, round(coalesce(c.threshold, a.threshold), 6) AS threshold FROM alone a LEFT JOIN chosen c USING (run)""",
    ),
)
def safe_blend(spark, sf):
    rows = S.best_safe_blend(V.scores(spark, sf), ["run"], "main_p", "aux_p")
    return rows.select("run", F.round("alpha", 6).alias("alpha"), F.round("threshold", 6).alias("threshold"))


@query(
    "e15_checkpoint_score",
    with_views(V.SCORES_SQL, METRICS_SQL, "SELECT run, fold, round(0.4 * auroc + 0.6 * 0.55 * balanced_accuracy + 0.6 * 0.25 * macro_f1, 6) AS score FROM metric_wide"),
)
def checkpoint_score(spark, sf):
    score = C.checkpoint_score(F.col("auroc"), F.col("balanced_accuracy"), F.col("macro_f1"))
    return metric_wide(spark, sf).select("run", "fold", F.round(score, 6).alias("score"))


def guard_sql(safe: str, other: str, tolerance: float, prepared: str = "scores") -> tuple[str, ...]:
    return (
        area_sql("safe_area", prepared, "run, fold", safe), area_sql("other_area", prepared, "run, fold", other),
        f"""verdict AS (SELECT s.run, s.fold, o.auroc >= s.auroc - {tolerance} AND c.two AS keep FROM safe_area s JOIN other_area o USING (run, fold)
  JOIN (SELECT run, fold, min(y) < max(y) AS two FROM scores GROUP BY 1, 2) c USING (run, fold))""",
        f"SELECT row_id, round(CASE WHEN keep THEN {other} ELSE {safe} END, 6) AS p FROM {prepared} JOIN verdict USING (run, fold)",
    )


@query("e16_safe_calibration", with_views(V.SCORES_SQL, *guard_sql("main_p", "aux_p", 0.01)))
def safe_calibration(spark, sf):
    rows = S.keep_if_no_loss(V.scores(spark, sf), KEYS, "main_p", "aux_p", 0.01)
    return rows.select("row_id", F.round("p", 6).alias("p"))


@query(
    "e17_blend_guard",
    with_views(V.SCORES_SQL, "blended AS (SELECT *, 0.7::DOUBLE * main_p + 0.3::DOUBLE * aux_p AS mix FROM scores)", *guard_sql("main_p", "mix", 0.005, "blended")),
)
def blend_guard(spark, sf):
    blended = V.scores(spark, sf).withColumn("mix", 0.7 * F.col("main_p") + 0.3 * F.col("aux_p"))
    return S.keep_if_no_loss(blended, KEYS, "main_p", "mix", 0.005).select("row_id", F.round("p", 6).alias("p"))


BOOT_SQL = """seated AS (SELECT run, metric, value, row_number() OVER (PARTITION BY run, metric ORDER BY fold) - 1 AS seat,
  count(*) OVER (PARTITION BY run, metric) AS size FROM fold_metrics),
drawn AS (SELECT run, metric, boot, ('0x' || substr(md5('42:' || boot || ':' || seat), 1, 8))::BIGINT % size AS pick FROM seated CROSS JOIN range(2000) t(boot)),
boots AS (SELECT d.run, d.metric, boot, avg(s.value) AS mean FROM drawn d JOIN seated s ON d.run = s.run AND d.metric = s.metric AND d.pick = s.seat GROUP BY 1, 2, 3),
ends AS (SELECT run, metric, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM boots GROUP BY 1, 2),
summary AS (SELECT run, metric, avg(value) AS mean, stddev_pop(value) AS std FROM fold_metrics GROUP BY 1, 2)"""


@query("v8_bootstrap_interval", with_views(V.SCORES_SQL, METRICS_SQL, BOOT_SQL, "SELECT run, metric, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM summary JOIN ends USING (run, metric)"))
def bootstrap_interval(spark, sf):
    rows = splits.bootstrap_interval(metric_rows(spark, sf), ["run", "metric"])
    return rows.select("run", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("e18_fold_summary", with_views(V.SCORES_SQL, METRICS_SQL, BOOT_SQL, "SELECT run, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM summary JOIN ends USING (run, metric)"))
def fold_summary(spark, sf):
    rows = S.summarize_folds(metric_rows(spark, sf))
    return rows.select("run", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])


MEANS_SQL = "means AS (SELECT run, metric, avg(value) AS mean FROM fold_metrics GROUP BY 1, 2)"


def metric_means(spark, sf):
    return metric_rows(spark, sf).groupBy("run", "metric").agg(F.avg("value").alias("mean"))


@query(
    "e19_delta_to_baseline",
    with_views(V.SCORES_SQL, METRICS_SQL, MEANS_SQL, "SELECT m.run, m.metric, round(m.mean - b.mean, 6) + 0.0::DOUBLE AS delta FROM means m JOIN means b ON m.metric = 'auroc' AND b.metric = 'auroc' AND b.run = 'en'"),
)
def delta_to_baseline(spark, sf):
    means = metric_means(spark, sf)
    rows = S.delta_to_baseline(means, means.where(F.col("run") == "en"))
    return rows.select("run", "metric", r6(F.col("delta"), "delta"))


@query(
    "w6_best_run",
    with_views(
        V.SCORES_SQL, METRICS_SQL, MEANS_SQL,
        """weighed AS (SELECT run, sum(mean * CASE metric WHEN 'balanced_accuracy' THEN 0.45 WHEN 'macro_f1' THEN 0.35 WHEN 'auroc' THEN 0.2 END) AS score FROM means GROUP BY 1)
           SELECT run, round(score, 6) AS score FROM weighed ORDER BY score DESC, run DESC LIMIT 1""",
    ),
)
def best_run(spark, sf):
    return S.best_run(metric_means(spark, sf)).select("run", F.round("score", 6).alias("score"))


def _variant(name: str, p: str, threshold: str, alpha: str = "NULL::DOUBLE") -> str:
    return f"SELECT run, y, '{name}' AS variant, {p} AS p, {threshold} AS decision_threshold, {alpha} AS blend_alpha FROM tuned"


_MIX = "blend_alpha * main + (1.0::DOUBLE - blend_alpha) * graph"
_VARIANTS = " UNION ALL ".join(
    (
        *[_variant(f"{n}_{h}", h, "0.5::DOUBLE") for n in ("1_raw", "2_cal") for h in ("main", "graph", "topo")],
        _variant("3_main_raw_opt_thresh", "main", "t_main"), _variant("3_main_cal_opt_thresh", "main", "t_main"),
        _variant("4_blended_cal_t05", _MIX, "0.5::DOUBLE", "blend_alpha"), _variant("5_blended_raw_t05", _MIX, "0.5::DOUBLE", "blend_alpha"),
        _variant("6_full_pipeline", _MIX, "t_blend", "blend_alpha"), _variant("7_main_only_opt_thresh", "main", "t_main"),
        _variant("8_auroc_weighted_selection", "main", "t_weighted"),
    )
)


@query(
    "e20_diagnostic_ablation",
    with_views(
        V.SCORES_SQL,
        "probs AS (SELECT run, y, 1 / (1 + exp(-main_logit)) AS main, 1 / (1 + exp(-aux_logit)) AS graph, 1 / (1 + exp(-topo_logit)) AS topo FROM scores)",
        best_threshold_sql("plain_best", "probs", "run", "main"),
        area_sql("plain_area", "probs", "run", "main"),
        f"""mixing AS (SELECT run, y, main, graph, unnest({grid_sql(S.ALPHAS)}) AS alpha FROM probs),
blended AS (SELECT run, alpha, y, alpha * main + (1.0::DOUBLE - alpha) * graph AS p FROM mixing)""",
        area_sql("blend_area", "blended", "run, alpha", "p"),
        best_threshold_sql("blend_best", "blended", "run, alpha", "p"),
        f"""chosen AS (SELECT run, alpha, threshold FROM blend_area JOIN blend_best USING (run, alpha)
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY 0.65 * balanced_accuracy + 0.35 * auroc DESC, alpha) = 1),
weighted AS (SELECT run, threshold FROM plain_best_counts JOIN plain_area USING (run)
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY 0.55 * auroc + 0.25 * ({MACRO_SQL}) + 0.2 * ({BALANCED_SQL}) DESC, threshold) = 1),
tuned AS (SELECT p.*, b.threshold AS t_main, c.alpha AS blend_alpha, c.threshold AS t_blend, w.threshold AS t_weighted FROM probs p
  JOIN plain_best b USING (run) JOIN chosen c USING (run) JOIN weighted w USING (run)),
long_rows AS ({_VARIANTS})""",
        area_sql("long_area", "long_rows", "run, variant", "p"),
        counts_sql("long_counts", "long_rows", "run, variant, decision_threshold, blend_alpha", "p", "decision_threshold"),
        f"""SELECT run, variant, round(auroc, 6) AS auroc, round({BALANCED_SQL}, 6) AS balanced_accuracy, round({MACRO_SQL}, 6) AS macro_f1,
            round(brier, 6) AS brier_score, round(decision_threshold, 6) AS decision_threshold, round(blend_alpha, 6) AS blend_alpha
            FROM long_area JOIN long_counts USING (run, variant)""",
    ),
)
def diagnostic_ablation(spark, sf):
    rows = S.diagnose(V.scores(spark, sf), ["run"], ("main_logit", "aux_logit", "topo_logit"))
    return rows.select("run", "variant", *[F.round(c, 6).alias(c) for c in (*METRICS, "decision_threshold", "blend_alpha")])


@query(
    "e21_logit_margins",
    with_views(V.SCORES_SQL, "SELECT row_id, round(main_logit - aux_logit, 9) + 0.0::DOUBLE AS logit, CAST(main_logit - aux_logit >= 0 AS INTEGER) AS predicted FROM scores"),
)
def logit_margins(spark, sf):
    margin = C.logit_margin(F.array("aux_logit", "main_logit"))
    return V.scores(spark, sf).select(
        "row_id", (F.round(margin, 9) + 0.0).alias("logit"), (C.sigmoid(margin) >= 0.5).cast("int").alias("predicted")
    )
