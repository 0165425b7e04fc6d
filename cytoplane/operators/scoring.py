"""Binary metrics, thresholds, gates and blends over score tables, for all groups at once.

A score table has group keys (such as run, fold), the truth ``y`` (0/1) and a probability column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators.ranking import running_sums
from cytoplane.operators.splits import bootstrap_interval
from cytoplane.session import measured_scores
from cytoplane.settings import BOUNDS, SizeBounds


def even_grid(low: float, high: float, points: int) -> list[float]:
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points - 1)] + [high]


THRESHOLDS = even_grid(0.05, 0.95, 61)
ALPHAS = even_grid(0.0, 1.0, 21)


def auroc(scores: DataFrame, keys: list[str], p: str = "p", bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Exact area under the ROC curve by rank sums over distinct scores; 0.5 where a class is missing."""
    bounds = measured_scores(scores, keys, bounds)
    distinct = scores.groupBy(*keys, F.col(p).alias("s")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    ranked = running_sums(distinct, keys, "s", {"neg_below": "neg"}, bounds=bounds)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).otherwise(0.5).alias("auroc"))


def confusion(scores: DataFrame, keys: list[str], p: str = "p", threshold: Column | float = 0.5) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, positive = F.col(p) >= limit, F.col("y") == 1
    return scores.groupBy(*keys).agg(
        F.count_if(positive & hit).alias("tp"), F.count_if(positive & ~hit).alias("fn"),
        F.count_if(~positive & hit).alias("fp"), F.count_if(~positive & ~hit).alias("tn"),
    )


def balanced_accuracy(tp: Column, fn: Column, fp: Column, tn: Column) -> Column:
    """Mean recall over the classes present."""
    recall = F.when(tp + fn > 0, tp / (tp + fn))
    rejection = F.when(tn + fp > 0, tn / (tn + fp))
    return F.when(recall.isNull(), rejection).when(rejection.isNull(), recall).otherwise((recall + rejection) / 2)


def macro_f1(tp: Column, fn: Column, fp: Column, tn: Column) -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    one = F.when(tp + fn + fp > 0, 2 * tp / (2 * tp + fp + fn))
    zero = F.when(tn + fn + fp > 0, 2 * tn / (2 * tn + fp + fn))
    return F.when(one.isNull(), zero).when(zero.isNull(), one).otherwise((one + zero) / 2)


def _counts() -> list[Column]:
    return [F.col(c) for c in ("tp", "fn", "fp", "tn")]


def score_binary(
    scores: DataFrame, keys: list[str], p: str = "p", threshold: Column | float = 0.5, bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """AUROC, balanced accuracy, macro F1 and Brier score of every group."""
    counts = confusion(scores, keys, p, threshold)
    brier = scores.groupBy(*keys).agg(F.avg((F.col(p) - F.col("y")) * (F.col(p) - F.col("y"))).alias("brier_score"))
    return (
        auroc(scores, keys, p, bounds).join(counts, keys).join(brier, keys)
        .select(
            *keys, "auroc", balanced_accuracy(*_counts()).alias("balanced_accuracy"),
            macro_f1(*_counts()).alias("macro_f1"), "brier_score",
        )
    )


def threshold_table(scores: DataFrame, keys: list[str], p: str = "p", grid: list[float] | None = None) -> DataFrame:
    """Confusion counts of every group at every threshold.

    Rows are reduced to counts per number of thresholds they pass (at most one more than the grid has), so the
    scores themselves are never multiplied by the grid.
    """
    grid = THRESHOLDS if grid is None else grid
    limits = F.lit(grid)
    passed = F.size(F.filter(limits, lambda t: t <= F.col(p)))
    counts = scores.groupBy(*keys, passed.alias("passed")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    packed = counts.groupBy(*keys).agg(
        F.collect_list(F.struct("passed", "pos", "neg")).alias("steps"),
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"),
    )
    zero = F.lit(0).cast("long")

    def at_or_above(field: str) -> Column:
        return F.aggregate("steps", zero, lambda a, s: a + F.when(s["passed"] > F.col("i"), s[field]).otherwise(zero))

    return (
        packed.select(*keys, "steps", "all_pos", "all_neg", F.posexplode(limits).alias("i", "threshold"))
        .withColumn("tp", at_or_above("pos")).withColumn("fp", at_or_above("neg"))
        .select(
            *keys, "threshold", "tp", (F.col("all_pos") - F.col("tp")).alias("fn"), "fp",
            (F.col("all_neg") - F.col("fp")).alias("tn"),
        )
    )


def best_threshold(scores: DataFrame, keys: list[str], p: str = "p", grid: list[float] | None = None) -> DataFrame:
    """First threshold of the grid with the highest balanced accuracy."""
    scored = threshold_table(scores, keys, p, grid).withColumn("score", balanced_accuracy(*_counts()))
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("threshold")).alias("early"), "threshold")).alias("b"))
    return best.select(*keys, "b.threshold", F.col("b.score").alias("balanced_accuracy"))


def blend_table(
    scores: DataFrame, keys: list[str], main: str, aux: str, alphas: list[float] | None = None, bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """AUROC, best threshold and combined score of alpha * main + (1 - alpha) * aux for every alpha."""
    bounds = measured_scores(scores, keys, bounds)
    alphas = ALPHAS if alphas is None else alphas
    mixed = scores.select(*keys, "y", main, aux, F.explode(F.lit(alphas)).alias("alpha")).withColumn(
        "p", F.col("alpha") * F.col(main) + (1.0 - F.col("alpha")) * F.col(aux)
    )
    per_alpha = [*keys, "alpha"]
    joined = auroc(mixed, per_alpha, "p", bounds).join(best_threshold(mixed, per_alpha), per_alpha)
    return joined.withColumn("score", 0.65 * F.col("balanced_accuracy") + 0.35 * F.col("auroc"))


def _first_best(rows: DataFrame, keys: list[str]) -> DataFrame:
    best = rows.groupBy(*keys).agg(
        F.max(F.struct("score", (-F.col("alpha")).alias("early"), "alpha", "threshold", "auroc")).alias("b")
    )
    return best.select(*keys, "b.alpha", "b.threshold", "b.score", "b.auroc")


def best_blend(scores: DataFrame, keys: list[str], main: str, aux: str, bounds: SizeBounds = BOUNDS) -> DataFrame:
    return _first_best(blend_table(scores, keys, main, aux, bounds=bounds), keys)


def best_safe_blend(
    scores: DataFrame, keys: list[str], main: str, aux: str, tolerance: float = 0.005, bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """Best blend among those whose AUROC stays within ``tolerance`` of the main head's; else main alone."""
    bounds = measured_scores(scores, keys, bounds)
    floor = auroc(scores, keys, main, bounds).select(*keys, (F.col("auroc") - tolerance).alias("floor"))
    allowed = blend_table(scores, keys, main, aux, bounds=bounds).join(floor, keys).where(F.col("auroc") >= F.col("floor"))
    chosen = _first_best(allowed, keys).select(*keys, "alpha", F.col("threshold").alias("blend_threshold"))
    alone = best_threshold(scores, keys, main).select(*keys, F.col("threshold").alias("main_threshold"))
    return alone.join(chosen, keys, "left").select(
        *keys, F.coalesce("alpha", F.lit(1.0)).alias("alpha"), F.coalesce("blend_threshold", "main_threshold").alias("threshold")
    )


def gate_heads(
    heads: DataFrame, keys: list[str], min_auroc: float = 0.55, max_gap: float = 0.20, bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """Per head (keys, head): its AUROC and whether it is good enough on its own and beside the best."""
    scored = auroc(heads, [*keys, "head"], "p", bounds)
    best = scored.groupBy(*keys).agg(F.max("auroc").alias("best"))
    eligible = (F.col("auroc") >= min_auroc) & (F.col("best") - F.col("auroc") <= max_gap)
    return scored.join(best, keys).select(*keys, "head", "auroc", eligible.alias("eligible"))


def no_loss(
    scores: DataFrame, keys: list[str], safe: str, other: str, tolerance: float, bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """(keys, keep): whether the AUROC of ``other`` is at least that of ``safe`` minus ``tolerance``; one class: not."""
    bounds = measured_scores(scores, keys, bounds)
    a = auroc(scores, keys, safe, bounds).withColumnRenamed("auroc", "safe_auroc")
    b = auroc(scores, keys, other, bounds).withColumnRenamed("auroc", "other_auroc")
    classes = scores.groupBy(*keys).agg((F.min("y") < F.max("y")).alias("two"))
    keep = F.col("two") & (F.col("other_auroc") >= F.col("safe_auroc") - tolerance)
    return a.join(b, keys).join(classes, keys).select(*keys, keep.alias("keep"))


def keep_if_no_loss(
    scores: DataFrame, keys: list[str], safe: str, other: str, tolerance: float, out: str = "p", bounds: SizeBounds = BOUNDS
) -> DataFrame:
    """``other`` where its AUROC is at least that of ``safe`` minus ``tolerance``, else ``safe``.

    With 0.01 this keeps a calibration, with 0.005 a blend. Groups of one class stay on ``safe``.
    """
    verdict = no_loss(scores, keys, safe, other, tolerance, bounds)
    return scores.join(verdict, keys).withColumn(out, F.when(F.col("keep"), F.col(other)).otherwise(F.col(safe))).drop("keep")


def summarize_folds(fold_metrics: DataFrame, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Mean, population deviation and bootstrap interval of each metric over the folds of a run."""
    keys = ["run", "metric"]
    spread = fold_metrics.groupBy(*keys).agg(F.stddev_pop("value").alias("std"))
    return bootstrap_interval(fold_metrics, keys, n_boot=n_boot, seed=seed).join(spread, keys).select(
        *keys, "mean", "std", "ci_low", "ci_high"
    )


def delta_to_baseline(summary: DataFrame, baseline: DataFrame, metric: str = "auroc") -> DataFrame:
    """Difference of each run's mean metric to the baseline's."""
    base = baseline.where(F.col("metric") == metric).select(F.col("metric"), F.col("mean").alias("baseline"))
    mine = summary.where(F.col("metric") == metric).select("run", "metric", "mean")
    return mine.join(base, "metric").select("run", "metric", (F.col("mean") - F.col("baseline")).alias("delta"))


def best_run(summary: DataFrame) -> DataFrame:
    """Run with the highest 0.45 balanced accuracy + 0.35 macro F1 + 0.20 AUROC."""
    weights = F.create_map(
        F.lit("balanced_accuracy"), F.lit(0.45), F.lit("macro_f1"), F.lit(0.35), F.lit("auroc"), F.lit(0.20)
    )
    total = summary.groupBy("run").agg(F.sum(F.col("mean") * F.try_element_at(weights, F.col("metric"))).alias("score"))
    top = total.agg(F.max(F.struct("score", "run")).alias("t"))
    return top.select("t.run", "t.score")


def melt_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    doubles = wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(keys, metrics, "metric", "value")


def diagnose(scores: DataFrame, keys: list[str], heads: tuple[str, str, str], bounds: SizeBounds = BOUNDS) -> DataFrame:
    """Ablation of heads, thresholds and blending on held-out scores, one row per variant.

    ``heads`` are the logit columns of the main, graph and topology heads. Calibrated variants use the plain
    sigmoid, as fitting on the scored rows would leak.
    """
    bounds = measured_scores(scores, keys, bounds)
    main, graph, topo = heads
    names = {"main": main, "graph": graph, "topo": topo}
    probs = scores.select(*keys, "y", *[C.sigmoid(F.col(logit)).alias(name) for name, logit in names.items()])
    tuned = best_threshold(probs, keys, "main").select(*keys, F.col("threshold").alias("t_main"))
    blend = best_blend(probs, keys, "main", "graph", bounds).select(
        *keys, F.col("alpha").alias("blend_alpha"), F.col("threshold").alias("t_blend")
    )
    weighted = _weighted_threshold(probs, keys, bounds).select(*keys, F.col("threshold").alias("t_weighted"))
    wide = probs.join(tuned, keys).join(blend, keys).join(weighted, keys)
    mixed = F.col("blend_alpha") * F.col("main") + (1.0 - F.col("blend_alpha")) * F.col("graph")
    half, none = F.lit(0.5), F.lit(None).cast("double")
    variants = {
        "1_raw_main": (F.col("main"), half, none),
        "1_raw_graph": (F.col("graph"), half, none),
        "1_raw_topo": (F.col("topo"), half, none),
        "2_cal_main": (F.col("main"), half, none),
        "2_cal_graph": (F.col("graph"), half, none),
        "2_cal_topo": (F.col("topo"), half, none),
        "3_main_raw_opt_thresh": (F.col("main"), F.col("t_main"), none),
        "3_main_cal_opt_thresh": (F.col("main"), F.col("t_main"), none),
        "4_blended_cal_t05": (mixed, half, F.col("blend_alpha")),
        "5_blended_raw_t05": (mixed, half, F.col("blend_alpha")),
        "6_full_pipeline": (mixed, F.col("t_blend"), F.col("blend_alpha")),
        "7_main_only_opt_thresh": (F.col("main"), F.col("t_main"), none),
        "8_auroc_weighted_selection": (F.col("main"), F.col("t_weighted"), none),
    }
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("variant"), p.alias("p"), t.alias("decision_threshold"), a.alias("blend_alpha"))
            for n, (p, t, a) in variants.items()
        ]
    )
    long = wide.select(*keys, "y", F.explode(rows).alias("v")).select(*keys, "y", "v.*")
    group = [*keys, "variant"]
    fixed = long.groupBy(*group).agg(
        F.min("decision_threshold").alias("decision_threshold"), F.min("blend_alpha").alias("blend_alpha")
    )
    return score_binary(long, group, "p", F.col("decision_threshold"), bounds).join(fixed, group)


def _weighted_threshold(probs: DataFrame, keys: list[str], bounds: SizeBounds) -> DataFrame:
    """First threshold with the highest 0.55 AUROC + 0.25 macro F1 + 0.2 balanced accuracy."""
    area = auroc(probs, keys, "main", bounds)
    scored = threshold_table(probs, keys, "main").join(area, keys).withColumn(
        "score", 0.55 * F.col("auroc") + 0.25 * macro_f1(*_counts()) + 0.2 * balanced_accuracy(*_counts())
    )
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("threshold")).alias("early"), "threshold")).alias("b"))
    return best.select(*keys, "b.threshold")
