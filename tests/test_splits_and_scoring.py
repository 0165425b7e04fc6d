import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators import balanced_folds, learning, quantiles, ranking, scoring, splits
from cytoplane.settings import SizeBounds, StudySettings

TINY = SizeBounds(percentile_rows=3)


def regions(spark, patients, per_patient=3):
    rows = [(f"{p}_{i}", p, label if isinstance(label, str) else label[i % 2]) for p, label in patients.items() for i in range(per_patient)]
    return spark.createDataFrame(rows, "region_id string, patient_id string, label string")


def test_leave_one_out_alternates(spark):
    frame = regions(spark, {"a": "CLR", "b": "DII", "c": "CLR", "d": "DII"})
    folds = {r.fold: r.patient_id for r in splits.leave_one_patient_out(frame).collect()}
    labels = [{"a": "CLR", "b": "DII", "c": "CLR", "d": "DII"}[folds[i]] for i in range(4)]
    assert labels == ["CLR", "DII", "CLR", "DII"]


@pytest.mark.parametrize("mixed", [False, True])
def test_no_patient_on_both_sides(spark, mixed):
    patients = {f"p{i}": (("A", "B") if mixed and i % 3 == 0 else "AB"[i % 2]) for i in range(12)}
    frame = regions(spark, patients)
    folds = splits.grouped_splits(frame, 4, 2)
    per_fold = folds.groupBy("repeat", "fold").agg(F.collect_list("patient_id").alias("p")).collect()
    assert len(per_fold) == 8
    tested = [p for r in per_fold if r.repeat == 0 for p in r.p]
    assert len(tested) == len(set(tested)) == (12 if mixed else 8)
    roles = splits.three_roles(frame, folds)
    clash = roles.groupBy("repeat", "fold", "patient_id").agg(F.count_distinct("role").alias("n")).where("n > 1")
    assert clash.isEmpty()


@pytest.mark.parametrize("splits_asked", [None, 4])
@pytest.mark.parametrize("mixed", [False, True])
def test_folds_of_split_groups_are_the_same(spark, mixed, splits_asked):
    frame = regions(spark, {f"p{i}": (("A", "B") if mixed and i % 5 == 0 else "AB"[i % 3 == 0]) for i in range(23)})
    whole, parted = (
        sorted(map(tuple, splits.grouped_splits(frame, splits_asked, 2, bounds=b).collect())) for b in (SizeBounds(), TINY)
    )
    assert whole == parted and whole
    if splits_asked is None:
        assert sorted(r[1] for r in whole) == list(range(23))


def one_by_one(counts, folds):
    """Fold of every patient, each given in turn to the best fold; counts are dicts of regions per label."""
    totals = {label: sum(c.get(label, 0) for c in counts) for label in sorted({x for c in counts for x in c})}
    weights = dict(zip(totals, balanced_folds.label_weights(list(totals.values())), strict=True))

    def unevenness(c):
        return len(totals) * sum(n * n for n in c.values()) - sum(c.values()) ** 2

    order = sorted(counts, key=lambda c: (-unevenness(c), sorted(c.items())))
    held = [dict.fromkeys(totals, 0) for _ in range(folds)]
    placed = []
    for c in order:
        costs = [(sum(weights[x] * n * held[f][x] for x, n in c.items()), sum(held[f].values()), f) for f in range(folds)]
        best = min(costs)[2]
        for x, n in c.items():
            held[best][x] += n
        placed.append((tuple(sorted(c.items())), best))
    return sorted(placed), held


def distance(held):
    totals = {x: sum(h[x] for h in held) for x in held[0]}
    return sum((h[x] / totals[x] - 1 / len(held)) ** 2 for h in held for x in totals)


MIXES = {
    "rare": [{"A": 5}] * 30 + [{"B": 1}] * 4 + [{"A": 1, "B": 2}] * 3,
    "giant": [{"A": 400, "B": 10}] + [{"A": 1}] * 60 + [{"B": 1}] * 9 + [{"A": 3, "B": 3}] * 5,
    "three": [{"A": i % 4 + 1, "B": i % 3, "C": i % 5} for i in range(40)],
}


@pytest.mark.parametrize("mix", MIXES)
def test_balanced_folds_are_those_of_one_patient_after_another(spark, mix):
    counts = [{x: n for x, n in c.items() if n} for c in MIXES[mix]]
    rows = [(f"{i}_{x}_{j}", f"p{i}", x) for i, c in enumerate(counts) for x, n in c.items() for j in range(n)]
    frame = spark.createDataFrame(rows, "region_id string, patient_id string, label string")
    wanted, held = one_by_one(counts, 4)
    folds = splits.grouped_splits(frame, 4, 2, balance=True).collect()
    for repeat in (0, 1):
        got = {r.patient_id: r.fold for r in folds if r.repeat == repeat}
        assert len(got) == len(counts)
        assert sorted((tuple(sorted(c.items())), got[f"p{i}"]) for i, c in enumerate(counts)) == wanted
    dominant = sorted(range(len(counts)), key=lambda i: (min(counts[i], key=lambda x: (-counts[i][x], x)), i))
    dealt = [[counts[i] for n, i in enumerate(dominant) if (n % 4 if n // 4 % 2 == 0 else 3 - n % 4) == f] for f in range(4)]
    other = [{x: sum(c.get(x, 0) for c in group) for x in held[0]} for group in dealt]
    assert distance(held) <= distance(other) + 1e-12


def test_balanced_folds_of_many_classes_missing_labels_and_scopes(spark):
    rows = [(s, f"{i}_{j}", f"p{i}", (None, "A", "B")[(i * j) % 3]) for s in ("u", "v") for i in range(40) for j in range(i % 11 + 1)]
    frame = spark.createDataFrame(rows, "study string, region_id string, patient_id string, label string")
    counts = [Counter(("", "A", "B")[(i * j) % 3] for j in range(i % 11 + 1)) for i in range(40)]  # "" sorts first, as null does
    wanted, held = one_by_one(counts, 4)
    for bounds in (SizeBounds(), TINY):
        folds = splits.grouped_splits(frame, 4, 1, scope=["study"], bounds=bounds, balance=True).collect()
        assert len(folds) == 80
        for study in ("u", "v"):
            got = {r.patient_id: r.fold for r in folds if r.study == study}
            assert len(got) == 40
            placed = sorted((tuple(sorted(c.items())), got[f"p{i}"]) for i, c in enumerate(counts))
            if bounds is not TINY:
                assert placed == wanted
            else:  # blocks of three classes
                parts = [{x: sum(c[x] for i, c in enumerate(counts) if got[f"p{i}"] == f) for x in held[0]} for f in range(4)]
                assert distance(parts) < 0.05


def test_fill_takes_any_number_at_once():
    rng = random.Random(5)
    for _ in range(300):
        k, step, size, many = rng.randint(2, 6), rng.randint(1, 5), rng.randint(1, 3), rng.randint(0, 40)
        scores, sizes = [rng.randint(0, 30) for _ in range(k)], [rng.randint(0, 4) for _ in range(k)]
        state, taken = [[s, z, f] for f, (s, z) in enumerate(zip(scores, sizes))], [0] * k
        for _ in range(many):
            best = min(state)
            taken[best[2]] += 1
            best[0] += step
            best[1] += size
        assert balanced_folds.fill(scores, sizes, step, size, many) == taken
    assert sum(balanced_folds.fill([0, 7, 3], [0, 0, 0], 2, 1, 10**15)) == 10**15


def test_nested_folds_stay_inside_training(spark):
    frame = regions(spark, {f"p{i}": "AB"[i % 2] for i in range(10)})
    outer, inner = splits.nested_splits(frame, 4, 3)
    leak = inner.join(
        outer.withColumnsRenamed({"repeat": "outer_repeat", "fold": "outer_fold"}), ["outer_repeat", "outer_fold", "patient_id"]
    )
    assert leak.isEmpty() and not inner.isEmpty()


def test_percentiles_and_positions_of_split_groups(spark):
    rng = random.Random(2)
    rows = [(g, i, float(rng.randint(0, 30)) if g == "a" else rng.random()) for g, n in (("a", 700), ("b", 5), ("c", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g string, i int, v double")
    wanted = {"q25": 0.25, "mid": 0.5, "q99": 0.99}
    for bounds in (SizeBounds(), TINY):
        got = {r.g: r for r in quantiles.exact_percentiles(frame, ["g"], "v", wanted, bounds).collect()}
        for g in "abc":
            values = np.array([v for k, _, v in rows if k == g])
            for name, p in wanted.items():
                assert got[g][name] == pytest.approx(np.quantile(values, p))
    placed = ranking.positions(frame, ["g"], "v", "i", bounds=TINY).collect()
    for g in "abc":
        order = sorted((r for r in placed if r.g == g), key=lambda r: (r.v, r.i))
        assert [r.position for r in order] == list(range(len(order)))


def test_equal_values_are_cut_by_their_ties(spark):
    ring = spark.range(10_000).select(F.lit("r").alias("g"), F.lit(1.5).alias("v"), F.col("id").alias("i"))
    other = spark.range(60).select(F.lit("s").alias("g"), (F.col("id") % 3).cast("double").alias("v"), F.col("id").alias("i"))
    frame, bounds = ring.unionByName(other), SizeBounds(percentile_rows=100)
    sizes = ranking._slices(frame, ["g"], "v", "i", 10_000, bounds).groupBy("g", "slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 200
    placed = ranking.positions(frame, ["g"], "v", "i", bounds=bounds)
    assert placed.where("g = 'r' AND position != i").isEmpty()
    assert [r.i for r in placed.where("g = 's'").orderBy("position").collect()] == sorted(range(60), key=lambda i: (i % 3, i))


def fixture_scores(seed, aux_sign, n=60):
    """Literal-like seeded scores: a good main head and a second one of given sign."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((f"f{i % 2 and 0}", i, y, rng.gauss(1 if y else -1, 0.8), rng.gauss(aux_sign * (1 if y else -1), 0.8)))
    return rows


def area(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_auroc_with_ties_and_single_class(spark):
    rows = [("a", i % 2, float((i * 7) % 5)) for i in range(40)] + [("b", 1, 0.3), ("b", 1, 0.4)]
    frame = spark.createDataFrame(rows, "run string, y int, p double")
    for bounds in (SizeBounds(), TINY):
        got = {r.run: r.auroc for r in scoring.auroc(frame, ["run"], "p", bounds).collect()}
        a = [r for r in rows if r[0] == "a"]
        assert got["a"] == pytest.approx(area([r[1] for r in a], [r[2] for r in a]))
        assert got["b"] == 0.5


def test_platt_matches_newton_and_keeps_order(spark):
    rows = fixture_scores(1, -1)
    frame = spark.createDataFrame(rows, "run string, i int, y int, main double, aux double")
    long = frame.select("run", "y", F.expr("stack(2, 'main', main, 'aux', aux) as (head, logit)"))
    fitted = {r["head"]: r for r in learning.fit_platt(long, ["run", "head"]).collect()}
    z, y = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    a = b = 0.0
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([a + (weight * (p - y) * z).sum(), (weight * (p - y)).sum()])
        h = weight * p * (1 - p)
        a, b = np.array([a, b]) - np.linalg.solve([[1 + (h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]], g)
    assert fitted["main"].slope == pytest.approx(a, abs=1e-6) and fitted["main"].intercept == pytest.approx(b, abs=1e-6)
    assert fitted["aux"].slope < 0
    keys, gaps = ["run", "head"], F.when(F.col("logit") < 2, F.col("logit")).alias("logit")  # some missing
    long = long.select("run", "head", "y", gaps)
    whole, parted = (
        {r["head"]: (r.coefficients[0], r.intercept, r.converged) for r in learning.fit_logistic_groups(long, keys, ["logit"], bounds=b).collect()}
        for b in (SizeBounds(), TINY)
    )
    assert set(whole) == set(parted) == {"main", "aux"}
    for head, (slope, intercept, converged) in whole.items():
        assert converged and parted[head] == (pytest.approx(slope), pytest.approx(intercept), True)
    calibrated, parameters = learning.calibrate(frame, ["run"], "main", fit=True)
    again, _ = learning.calibrate(frame, ["run"], "main", parameters=parameters)
    p1 = {r.i: r.p for r in calibrated.collect()}
    assert p1 == pytest.approx({r.i: r.p for r in again.collect()})
    assert area([r[2] for r in rows], [p1[r[1]] for r in rows]) == pytest.approx(area([r[2] for r in rows], [r[3] for r in rows]))


def test_inverted_head_is_gated_and_never_blended(spark):
    rows = fixture_scores(3, -1)
    frame = spark.createDataFrame(rows, "run string, i int, y int, main double, aux double").select(
        "run", "y", C.sigmoid(F.col("main")).alias("main"), C.sigmoid(F.col("aux")).alias("aux")
    )
    heads = frame.unpivot(["run", "y"], ["main", "aux"], "head", "p")
    gate = {r["head"]: r.eligible for r in scoring.gate_heads(heads, ["run"]).collect()}
    assert gate == {"main": True, "aux": False}
    chosen = scoring.best_safe_blend(frame, ["run"], "main", "aux").first()
    mixed = frame.withColumn("p", chosen.alpha * F.col("main") + (1 - chosen.alpha) * F.col("aux"))
    assert scoring.auroc(mixed, ["run"]).first().auroc >= scoring.auroc(frame, ["run"], "main").first().auroc - 0.005


def test_metrics_threshold_and_checkpoint(spark):
    frame = spark.createDataFrame([("r", 1, 0.9), ("r", 1, 0.4), ("r", 0, 0.3), ("r", 0, 0.6)], "run string, y int, p double")
    m = scoring.score_binary(frame, ["run"]).first()
    assert (m.auroc, m.balanced_accuracy, m.macro_f1) == (0.75, 0.5, 0.5)
    assert m.brier_score == pytest.approx((0.01 + 0.36 + 0.09 + 0.36) / 4)
    best = scoring.best_threshold(frame, ["run"]).first()
    assert best.balanced_accuracy == 0.75 and best.threshold == pytest.approx(0.305)
    score = spark.range(1).select(C.checkpoint_score(F.lit(0.87), F.lit(0.80), F.lit(0.78)).alias("s")).first().s
    assert score == pytest.approx(0.4 * 0.87 + 0.6 * 0.55 * 0.80 + 0.6 * 0.25 * 0.78)


def test_bootstrap_interval_holds_the_mean(spark):
    frame = spark.createDataFrame([("r", "auroc", i, v) for i, v in enumerate([0.7, 0.8, 0.9, 0.75])], "run string, metric string, fold int, value double")
    row = scoring.summarize_folds(frame, n_boot=300).first()
    assert row.ci_low <= row["mean"] <= row.ci_high and row["mean"] == pytest.approx(0.7875)
    assert row["std"] == pytest.approx(np.std([0.7, 0.8, 0.9, 0.75]))


def test_settings_mode_is_checked(spark):
    frame = spark.createDataFrame([("r", 1, 0.2)], "run string, y int, logit double")
    with pytest.raises(ValueError):
        learning.calibrate(frame, ["run"], settings=StudySettings(calibration="nothing"))
    out, parameters = learning.calibrate(frame, ["run"], settings=StudySettings(calibration="confidence_temperature"))
    assert parameters is None and 0.5 < out.first().p < 1 and math.isfinite(out.first().p)
