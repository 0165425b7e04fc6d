"""Patient-safe folds, validation carve-outs and bootstrap intervals.

Fold tables hold test assignments only, (scope..., repeat, fold, patient_id); a patient trains in every fold of
its scope that does not test it. Shuffles are orders of a seeded hash, so any run gives the same folds.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.operators.balanced_folds import balanced_places
from cytoplane.operators.quantiles import exact_percentiles
from cytoplane.operators.ranking import positions
from cytoplane.session import cut_lineage, largest_group
from cytoplane.settings import BOUNDS, SizeBounds


def shuffle_key(seed: Column | int, value: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), value.cast("string")))


def _counted(regions: DataFrame, scope: list[str]) -> DataFrame:
    """Regions per patient and label: all that folds are planned from."""
    return regions.groupBy(*scope, "patient_id", "label").agg(F.count("*").alias("n"))


def _labels_of(counted: DataFrame, scope: list[str]) -> DataFrame:
    best = F.min_by("label", F.struct(-F.col("n"), "label"))
    return counted.groupBy(*scope, "patient_id").agg(best.alias("label"), (F.count("*") == 1).alias("pure"))


def patient_labels(regions: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per patient: the most frequent label (ties to the first) and whether it is the only one."""
    scope = scope or []
    return _labels_of(_counted(regions, scope), scope)


def pure_patients(regions: DataFrame) -> DataFrame:
    return patient_labels(regions).where("pure").select("patient_id", "label")


def patients_per_label(regions: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Distinct patients of each label; the smallest number bounds the folds."""
    return regions.groupBy(*(scope or []), "label").agg(F.count_distinct("patient_id").alias("patients"))


def leave_one_patient_out(regions: DataFrame, seed: int = 42) -> DataFrame:
    """One fold per patient; labels alternate while every patient has a single one."""
    return grouped_splits(regions, n_splits=None, n_repeats=1, seed=seed)


def grouped_splits(
    regions: DataFrame, n_splits: int | None = 4, n_repeats: int = 1, seed: int = 42, scope: list[str] | None = None,
    bounds: SizeBounds = BOUNDS, balance: bool = False,
) -> DataFrame:
    """Patient-grouped folds within each scope.

    As many splits as patients (or None): leave one patient out. Two labels and single-label patients: fold f tests
    the f-th shuffled patient of each label. Otherwise patients, ordered by label and shuffled, are dealt to the folds
    back and forth or, with ``balance``, allotted so that every fold gets about the same share of each label's regions.
    Each scope chooses for itself, so nested folds are one plan.
    """
    scope = scope or []
    return _folds(_counted(regions, scope), n_splits, n_repeats, seed, scope, bounds, balance)


def _folds(
    counted: DataFrame, n_splits: int | None, n_repeats: int, seed: int, scope: list[str], bounds: SizeBounds, balance: bool = False
) -> DataFrame:
    """Folds from patients and their labels. Seats of a label come from positions that split large groups; a patient's
    place among all labels follows from its seat and the number of patients of each label."""
    if not scope:
        return _folds(counted.withColumn("study", F.lit(0)), n_splits, n_repeats, seed, ["study"], bounds, balance).drop("study")
    counted = cut_lineage(counted)
    bounds = replace(bounds, largest_scores=largest_group(counted, scope))
    patients = _labels_of(counted, scope)
    per_label = counted.groupBy(*scope, "label").agg(F.count("*").alias("patients")).groupBy(*scope).agg(
        F.count("*").alias("labels"), F.min("patients").alias("fewest")
    )
    sides = patients.groupBy(*scope, "label").agg(F.count("*").alias("n"), F.min(F.col("pure").cast("int")).alias("pure"))
    shape = sides.groupBy(*scope).agg(
        F.sum("n").alias("patients"), F.min("pure").alias("all_pure"), F.collect_list(F.struct("label", "n")).alias("sides")
    )
    shape = shape.join(per_label, scope)
    asked = F.col("patients") if n_splits is None else F.lit(int(n_splits))
    most = F.when(F.col("labels") > 1, F.least("patients", "fewest")).otherwise(F.col("patients"))
    shape = shape.withColumn("most", most).withColumn("folds", F.greatest(F.lit(2), F.least(asked, "most")))
    limit = F.least("fewest", "folds")
    paired = (F.col("labels") == 2) & (F.col("all_pure") == 1) & (F.col("folds") <= F.col("most")) & (limit >= 2)
    mode = F.when(asked >= F.col("patients"), "single").when(paired, "paired").otherwise("dealt")
    shape = shape.withColumn("mode", mode).withColumn("limit", limit)
    planned = patients.join(shape, scope).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_repeats) - 1)))).where(
        (F.col("mode") != "single") | (F.col("repeat") == 0)
    )
    planned = planned.withColumn("key", shuffle_key(F.col("repeat") + seed, F.col("patient_id")))
    planned = planned.withColumns(
        {
            "lead": F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), "tie": F.struct("key", "patient_id"),
            "side": F.struct("label"),  # a missing label is a side too, also in joins
        }
    )
    general = shape.where(F.col("mode") == "dealt")
    balance = balance and not general.isEmpty()
    if balance:
        keys = planned.where(F.col("mode") == "dealt").select(*scope, "repeat", "patient_id", "lead", "tie")
        balanced = balanced_places(counted.join(general.select(*scope), scope, "left_semi"), general, keys, scope, bounds)
        planned = planned.join(balanced, [*scope, "repeat", "patient_id"], "left")
    planned = positions(planned, [*scope, "repeat", "side"], "lead", "tie", "seat", bounds)
    planned = positions(planned, [*scope, "repeat"], "lead", "tie", "shuffled", bounds)
    label = F.col("label")

    def earlier(s):
        return F.coalesce(s["label"] < label, s["label"].isNull() & label.isNotNull())

    def total(name: str, of):
        return F.aggregate(name, F.lit(0).cast("long"), lambda n, s: n + of(s))

    order = F.col("seat") + total("sides", lambda s: F.when(earlier(s), s["n"]).otherwise(F.lit(0)))
    around = total("sides", lambda s: F.least(s["n"], F.col("seat") + F.when(earlier(s), 1).otherwise(0)))
    planned = planned.withColumn("order", order).withColumn("single", F.when(F.col("all_pure") == 1, around).otherwise(F.col("shuffled")))
    turn, place = F.floor(F.col("order") / F.col("folds")), F.col("order") % F.col("folds")
    dealt = F.col("balanced") if balance else F.when(turn % 2 == 0, place).otherwise(F.col("folds") - 1 - place)
    fold = (
        F.when(F.col("mode") == "single", F.col("single"))
        .when(F.col("mode") == "dealt", dealt)
        .when(F.col("seat") < F.col("limit"), F.col("seat"))
    )
    return planned.select(*scope, "repeat", fold.cast("int").alias("fold"), "patient_id").where(F.col("fold").isNotNull())


def _every_fold(rows: DataFrame, folds: DataFrame, repeat: str = "repeat", fold: str = "fold") -> DataFrame:
    """Each row once per (repeat, fold). Folds count from 0 alike in every repeat."""
    last = folds.agg(F.max("repeat").alias("repeat"), F.max("fold").alias("fold")).first()
    return rows.withColumn(repeat, F.explode(F.sequence(F.lit(0), F.lit(last["repeat"])))).withColumn(
        fold, F.explode(F.sequence(F.lit(0), F.lit(last["fold"])))
    )


def assign_roles(regions: DataFrame, folds: DataFrame) -> DataFrame:
    """Every region once per (repeat, fold) as ``train`` or ``test``."""
    tested = folds.select("repeat", "fold", "patient_id", F.lit("test").alias("role"))
    return _every_fold(regions, folds).join(tested, ["repeat", "fold", "patient_id"], "left").withColumn(
        "role", F.coalesce("role", F.lit("train"))
    )


OUTER = ["outer_repeat", "outer_fold"]


def _training(counted: DataFrame, folds: DataFrame) -> DataFrame:
    """Patients and labels each outer fold trains on; regions are never repeated per fold."""
    tested = folds.select(F.col("repeat").alias("outer_repeat"), F.col("fold").alias("outer_fold"), "patient_id")
    return _every_fold(counted, folds, *OUTER).join(tested, [*OUTER, "patient_id"], "left_anti")


def nested_splits(
    regions: DataFrame, outer_splits: int = 5, inner_splits: int = 3, n_repeats: int = 1, seed: int = 42, bounds: SizeBounds = BOUNDS
) -> tuple[DataFrame, DataFrame]:
    """Outer folds, and inner folds drawn from each outer fold's training patients only."""
    counted = cut_lineage(_counted(regions, []))
    outer = cut_lineage(_folds(counted, outer_splits, n_repeats, seed, [], bounds))
    return outer, _folds(_training(counted, outer), inner_splits, n_repeats, seed, OUTER, bounds)


def validation_patients(regions: DataFrame, folds: DataFrame, seed: int = 42, bounds: SizeBounds = BOUNDS) -> DataFrame:
    """(repeat, fold, patient_id) of the first fold of a four-way split of each fold's training patients.

    Folds with fewer than four training patients have none.
    """
    folds = cut_lineage(folds)
    training = _training(_counted(regions, []), folds)
    enough = training.groupBy(*OUTER).agg(F.count_distinct("patient_id").alias("n")).where(F.col("n") >= 4)
    picked = _folds(training.join(enough.select(*OUTER), OUTER, "left_semi"), 4, 1, seed, OUTER, bounds)
    return picked.where(F.col("fold") == 0).select(
        F.col("outer_repeat").alias("repeat"), F.col("outer_fold").alias("fold"), "patient_id"
    )


def three_roles(regions: DataFrame, folds: DataFrame, seed: int = 42) -> DataFrame:
    """Regions per fold with roles train, val and test."""
    held = validation_patients(regions, folds, seed).withColumn("held", F.lit(True))
    rows = assign_roles(regions, folds).join(held, ["repeat", "fold", "patient_id"], "left")
    return rows.withColumn("role", F.when(F.col("held"), "val").otherwise(F.col("role"))).drop("held")


def usable_folds(assigned: DataFrame, y: str = "y", tested: bool = True) -> DataFrame:
    """Folds whose training rows, and unless ``tested`` is false also test rows, hold two classes; both must exist."""
    counts = [F.count_distinct(F.when(F.col("role") == role, F.col(y))).alias(role) for role in ("train", "test")]
    return assigned.groupBy("repeat", "fold").agg(*counts).where(
        (F.col("train") >= 2) & (F.col("test") >= (2 if tested else 1))
    ).select("repeat", "fold")


def usable_from_counts(regions: DataFrame, folds: DataFrame, y: str = "y", tested: bool = True) -> DataFrame:
    """``usable_folds`` from counts per patient and class alone: a fold trains on what it does not test."""
    known = regions.where(F.col(y).isNotNull())
    counted = known.groupBy("patient_id", F.col(y).alias("y")).agg(F.count("*").alias("n"))
    every = counted.groupBy("y").agg(F.sum("n").alias("whole"))
    sides = folds.join(counted, "patient_id").groupBy("repeat", "fold", "y").agg(F.sum("n").alias("n")).join(every, "y")
    seen = sides.groupBy("repeat", "fold").agg(F.count("*").alias("test"), F.count_if(F.col("n") == F.col("whole")).alias("gone"))
    classes = F.broadcast(every.agg(F.count("*").alias("classes")))  # one row
    usable = (F.col("classes") - F.col("gone") >= 2) & (F.col("test") >= (2 if tested else 1))
    return seen.crossJoin(classes).where(usable).select("repeat", "fold")


def bootstrap_means(
    values: DataFrame, keys: list[str], value: str = "value", order: str = "fold", n_boot: int = 2000, seed: int = 42
) -> DataFrame:
    """Mean of every resample (keys, boot, mean); draws are hashes of (seed, boot, draw)."""
    seat = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    size = F.count("*").over(Window.partitionBy(*keys))
    seated = values.withColumn("seat", seat).withColumn("size", size)
    draws = seated.select(*keys, "size", F.col("seat").alias("draw")).withColumn(
        "boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("boot").cast("string"), F.col("draw").cast("string")))
    picked = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("size")
    return (
        draws.withColumn("seat", picked)
        .join(seated.select(*keys, "seat", F.col(value).alias("drawn")), [*keys, "seat"])
        .groupBy(*keys, "boot").agg(F.avg("drawn").alias("mean"))
    )


def bootstrap_interval(
    values: DataFrame,
    keys: list[str],
    value: str = "value",
    order: str = "fold",
    confidence: float = 0.95,
    n_boot: int = 2000,
    seed: int = 42,
    bounds: SizeBounds = BOUNDS,
) -> DataFrame:
    """Mean of the values with a percentile interval of the bootstrap means."""
    tail = (1.0 - confidence) / 2.0
    means = bootstrap_means(values, keys, value, order, n_boot, seed)
    ends = exact_percentiles(means, keys, "mean", {"ci_low": tail, "ci_high": 1.0 - tail}, bounds)
    return values.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ends, keys)
