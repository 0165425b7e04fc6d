"""Validation, labelling and region tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoplane.functions import columns as C
from cytoplane.session import cut_lineage
from cytoplane.settings import NON_MARKER_COLUMNS, REQUIRED_CELL_COLUMNS, ROLE_TERMS


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_CELL_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_CELL_COLUMNS) -> DataFrame:
    if missing := missing_columns(df, required):
        raise ValueError(f"cell table is missing required columns: {missing}")
    return df


def duplicate_ids(df: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, key: str = "cell_id") -> DataFrame:
    """Fails at call time, naming at most five offending keys."""
    found = [row[key] for row in duplicate_ids(df, key).limit(5).collect()]
    if found:
        raise ValueError(f"duplicate {key} values: {found}")
    return df


def typed_cells(cells: DataFrame) -> DataFrame:
    """Ids and labels as strings, coordinates as doubles, a missing compartment as ``unknown``."""
    out = cells
    for name in ("cell_id", "sample_id", "patient_id", "region_id", "cell_type"):
        out = out.withColumn(name, F.col(name).cast("string"))
    for name in ("x", "y"):
        out = out.withColumn(name, F.col(name).cast("double"))
    if "compartment" in out.columns:
        out = out.withColumn("compartment", F.coalesce(F.col("compartment").cast("string"), F.lit("unknown")))
    return out


def join_labels(cells: DataFrame, regions: DataFrame, label: str = "label", validate: bool = True) -> DataFrame:
    """Left join of a many-to-one region label. Spark broadcasts the regions only if they are small."""
    if validate:
        require_unique(regions.select("region_id"), "region_id")
    return cells.join(regions.select("region_id", label), "region_id", "left")


def patient_labels(annotations: DataFrame, order: Column, label_map: dict[str, str] | None = None) -> DataFrame:
    """One label per normalised patient: the last annotation by ``order`` wins."""
    named = annotations.where(F.col("patient_id").isNotNull() & F.col("label").isNotNull()).select(
        C.patient_id(F.col("patient_id")).alias("patient_id"),
        C.canonical_label(F.col("label"), label_map).alias("label"),
        order.alias("row_no"),
    )
    named = named.where((F.length("patient_id") > 0) & (F.length("label") > 0))
    return named.groupBy("patient_id").agg(F.max_by("label", "row_no").alias("label"))


def label_regions(regions: DataFrame, clinical: DataFrame) -> DataFrame:
    """Clinical label of the patient where known, else the region's proxy label, with the mode per row."""
    known = clinical.select("patient_id", F.col("label").alias("clinical_label"))
    return (
        regions.join(known, "patient_id", "left")
        .withColumn("label", F.coalesce("clinical_label", "proxy_label"))
        .withColumn(
            "label_mode",
            F.when(F.col("clinical_label").isNotNull(), "clinical_patient_label").otherwise("proxy_patch_tme"),
        )
        .drop("clinical_label", "proxy_label")
    )


def name_types(cells: DataFrame, dictionary: DataFrame, key: str = "cell_type_id") -> DataFrame:
    """Type name from an id dictionary; ids outside it are ``Unknown``."""
    names = dictionary.select(key, F.col("cell_type").alias("type_name"))
    return cells.join(names, key, "left").withColumn("cell_type", F.coalesce("type_name", F.lit("Unknown"))).drop("type_name")


def drop_empty(cells: DataFrame) -> DataFrame:
    """Cells with pixels and a non-negative type id."""
    return cells.where((F.col("n_pixels") > 0) & (F.col("cell_type_id") >= 0))


def marker_columns(cells: DataFrame, skip: tuple[str, ...] = NON_MARKER_COLUMNS) -> list[str]:
    """Every numeric column that is not reserved."""
    return [f.name for f in cells.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def marker_matrix(cells: DataFrame, skip: tuple[str, ...] = NON_MARKER_COLUMNS) -> DataFrame:
    names = marker_columns(cells, skip)
    return cells.select(
        "region_id", "cell_id", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    )


def marker_rows(cells: DataFrame, skip: tuple[str, ...] = NON_MARKER_COLUMNS) -> DataFrame:
    """Long form (region_id, cell_id, marker, value)."""
    names = marker_columns(cells, skip)
    return marker_matrix(cells, skip).unpivot(["region_id", "cell_id"], names, "marker", "value")


def role_rows(cells: DataFrame, role_terms: dict = ROLE_TERMS) -> DataFrame:
    """One row per cell and role it plays (region_id, cell_id, role). The type is lowered once, in its own projection."""
    lowered = cells.select("region_id", "cell_id", F.lower(F.coalesce("cell_type", F.lit(""))).alias("kind"))
    named = [
        F.when(reduce(or_, [F.col("kind").contains(t) for t in terms]), F.lit(role)) for role, terms in role_terms.items()
    ]
    listed = lowered.select("region_id", "cell_id", F.explode(F.array(*named)).alias("role"))
    return listed.where(F.col("role").isNotNull())


def vocabulary(df: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct values in order with dense numbers from 0.

    The distinct values are range-partitioned; only the sizes of the partitions are added up in one place.
    """
    ordered = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    row = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    placed = cut_lineage(ordered.select(column, F.shiftright(row, 33).alias("part"), row.bitwiseAND((1 << 33) - 1).alias("place")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(sizes, "part").select(column, (F.col("base") + F.col("place")).cast("int").alias(code))


def encode(df: DataFrame, column: str, code: str) -> DataFrame:
    return df.join(vocabulary(df, column, code), column, "left")


def lift_statistics(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column of the training rows; a flat column gets deviation 1."""
    row = train.agg(
        *[F.avg(n).alias(f"m_{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"s_{i}") for i, n in enumerate(names)],
    ).first()
    out = {}
    for i, n in enumerate(names):
        mean, spread = float(row[f"m_{i}"] or 0.0), float(row[f"s_{i}"] or 0.0)
        out[n] = (mean, spread if spread > 1e-6 else 1.0)
    return out


def lift(df: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {n: (F.col(n) - F.lit(mean)) / F.lit(max(spread, 1e-6)) for n, (mean, spread) in statistics.items()}
    )


def attach_metadata(features: DataFrame, regions: DataFrame, family: str) -> DataFrame:
    """Region metadata on feature rows, with the fixed split marker and the family; null where a region has none."""
    meta = regions.select("region_id", "sample_id", "patient_id", "label")
    return features.join(meta, "region_id", "left").withColumns(
        {"split": F.lit("unassigned"), "feature_family": F.lit(family)}
    )


def region_labels(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", "label").dropDuplicates()


def cells_from_pixels(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Pixel count, centroid and channel means of every labelled object; wide channel columns."""
    return (
        pixels.where(F.col("cell_no") > 0)
        .groupBy("sample_id", "cell_no")
        .agg(
            F.count("*").alias("n_pixels"),
            F.avg("x").alias("x"),
            F.avg("y").alias("y"),
            *[F.avg(c).alias(f"marker_{c}") for c in channels],
        )
    )


def cells_from_pixel_rows(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Same from long pixel rows (sample_id, y, x, cell_no, channel, value)."""
    wide = [F.avg(F.when(F.col("channel") == c, F.col("value"))).alias(f"marker_{c}") for c in channels]
    first = F.col("channel") == F.lit(channels[0]) if channels else F.lit(True)
    return (
        pixels.where(F.col("cell_no") > 0)
        .groupBy("sample_id", "cell_no")
        .agg(F.count_if(first).alias("n_pixels"), F.avg("x").alias("x"), F.avg("y").alias("y"), *wide)
    )


def region_table(cells: DataFrame, label: str = "label") -> DataFrame:
    """One row per region with the sample, patient and label of its first cell and the cell count."""
    firsts = [F.min_by(c, "cell_id").alias(c) for c in ("sample_id", "patient_id", label) if c in cells.columns]
    return cells.groupBy("region_id").agg(*firsts, F.count("*").alias("n_cells"))


def keep_large_regions(cells: DataFrame, minimum: int = 40) -> DataFrame:
    """Cells of regions with at least ``minimum`` cells."""
    kept = cells.groupBy("region_id").count().where(F.col("count") >= minimum).select("region_id")
    return cells.join(kept, "region_id", "left_semi")


def proxy_labels(cells: DataFrame) -> DataFrame:
    return cells.groupBy("region_id").agg(C.proxy_label(F.col("cell_type")).alias("proxy_label"))


def inverse_frequency_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """Class counts with weight N / n_class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("weight", total / F.greatest(F.col("n"), F.lit(1)))
