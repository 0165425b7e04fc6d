"""Readers and writers of cell tables, annotations, studies, features and results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.operators import ingest
from cytoplane.plans.features import widen


@dataclass
class Study:
    """Related tables of one study; ``meta`` is a single row."""

    cells: DataFrame
    regions: DataFrame
    meta: DataFrame

    @property
    def tasks(self) -> DataFrame:
        return self.regions.drop("n_cells")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV, TSV or parquet by suffix. Without a schema text columns are typed from the data in one extra pass."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        return spark.read.parquet(path)
    separators = {"csv": ",", "tsv": "\t"}
    suffix = lowered.rsplit(".", 1)[-1]
    if suffix not in separators:
        raise ValueError(f"unsupported table format: .{suffix}")
    reader = spark.read.option("header", True).option("sep", separators[suffix])
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def load_cell_study(
    spark: SparkSession, cells_path: str, regions_path: str | None = None, dataset: str = "cells", label: str = "label",
    schema: str | None = None,
) -> Study:
    """Study from a cell table; labels from the cells, or from a region table if the cells have none."""
    cells = ingest.require_columns(read_table(spark, cells_path, schema))
    ingest.require_unique(cells)
    if label not in cells.columns:
        if regions_path is None:
            raise ValueError(f"the cells have no {label!r} column and no region table was given")
        regions = read_table(spark, regions_path)
        if not {"region_id", label} <= set(regions.columns):
            raise ValueError(f"the region table must have region_id and {label}")
        cells = ingest.join_labels(cells, regions, label)
    cells = ingest.typed_cells(cells)
    if label != "label":
        cells = cells.withColumnRenamed(label, "label")
    cells = cells.withColumn("label", F.col("label").cast("string"))
    return make_study(cells, dataset, {"source": cells_path, "label_column": label})


def make_study(cells: DataFrame, dataset: str, meta: dict[str, str]) -> Study:
    spark = cells.sparkSession
    rows = spark.range(1).select(
        F.lit(dataset).alias("dataset_name"), *[F.lit(str(v)).alias(k) for k, v in meta.items()]
    )
    return Study(cells, ingest.region_table(cells), rows)


def read_channel_names(spark: SparkSession, path: str) -> list[str]:
    """Non-blank lines of a channel list in file order; a list of names, one per image channel."""
    whole = spark.read.text(path, wholetext=True).first()
    return [line.strip() for line in whole["value"].splitlines() if line.strip()] if whole else []


def read_type_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(cell_type_id, cell_type) from a text of the form {0: 'Tumor', 1: 'Stroma', ...}."""
    pair = r"""(-?\d+)['"]?\s*:\s*['"]([^'"]*)['"]"""
    whole = spark.read.text(path, wholetext=True)
    ids = F.regexp_extract_all("value", F.lit(pair), F.lit(1))
    names = F.regexp_extract_all("value", F.lit(pair), F.lit(2))
    return whole.select(F.explode(F.arrays_zip(ids.alias("i"), names.alias("n"))).alias("p")).select(
        F.col("p.i").cast("int").alias("cell_type_id"), F.col("p.n").alias("cell_type")
    )


def read_annotations(
    spark: SparkSession, path: str, patient: str = "patient_id", label: str = "label", label_map: dict[str, str] | None = None
) -> DataFrame:
    """One label per normalised patient from an annotation table, the last row of a patient winning."""
    rows = read_table(spark, path)
    for column in (patient, label):
        if column not in rows.columns:
            raise KeyError(f"column {column!r} was not found in {path}")
    named = rows.select(F.col(patient).alias("patient_id"), F.col(label).alias("label"), F.monotonically_increasing_id().alias("row_no"))
    return ingest.patient_labels(named, F.col("row_no"), label_map)


def save_study(study: Study, folder: str) -> None:
    """Cells by sample, regions, and the meta row as JSON. Cells of one sample go to files of bounded size."""
    study.cells.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("sample_id").parquet(f"{folder}/cells")
    study.regions.write.mode("overwrite").parquet(f"{folder}/regions")
    study.meta.write.mode("overwrite").json(f"{folder}/meta")


def load_study(spark: SparkSession, folder: str) -> Study:
    cells = spark.read.parquet(f"{folder}/cells").withColumn("sample_id", F.col("sample_id").cast("string"))
    return Study(cells, spark.read.parquet(f"{folder}/regions"), spark.read.json(f"{folder}/meta"))


def save_features(features: DataFrame, folder: str) -> None:
    """The long table as parquet by family, and the wide one as CSV ordered by region and family."""
    features.write.mode("overwrite").partitionBy("feature_family").parquet(f"{folder}/features")
    keys = ["region_id", "sample_id", "patient_id", "label", "split", "feature_family"]
    wide = widen(features, keys=keys).orderBy("region_id", "feature_family")
    wide.write.mode("overwrite").option("header", True).csv(f"{folder}/feature_table_csv")


def load_features(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/features")


def load_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide feature CSV back as long rows."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    keys = ["region_id", "sample_id", "patient_id", "label", "split", "feature_family"]
    names = [c for c in wide.columns if c not in keys]
    doubles = wide.select(*keys, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    return doubles.unpivot(keys, names, "name", "value").where(F.col("value").isNotNull())


def save_results(fold_metrics: DataFrame, summary: DataFrame, folder: str) -> None:
    fold_metrics.write.mode("overwrite").json(f"{folder}/fold_metrics")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def load_results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Fold metrics and summary of an earlier run, for instance as a baseline."""
    metrics = spark.read.schema("run string, fold int, metric string, value double").json(f"{folder}/fold_metrics")
    summary = spark.read.schema(
        "run string, metric string, mean double, std double, ci_low double, ci_high double"
    ).json(f"{folder}/summary")
    return metrics, summary
