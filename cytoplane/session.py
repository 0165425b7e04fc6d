"""Session helpers."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.settings import BOUNDS, SizeBounds


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and single-node runs; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cytoplane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. One is made only for a local master without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows in the biggest group: one narrow scan with map-side counts, used to pick a plan."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def measured(cells: DataFrame, bounds: SizeBounds = BOUNDS) -> SizeBounds:
    """Bounds that also know the biggest region, so that later steps need not count again."""
    if bounds.largest_region is not None:
        return bounds
    return replace(bounds, largest_region=largest_group(cells, ["region_id"]))


def group_size(rows: DataFrame, keys: list[str], bounds: SizeBounds, per_cell: int = 1) -> int:
    """Upper bound of rows per group: from the measured region size where known, else counted."""
    known = bounds.largest_region if "region_id" in keys else bounds.largest_scores
    if known is not None:
        return known * per_cell
    return largest_group(rows, keys)


def measured_scores(scores: DataFrame, keys: list[str], bounds: SizeBounds = BOUNDS) -> SizeBounds:
    """Bounds that also know the biggest score group."""
    if bounds.largest_scores is not None:
        return bounds
    return replace(bounds, largest_scores=largest_group(scores, keys))
