"""Segmented images as pixel tables, and studies built from them."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators import ingest
from cytoplane.settings import PrepareSettings
from cytoplane.sources import tables
from cytoplane.sources.image_folder import IMAGES, LABELS, MASKS, read_pixels

# File names of the image folder layout.
CHANNELS_FILE = "channels_codex_CRC_celltune.txt"
DICTIONARY_FILE = "mapping_id_to_cell_type_name.txt"


def _labels(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers and their types."""
    with np.load(io.BytesIO(content)) as archive:
        types = archive["data"].reshape(-1)
        return archive["cell_no"] if "cell_no" in archive else np.arange(types.size, dtype=np.int64), types


def _files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]+)\.npz$", 1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select(
        stem.alias("sample_id"), F.col("content").alias(name)
    )


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            numbers, labels = _labels(batch["labels"][i].as_py())
            yield pa.RecordBatch.from_pydict(
                {
                    "sample_id": pa.repeat(batch["sample_id"][i], labels.size),
                    "cell_no": pa.array(numbers),
                    "cell_type_id": pa.array(labels.astype(np.int32)),
                }
            )


def read_raster(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, cell labels) of the samples that have all three files: mask, labels and image.

    Files are matched by name; images are read in bands of rows. Pixels outside every cell are not emitted.
    """
    masks = _files(spark, f"{root}/{MASKS}", "mask")
    labels = _files(spark, f"{root}/{LABELS}", "labels")
    images = _files(spark, f"{root}/{IMAGES}", "image")
    pixels = read_pixels(spark, root)
    known = labels.join(masks.select("sample_id"), "sample_id", "left_semi").join(images.select("sample_id"), "sample_id", "left_semi")
    cell_labels = known.mapInArrow(_label_batches, "sample_id string, cell_no long, cell_type_id int")
    return pixels, cell_labels


def cells_from_raster(
    pixels: DataFrame, cell_labels: DataFrame, dictionary: DataFrame, channels: list[str], settings: PrepareSettings = PrepareSettings()
) -> DataFrame:
    """Typed cells in patch regions of sufficient size."""
    wide = pixels.select("sample_id", "cell_no", "x", "y", *[F.get("channels", i).alias(c) for i, c in enumerate(channels)])
    found = ingest.cells_from_pixels(wide, channels).join(cell_labels, ["sample_id", "cell_no"])
    named = ingest.name_types(ingest.drop_empty(found), dictionary)
    cells = named.select(
        F.concat("sample_id", F.lit("_cell_"), F.col("cell_no").cast("string")).alias("cell_id"),
        "sample_id",
        C.patient_of_sample(F.col("sample_id")).alias("patient_id"),
        C.patch_region(F.col("sample_id"), F.col("x"), F.col("y"), settings.patch_size_px).alias("region_id"),
        "x", "y", "cell_type", C.compartment(F.col("cell_type")).alias("compartment"),
        *[f"marker_{c}" for c in channels],
    )
    return ingest.keep_large_regions(cells, settings.min_cells_per_region)


def load_raster_study(
    spark: SparkSession, root: str, annotations: DataFrame | None = None, dataset: str = "raster",
    settings: PrepareSettings = PrepareSettings(), channels_file: str = CHANNELS_FILE, dictionary_file: str = DICTIONARY_FILE,
) -> tables.Study:
    """Study from a folder of segmented images; labels are clinical where known, else the regions' proxy labels."""
    channels = tables.read_channel_names(spark, f"{root}/{channels_file}")
    dictionary = tables.read_type_dictionary(spark, f"{root}/{dictionary_file}")
    cells = cells_from_raster(*read_raster(spark, root), dictionary, channels, settings)
    regions = cells.groupBy("region_id").agg(
        F.min_by("sample_id", "cell_id").alias("sample_id"), F.min_by("patient_id", "cell_id").alias("patient_id"),
        C.proxy_label(F.col("cell_type")).alias("proxy_label"), F.count("*").alias("n_cells"),
    )
    if annotations is None:
        annotations = spark.createDataFrame([], "patient_id string, label string")
    labelled = ingest.label_regions(regions, annotations)
    meta = {
        "source": root, "patch_size_px": settings.patch_size_px, "min_cells_per_region": settings.min_cells_per_region,
    }
    return tables.Study(cells, labelled, tables.make_study(cells.limit(0).withColumn("label", F.lit("")), dataset, meta).meta)
