"""Folders of segmented images as a Spark data source, and the sink that writes them.

A folder holds ``cells/<sample>.npz`` (cell number of every pixel, 0 outside), ``cells2labels/<sample>.npz`` (type of
every cell number) and ``data/antibodies/<sample>.npz`` (rows x columns x channels), each with one array ``data``.
Where cell numbers are sparse, the labels file has a second array ``cell_no``: the numbers that ``data`` belongs to. Its
size then follows the cells of the sample and not the largest number.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MASKS, LABELS, IMAGES = "cells", "cells2labels", "data/antibodies"
BAND_BYTES = 32 << 20
DENSE_LABELS = 1024  # cell numbers up to here are written as one plain array, and above it if a quarter of them is used
PIXELS_PER_BATCH = 200_000
SINGLE_BANDS = 512  # up to so many bands each has a task of its own


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root))


class ArrayRows:
    """Consecutive rows of the array ``data`` of an archive, in calls from top to bottom.

    Archives that are stored plainly are read from the first asked byte on; compressed ones are unpacked up to it, never
    as a whole. Arrays in column order cannot be cut by rows and are read whole.
    """

    def __init__(self, source) -> None:
        self.member = zipfile.ZipFile(source).open("data.npy")
        version = np.lib.format.read_magic(self.member)
        header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, columns_first, self.dtype = header(self.member)
        self.start = self.member.tell()
        self.row_bytes = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize
        self.whole = None
        if columns_first:
            self.whole = np.frombuffer(self.member.read(), self.dtype).reshape(self.shape, order="F")

    def rows(self, top: int, bottom: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[top:bottom]
        self.member.seek(self.start + top * self.row_bytes)
        content = self.member.read((bottom - top) * self.row_bytes)
        return np.frombuffer(content, self.dtype).reshape(bottom - top, *self.shape[1:])


@contextmanager
def array_rows(system: fs.FileSystem, path: str) -> Iterator[ArrayRows]:
    with system.open_input_file(path) as source:
        yield ArrayRows(source)


class Bands(InputPartition):
    """Stretches of rows (sample, first band, end, bands of the sample) that one task reads one after the other."""

    def __init__(self, stretches: list[tuple[str, int, int, int]]) -> None:
        self.stretches = stretches


class ImageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/")
        self.samples = set(options["samples"].split(",")) if options.get("samples") else None
        self.channels = [int(c) for c in options["channels"].split(",")] if options.get("channels") else None
        self.band_bytes = int(options.get("bandbytes", BAND_BYTES))

    def partitions(self) -> list[Bands]:
        """Bands of about equal bytes, from file names and sizes alone; nothing is opened here.

        Many small bands share tasks of about equal bytes, so that the number of tasks follows the bytes, not the samples.
        """
        system, root = _file_system(self.root)
        sizes = []
        for folder in (MASKS, LABELS, IMAGES):
            files = system.get_file_info(fs.FileSelector(f"{root}/{folder}"))
            sizes.append({f.base_name.removesuffix(".npz"): f.size for f in files if f.is_file and f.base_name.endswith(".npz")})
        complete = sorted(sizes[0].keys() & sizes[1].keys() & sizes[2].keys())
        bands = []
        for sample in complete:
            if self.samples is None or sample in self.samples:
                size = sizes[0][sample] + sizes[2][sample]
                parts = max(1, -(-size // self.band_bytes))
                bands.extend((sample, part, parts, size / parts) for part in range(parts))
        total = sum(b[3] for b in bands)
        share = total / max(SINGLE_BANDS, -(-total // BAND_BYTES)) if len(bands) > SINGLE_BANDS else 0
        tasks: list[list[tuple[str, int, int, int]]] = []
        room = 0.0
        for sample, part, parts, size in bands:
            if room <= 0:
                tasks.append([])
                room = share
            room -= size
            now = tasks[-1]
            if now and now[-1][0] == sample:
                now[-1] = (sample, now[-1][1], part + 1, parts)
            else:
                now.append((sample, part, part + 1, parts))
        return [Bands(stretches) for stretches in tasks]

    def read(self, partition: Bands | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without samples
            return
        system, root = _file_system(self.root)
        for sample, begin, end, parts in partition.stretches:
            name = f"{sample}.npz"
            with array_rows(system, f"{root}/{MASKS}/{name}") as mask, array_rows(system, f"{root}/{IMAGES}/{name}") as image:
                height, width = mask.shape
                first, last = (height * p // parts for p in (begin, end))
                step = max(1, PIXELS_PER_BATCH // max(width, 1))
                for top in range(first, last, step):
                    yield self._pixels(sample, top, mask.rows(top, min(top + step, last)), image)

    def _pixels(self, sample: str, top: int, part: np.ndarray, image: ArrayRows) -> pa.RecordBatch:
        ys, xs = np.nonzero(part > 0)
        values = np.zeros((0, image.shape[-1]))
        if ys.size:  # rows without a cell are not read from the image
            low, high = int(ys[0]), int(ys[-1]) + 1
            values = image.rows(top + low, top + high)[ys - low, xs]
        if self.channels is not None:
            values = values[:, self.channels]
        offsets = np.arange(ys.size + 1, dtype=np.int32) * values.shape[1]
        return pa.RecordBatch.from_pydict(
            {
                "sample_id": pa.repeat(pa.scalar(sample), ys.size),
                "x": pa.array(xs.astype(np.float64)),
                "y": pa.array((ys + top).astype(np.float64)),
                "cell_no": pa.array(part[ys, xs].astype(np.int64)),
                "channels": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.float64).reshape(-1))),
            }
        )


class SegmentedImages(DataSource):
    """Pixels inside cells of all samples that have the three files.

    Options: ``samples`` (comma-separated names, default all), ``channels`` (comma-separated numbers, in the order
    wanted, default all) and ``bandBytes``. A partition is a band of rows of one sample, or several small ones, so an
    image is never one row and no image bytes are shuffled.
    """

    @classmethod
    def name(cls) -> str:
        return "segmented_images"

    def schema(self) -> str:
        return "sample_id string, x double, y double, cell_no long, channels array<double>"

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options)


def read_pixels(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(SegmentedImages)
    return spark.read.format("segmented_images").options(**options).load(root)


def label_arrays(numbers: np.ndarray, types: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a labels file: the type of every number from 0, -1 where unknown; of the known ones only if they are sparse."""
    size = int(numbers.max(initial=-1)) + 1
    if size > max(DENSE_LABELS, 4 * numbers.size):
        return {"data": types.astype(np.int32), "cell_no": numbers}
    dense = np.full(size, -1, dtype=np.int32)
    dense[numbers] = types
    return {"data": dense}


def _save(system: fs.FileSystem, path: str, **arrays: np.ndarray) -> None:
    """Written beside its place and moved there, so that a repeated or doubled task leaves one whole file."""
    draft = f"{path}.{uuid4().hex}.draft"
    with system.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name, array in arrays.items():
            with archive.open(f"{name}.npy", "w", force_zip64=True) as member:
                np.lib.format.write_array(member, array, allow_pickle=False)
    system.move(draft, path)


def _writer(root: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def kernel(pixels: pa.Table, labels: pa.Table) -> pa.Table:
        sample = (pixels if pixels.num_rows else labels)["sample_id"][0].as_py()
        system, folder = _file_system(root)
        xs, ys, numbers = (pixels[c].to_numpy().astype(np.int64) for c in ("x", "y", "cell_no"))
        shape = (int(ys.max(initial=-1)) + 1, int(xs.max(initial=-1)) + 1)
        mask = np.zeros(shape, dtype=np.int64)
        mask[ys, xs] = numbers
        values = pixels["channels"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = values.reshape(len(xs), -1) if len(xs) else np.zeros((0, 0))
        image = np.zeros((*shape, values.shape[1]))
        image[ys, xs] = values
        known = labels["cell_no"].to_numpy().astype(np.int64)
        types = label_arrays(known, labels["cell_type_id"].to_numpy())
        for part, arrays in ((MASKS, {"data": mask}), (LABELS, types), (IMAGES, {"data": image})):
            _save(system, f"{folder}/{part}/{sample}.npz", **arrays)
        return pa.table({"sample_id": [sample], "n_pixels": pa.array([len(xs)], pa.int64())})

    return kernel


def write_images(pixels: DataFrame, labels: DataFrame, root: str) -> None:
    """Writes pixels (sample_id, x, y, cell_no, channels; one row per spot, no nulls) and labels (sample_id, cell_no,
    cell_type_id) as an image folder. A sample is one file of each kind, so one task writes it whole.
    """
    system, folder = _file_system(root)
    for part in (MASKS, LABELS, IMAGES):
        system.create_dir(f"{folder}/{part}", recursive=True)
    written = (
        pixels.select("sample_id", "x", "y", "cell_no", "channels").groupBy("sample_id")
        .cogroup(labels.select("sample_id", "cell_no", "cell_type_id").groupBy("sample_id"))
        .applyInArrow(_writer(root), "sample_id string, n_pixels long")
    )
    written.write.format("noop").mode("overwrite").save()
