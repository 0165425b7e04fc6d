"""Shared helpers: intermediate tables, whole-text word grids and connected parts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: larger than any other id.
NO_ID = 2**63 - 1

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; own one in /tmp only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: cuts lineage and outlives executors.

    Shuffle files of the finished job are given back at its end where Spark offers that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one array with 64-bit offsets; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def text_slices(column: pa.LargeStringArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes (a longer text is a run alone): first row, end row, bytes, row bounds."""
    rows = len(column)
    if not rows:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64, rows + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def word_bounds(data: np.ndarray, bounds: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes with ``letter[byte]`` inside each row, and each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = letter[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts, ends = inside & edge[:-1], inside & edge[1:]
    starts[1:] |= inside[1:] & ~inside[:-1]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of byte ranges from one prefix sum; callers confirm equal hashes on the bytes."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(data):
            n = max(len(data) + 1, 1 << 21)
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def spaces() -> np.ndarray:
    """Byte table of words of ``[^\\x20\\x09-\\x0D]+``."""
    letter = np.ones(256, bool)
    letter[[0x20, *range(0x09, 0x0E)]] = False
    return letter


def connected(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest node reachable over undirected edges (a, b), for nodes with an edge to another.

    Alternating large-star and small-star steps: each is a grouped minimum and a join, the rounds grow with the
    logarithm of the longest part. The rounds end when count and checksum of the links stay.
    """

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = state(current)
    while True:
        ways = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(
            ways.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = small.unionByName(floor.select("a", F.col("m").alias("b")))
        current = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if (now := state(current)) == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("low"))
        seen = now
