"""Quality by compression: zstandard dictionaries of good and bad text, their size difference as a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are compressed in blocks of this many bytes, each with the whole dictionary, so that long texts count alike.
BLOCK = 2048
#: Bounds of the training sample: expected labelled documents of each class, and bytes of each dictionary.
MOST_LABELLED, DICTIONARY_BYTES = 4000, 256 << 10
#: A text gives this many stretches to its dictionary at most, of the bytes that let every sampled text give one, though
#: no fewer than the second figure and no more than the third.
STRETCHES, SHORTEST, LONGEST = 8, 96, 512
THRESHOLD = 0.7
FEATURES = 7


@dataclass
class Model:
    """Dictionary contents, and logistic weights of standardised features."""

    good: bytes
    bad: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0

    def sizer(self, level: int = 3):
        """Function text -> compressed sizes with the good, the bad and no dictionary, and bytes."""
        import zstandard as z

        quiet = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        tools = []
        for content in (self.good, self.bad):
            made = z.ZstdCompressionDict(content or b"\0" * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            tools.append(z.ZstdCompressor(dict_data=made, **quiet))
        tools.append(z.ZstdCompressor(**quiet))

        def sizes(text: bytes) -> tuple[int, ...]:
            blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
            return (*(sum(len(t.compress(b)) for b in blocks) for t in tools), len(text))

        return sizes

    def score(self, sizes: np.ndarray) -> np.ndarray:
        x = (features(sizes) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised size difference of the two dictionaries, that difference against the plain size, the plain size
    per byte, their squares and one product. An empty text has zeros."""
    good, bad, plain, raw = np.asarray(sizes, float).reshape(-1, 4).T
    gap = bad - good
    x = np.stack([gap / np.maximum(np.maximum(good, bad), 1), gap / np.maximum(plain, 1), plain / np.maximum(raw, 1)], axis=1)
    return np.concatenate([x, x**2, x[:, :1] * x[:, 1:2]], axis=1)


def _stretches(text: bytes, length: int, h: int) -> list[bytes]:
    """Stretches of ``length`` bytes spread evenly over the text, ``STRETCHES`` at most; the hash says which comes first."""
    n = max(1, -(-len(text) // length))
    picked = sorted({k * n // STRETCHES for k in range(STRETCHES)}) if n > STRETCHES else list(range(n))
    turn = h % len(picked)
    return [text[k * length : (k + 1) * length] for k in picked[turn:] + picked[:turn]]


def _dictionary(rows: list[tuple[int, int, bytes]], size: int) -> bytes:
    """One stretch of every document, then a second of each and so on, each stretch once, up to ``size`` bytes."""
    out: list[bytes] = []
    seen: set[bytes] = set()
    total = 0
    for _, _, stretch in sorted(rows):
        if stretch not in seen and total < size:
            seen.add(stretch)
            out.append(stretch)
            total += len(stretch) + 1
    return b" ".join(out)[:size]


def train(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_labelled: int = MOST_LABELLED,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> Model:
    """Learns from a bounded sample of labelled documents.

    Each class is sampled by a hash of the id at the rate that gives ``most_labelled`` documents (smaller classes
    whole); half of the sample fills the dictionaries and the other half calibrates. Ids labelled both ways, null ids
    and labels teach nothing. With one class only, the score is that class's share of the labels for every text.
    """
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id"))
    marked = marked.agg(F.min(label_col).alias("y"), F.max(label_col).alias("top")).where("y = top").withColumn(
        "h", F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30))
    )
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return Model(b"", b"", bias=float(np.log(share / (1 - share))))
    rate = {y: int(min(1.0, most_labelled / n) * (1 << 30)) for y, n in counts.items()}
    chosen = marked.where(F.col("h") < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).select("id", "y", "h")
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    picked = texts.join(F.broadcast(chosen), "id")  # about two classes of most_labelled ids
    half = F.pmod(F.xxhash64("h"), F.lit(2))

    length = {y: min(LONGEST, max(SHORTEST, 2 * dictionary_bytes // min(n, most_labelled))) for y, n in counts.items()}

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2).cast(pa.binary()).to_pylist())
            rows = [(turn, h, y, s) for h, y, t in of for turn, s in enumerate(_stretches(t, length[y], h))]
            kinds = zip(("turn", "h", "y", "stretch"), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))
            yield pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    source = picked.select("h", F.col("y").cast("int").alias("y"), "text")
    rows = [tuple(r) for r in source.where(half == 0).mapInArrow(stretches, "turn long, h long, y int, stretch binary").toLocalIterator()]
    model = Model(
        _dictionary([(turn, h, bytes(s)) for turn, h, y, s in rows if y == 1], dictionary_bytes),
        _dictionary([(turn, h, bytes(s)) for turn, h, y, s in rows if y == 0], dictionary_bytes),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizer()
        for batch in batches:
            found = np.array([sizes(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(found[:, k]) for k in range(4))], ["y", "a", "b", "c", "d"])

    fitted = source.where(half == 1).mapInArrow(measure, "y int, a long, b long, c long, d long").toPandas().sort_values(["y", "a", "b", "c", "d"])
    y, x = fitted["y"].to_numpy(float), features(fitted[["a", "b", "c", "d"]].to_numpy())
    if len(set(y)) < 2:
        share = (counts[1] + 1) / (sum(counts.values()) + 2)
        model.bias = float(np.log(share / (1 - share)))
        return model
    # classes count as often as they are labelled, whatever their sampling rate
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    _fit(model, x, y, weight * len(y) / weight.sum())
    return model


def _fit(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> None:
    """Weighted logistic regression by Newton steps on standardised features: the score is a probability."""
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    one = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    w = np.zeros(one.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        curve = (one * (weight * p * (1 - p))[:, None]).T @ one + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, one.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights, model.bias = w[:-1], float(w[-1])


def score_quality(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from ``threshold``), and the three sizes.

    Only the text is scored, whole; null is read as the empty text, whose sizes are zero. Equal texts score alike;
    other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = model.sizer()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            found = np.array([sizes(t) for t in texts], np.int64).reshape(-1, 4)
            score = model.score(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(pa.array(found[:, k]) for k in range(3))],
                ["doc_id", "score", "predicted", "size_good", "size_bad", "size_plain"],
            )

    schema = "doc_id long, score double, predicted int, size_good long, size_bad long, size_plain long"
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, schema)
