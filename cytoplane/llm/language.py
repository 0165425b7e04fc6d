"""Language identification as a mixture: EM over words from character n-gram likelihoods, then a penalised choice."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.shared import text_column, text_slices, word_bounds, spaces

UNDETERMINED = "und"
#: n-grams are hashed into this many buckets; counts of two to ``GRAM`` bytes of a space-edged, lower-cased word.
BUCKETS, GRAM = 1 << 16, 4
#: Words whose n-grams are formed at once.
WORDS = 1 << 14
#: Bound of the training sample: expected number of documents of each language.
MOST_DOCUMENTS = 1000
#: One in so many sampled documents calibrates the penalty; the share of them that may get a second language.
CALIBRATION, FALSE_SETS = 8, 0.02
_WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numbers such as fractions


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages x buckets, log probability
    rate: float = 0.0  # log likelihood a word that a further language must add, see train()


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word with one space at either side, and the word of each n-gram."""
    length = ends - starts + 2
    begin = np.cumsum(length) - length
    word = np.repeat(np.arange(len(starts)), length)
    place = np.arange(len(word)) - begin[word]
    source = np.clip(starts[word] + place - 1, 0, max(len(data) - 1, 0))
    letters = np.where((place == 0) | (place == length[word] - 1), np.uint8(32), data[source] if len(data) else np.uint8(32)).astype(np.uint64)
    letters = np.where((letters >= 65) & (letters <= 90), letters + np.uint64(32), letters)
    buckets, words = [], []
    value = letters.copy()
    for n in range(2, GRAM + 1):
        value = value[:-1] * np.uint64(257) + letters[n - 1 :]
        same = word[: len(value)] == word[n - 1 :]
        hashed = (value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(48)
        buckets.append(hashed[same].astype(np.int64))
        words.append(word[: len(value)][same])
    return np.concatenate(buckets), np.concatenate(words)


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_documents: int = MOST_DOCUMENTS) -> Model:
    """n-gram probabilities of each language from a bounded sample of the given labelled rows.

    Each language is sampled by a hash of the id at the rate that gives ``most_documents`` rows; smaller ones are read
    whole. Rows with a null language or text teach nothing. Without any row the model is empty and every text is
    undetermined. Only n-gram counts (languages x buckets at most) come to the driver, and a number for each calibration
    document.

    One document in ``CALIBRATION`` of a language with enough of them is kept from the n-grams. On these, the log
    likelihood a word that further languages add to a text of one language is measured, and the rate that all but
    ``FALSE_SETS`` of them stay under becomes part of the penalty of a language: n-grams of a word, and words of a text,
    are not independent, so a penalty for the number of words alone is too low.
    """
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)).alias("h"), F.col(text_col).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, most_documents / n) * (1 << 30)))])
    apart = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(n, most_documents) >= 8 * CALIBRATION)])
    kept_back = apart[F.col("lang")] & (F.pmod(F.col("h"), F.lit(CALIBRATION)) == 0)
    sampled = rows.where(F.col("h") < rates[F.col("lang")])
    picked = sampled.where(~kept_back)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, end, data, bounds in text_slices(text_column(batch.column(1)), 1 << 18):
                starts, ends, first = word_bounds(data, bounds, spaces())
                if not len(starts):
                    continue
                for k in range(row, end):
                    c = counts.setdefault(langs[k], np.zeros(BUCKETS, np.int64))
                    for a in range(first[k - row], first[k - row + 1], WORDS):
                        part = slice(a, min(a + WORDS, first[k - row + 1]))
                        c += np.bincount(grams(data, starts[part], ends[part])[0], minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    found = picked.select("lang", "text").mapInArrow(kernel, "lang string, bucket long, n long")
    table = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in table["lang"]], table["bucket"].to_numpy(int)] = table["n"]
    smooth = counts + 0.05
    model = Model(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32))
    if any(min(n, most_documents) >= 8 * CALIBRATION for n in sizes.values()) and len(languages) > 1:
        model.rate = _false_rate(sampled.where(kept_back).select("text"), model)
    return model


def _word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model) -> np.ndarray:
    """Log likelihood of each word in each language, n-grams formed in bounded runs of words."""
    scores = np.empty((len(starts), len(model.languages)))
    for a in range(0, len(starts), WORDS):
        part = slice(a, a + WORDS)
        bucket, word = grams(data, starts[part], ends[part])
        for k in range(len(model.languages)):
            scores[part, k] = np.bincount(word, model.table[k][bucket], minlength=len(starts[part]))
    return scores


def _false_rate(texts: DataFrame, model: Model) -> float:
    """The rate that all but ``FALSE_SETS`` of the texts, taken as of one language each, stay under."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in text_slices(text_column(batch.column(0)), 1 << 18):
                starts, ends, first = word_bounds(data, bounds, spaces())
                if len(starts):
                    gain, sizes = _gains(_word_scores(data, starts, ends, model), first)
                    yield pa.RecordBatch.from_arrays([pa.array((gain - 0.5 * np.log(np.maximum(sizes, 2))) / sizes)], ["rate"])

    rates = texts.mapInArrow(kernel, "rate double").toPandas()["rate"].to_numpy()  # a number for each calibration document
    return float(max(0.0, np.quantile(rates, 1 - FALSE_SETS))) if len(rates) else 0.0


def _gains(scores: np.ndarray, first: np.ndarray, steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """What all languages together add to the log likelihood of the best one, and the words, of each row with a word."""
    full = np.flatnonzero(np.diff(first))
    weight = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0))
    bounds = np.append(first[full], first[-1])
    sizes = np.diff(bounds)
    share, fit = _em(weight, bounds, np.full((len(full), scores.shape[1]), 1 / scores.shape[1]), steps)
    alone = np.add.reduceat(np.log(weight[np.arange(len(weight)), np.repeat(share.argmax(axis=1), sizes)]), bounds[:-1])
    return fit - alone, sizes


def _em(weight: np.ndarray, first: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each row after EM from ``share`` and their log likelihood; every row has a word."""
    sizes = np.diff(first)
    for _ in range(steps):
        r = weight * np.repeat(share, sizes, axis=0)
        r /= r.sum(axis=1, keepdims=True)
        new = np.add.reduceat(r, first[:-1], axis=0) / sizes[:, None]
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, np.add.reduceat(np.log((weight * np.repeat(share, sizes, axis=0)).sum(axis=1)), first[:-1])


def mixtures(scores: np.ndarray, first: np.ndarray, steps: int = 16, penalty: float = 1.0, rate: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each language in each row of words, and whether it is of the chosen set.

    ``scores``: log likelihood of each word in each language; row r holds words first[r] to first[r + 1]. EM finds the
    shares; then languages are dropped, smallest share first, and the set with the best log likelihood less ``penalty``
    times half the logarithm of the number of words, and ``rate`` a word, for each language is kept. Where all languages together gain less
    over the best one than one penalty, no larger set can win and the search is left out.
    """
    rows, n_langs = len(first) - 1, scores.shape[1]
    shares, chosen = np.zeros((rows, n_langs)), np.zeros((rows, n_langs), bool)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return shares, chosen
    weight = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0))
    bounds = np.append(first[full], first[-1])  # rows without a word take no place
    sizes = np.diff(bounds)
    share, fit = _em(weight, bounds, np.full((len(full), n_langs), 1 / n_langs), steps)
    cost = penalty * 0.5 * np.log(np.maximum(sizes, 2)) + rate * sizes
    top = share.argmax(axis=1)
    alone = np.add.reduceat(np.log(weight[np.arange(len(weight)), np.repeat(top, sizes)]), bounds[:-1])
    mask = np.zeros_like(share, bool)
    mask[np.arange(len(full)), top] = True
    best, best_value, best_mask = mask.astype(float), alone - cost, mask
    open_ = np.flatnonzero(fit - alone > cost)
    if len(open_):
        words = np.flatnonzero(np.isin(np.repeat(np.arange(len(full)), sizes), open_))
        part, edge = weight[words], np.concatenate([[0], np.cumsum(sizes[open_])])
        order = np.argsort(share[open_], axis=1, kind="stable")
        now, allowed = share[open_] + 1e-9, np.ones((len(open_), n_langs), bool)
        for size in range(n_langs, 1, -1):
            now = np.where(allowed, now + 1e-9, 0)
            now, fit = _em(part, edge, now / now.sum(axis=1, keepdims=True), steps)
            value = fit - cost[open_] * size
            at = np.flatnonzero(value > best_value[open_])
            best[open_[at]], best_mask[open_[at]], best_value[open_[at]] = now[at], allowed[at], value[at]
            allowed = allowed.copy()
            allowed[np.arange(len(open_)), order[:, n_langs - size]] = False
    shares[full], chosen[full] = best, best_mask
    return shares, chosen


def _lettered(column: pa.Array) -> list[bool]:
    return [t is not None and any(m[0].isalpha() for m in _WORDLIKE.finditer(t)) for t in column.to_pylist()]


def _judge(column: pa.Array, model: Model) -> tuple[list[str], list[float], list[list[float]], list[list[str]]]:
    """Language, its share, all shares and the language set of each text."""
    names: list[str] = []
    score: list[float] = []
    shares_out: list[list[float]] = []
    sets: list[list[str]] = []
    texts = text_column(column)
    lettered = _lettered(column)
    for row, end, data, bounds in text_slices(texts, 1 << 18):
        starts, ends, first = word_bounds(data, bounds, spaces())
        if len(starts) and model.languages:
            shares, chosen = mixtures(_word_scores(data, starts, ends, model), first, rate=model.rate)
        else:
            shares = np.zeros((end - row, len(model.languages)))
            chosen = shares.astype(bool)
        for k in range(end - row):
            mine = shares[k]
            if not lettered[row + k] or not mine.any():
                names.append(UNDETERMINED)
                score.append(0.0)
            else:
                names.append(model.languages[int(mine.argmax())])
                score.append(float(min(1.0, mine.max())))
            shares_out.append(mine.tolist())
            sets.append([x for x, c in zip(model.languages, chosen[k]) if c])
    return names, score, shares_out, sets


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (share of that language), languages (the chosen set), shares (by model order).

    ``und`` with score 0 where the text is null or has no letter (or the model is empty). Whole texts are read; rows
    that repeat are judged each; other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, shares, sets = _judge(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def keep_identified(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is determined, with their own columns.

    With an empty model (no row with a language to learn from) nothing can be told apart: every text with a letter stays.
    """
    at = documents.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.languages:
                keep = [x != UNDETERMINED for x in _judge(batch.column(at), model)[0]]
            else:
                keep = _lettered(batch.column(at))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(kernel, documents.schema)
