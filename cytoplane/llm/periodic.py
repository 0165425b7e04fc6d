"""Periodic runs of words: maximal pairs of the LCP-interval tree of each text, at distances that make them runs.

A stretch with period q that is e or more periods long, and that no neighbour extends, is a pair of equal stretches at
distance q which differ in the words before and after them, and whose common length is at least (e - 1) q. So the maximal
pairs within that distance are the runs (and the same stretches at multiples of their period), and nothing is extended.

Suffixes are ranked by doubling over all texts of a slice at once; only those that share enough words with another of
their text at a near place enter the tree, which is walked from the leaves up over its LCP values.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.shared import spaces, text_column, text_slices, word_bounds

MIN_LENGTH, MIN_EXPONENT = 24, 3


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words of the bytes."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return np.asarray(words.dictionary_encode().indices).astype(np.int64)


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each sorted place the first place with its key."""
    order = np.argsort(keys, kind="stable")
    inner = keys[order]
    head = np.concatenate([[True], inner[1:] != inner[:-1]])
    return order, np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))


def _repeated(first_place: np.ndarray) -> np.ndarray:
    """Which sorted places share their class with another."""
    alone = np.diff(np.concatenate([np.flatnonzero(np.diff(first_place, prepend=-1)), [len(first_place)]])) == 1
    lone = np.zeros(len(first_place), bool)
    lone[np.unique(first_place)[alone]] = True
    return ~lone


def near_repeats(codes: np.ndarray, row: np.ndarray, least: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffix shares ``least`` words or more with another of its row that may be near enough, in suffix
    order, and the number of words that each shares with the one before it.

    Near enough: the next place with the same beginning is not farther than the longest shared stretch divided by
    ``reach``. The order of words is that of their codes; a row's end sorts first. Memory is four bytes a word for each
    doubling of the longest repeat.
    """
    none = np.zeros(0, np.int64)
    n = len(codes)
    if n < 2:
        return none, none
    row_end = np.searchsorted(row, np.arange(row[-1] + 1), "right")[row]
    order, place = _classes(row * (int(codes.max()) + 1) + codes)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = place
    levels = [rank.copy()]
    active = order[_repeated(place)]
    size, found, begins = 1, None, 1 << (least.bit_length() - 1)
    while True:
        if found is None and size == begins:
            found, early = active, levels[-1]
        if not len(active):
            break
        after = active + size
        second = np.where(after < row_end[active], rank[np.minimum(after, n)], -1).astype(np.int64)
        old = rank[active].astype(np.int64)
        order, place = _classes(old * (n + 1) + second + 1)
        active, old = active[order], old[order]
        old_head = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), np.arange(len(old)), 0))
        rank[active] = old + place - old_head
        active = active[_repeated(place)]
        size *= 2
        levels.append(rank.copy())
    if found is None or not len(found):
        return none, none
    found = found[np.argsort(rank[found], kind="stable")]
    left, right = found[:-1], found[1:]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        shared += np.where(level[np.minimum(left + shared, n)] == level[np.minimum(right + shared, n)], 1 << k, 0)
    most = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
    by = np.lexsort((found, early[found]))
    sorted_found, sorted_class = found[by], early[found[by]]
    gap = np.where(sorted_class[1:] == sorted_class[:-1], np.diff(sorted_found), n)
    nearest = np.empty(len(found), np.int64)
    nearest[by] = np.minimum(np.concatenate([[n], gap]), np.concatenate([gap, [n]]))
    stay = np.flatnonzero((nearest * reach <= most) & (most >= least))
    if len(stay) < 2:
        return none, none
    between = np.minimum.reduceat(np.concatenate([[0], shared]), stay[:-1] + 1)  # closed by the next start
    # The last stretch runs from the last but one kept place to the last: cut it there.
    between[-1] = shared[stay[-2] : stay[-1]].min()
    return found[stay], np.concatenate([[0], between])


def maximal_pairs(places: list[int], shared: list[int], left: dict[int, int], least: int, min_length: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, length) of the maximal pairs with length >= reach * distance and length + distance >= min_length.

    Intervals are closed from the deepest up. Each has the sorted places of its suffixes, told apart by the class of the
    word before them (``left``). Two places from different children differ in the word after their common stretch, so a
    pair is maximal if its classes differ too. Places within reach of one another are whole periods apart (reach is 2 or
    more), hence all but the first of them have one class: to the left of a place only the farthest within reach can
    differ from it, to its right all or none do. So each place of the smaller child costs two searches and the pairs it
    gives.
    """
    def met(many: list[int], few: list[int], depth: int):
        width = depth // reach
        for i in few:
            mine = left[i]
            at = bisect_left(many, i - width)
            if at < len(many) and (j := many[at]) < i:
                if left[j] != mine and depth + i - j >= min_length:
                    yield j, i - j, depth
                at = bisect_left(many, i, at)
            if at < len(many) and many[at] <= i + width and left[many[at]] != mine:
                while at < len(many) and (j := many[at]) <= i + width:
                    if depth + j - i >= min_length:
                        yield i, j - i, depth
                    at += 1

    def union(many: list[int], few: list[int]) -> list[int]:
        if 8 * len(few) < len(many):
            for i in few:
                insort(many, i)
        else:
            many += few
            many.sort()
        return many

    depths: list[int] = []
    lists: list[list[int]] = []
    last = [places[0]] if places else []
    for i, depth in zip([*places[1:], -1], [*shared[1:], 0] if places else []):
        while depths and depths[-1] >= depth:
            closing, other = depths[-1], lists.pop()
            many, few = (other, last) if len(other) >= len(last) else (last, other)
            yield from met(many, few, closing)
            last = union(many, few)
            depths.pop()
            if closing == depth:
                break
        if depth >= least:
            depths.append(depth)
            lists.append(last)
        last = [i]


def runs_of(codes: np.ndarray, row: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs, sorted; places count over all rows."""
    reach = min_exponent - 1
    least = min(max(min_length - q, reach * q) for q in range(1, max(min_length, 1) + 1))
    places, shared = near_repeats(codes, row, least, reach)
    if not len(places):
        return []
    before = np.where((places > 0) & (row[places] == row[places - 1]), codes[places - 1], -1)
    left = dict(zip(places.tolist(), before.tolist()))
    found: dict[tuple[int, int], int] = {}
    for start, distance, length in maximal_pairs(places.tolist(), shared.tolist(), left, least, min_length, reach):
        at = (start, length + distance)
        found[at] = min(distance, found.get(at, distance))
    return sorted((start, length, period) for (start, length), period in found.items())


_RESULT = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, n_dropped long, collapsed string, collapsed_sha256 string"
)


def _kernel(min_length: int, min_exponent: int, texts: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids = batch.column(0)
            for begin, end, data, bounds in text_slices(text_column(batch.column(1))):
                starts, ends, first = word_bounds(data, bounds, spaces())
                row = np.repeat(np.arange(end - begin), np.diff(first))
                runs: list[list] = [[] for _ in range(end - begin)]
                if len(starts):
                    for start, length, period in runs_of(word_codes(data, starts, ends), row, min_length, min_exponent):
                        k = int(row[start])
                        runs[k].append({"start": start - int(first[k]), "length": length, "period": period})
                raw, gone, kept, sums = data.tobytes(), [], [], []
                for k, own in enumerate(runs):
                    words = raw[bounds[k] : bounds[k + 1]].split()
                    stay = words
                    if own:
                        mark = np.zeros(len(words) + 1, np.int64)
                        for r in own:
                            mark[r["start"] + r["period"]] += 1
                            mark[r["start"] + r["length"]] -= 1
                        stay = [words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                    joined = b" ".join(stay)
                    gone.append(len(words) - len(stay))
                    kept.append(joined.decode() if texts else None)
                    sums.append(hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin), pa.array(np.diff(first), pa.int64()), pa.array(runs, run_type), pa.array(gone, pa.int64()),
                        pa.array(kept, pa.string()), pa.array(sums, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "n_dropped", "collapsed", "collapsed_sha256"],
                )

    return kernel


def periodic_runs(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, texts: bool = True
) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; sorted), n_dropped, collapsed (null without ``texts``),
    collapsed_sha256.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch with smallest period q of at least ``min_length`` words and
    ``min_exponent`` (3 or more) periods that no neighbouring word extends. ``collapsed`` has the words outside runs and
    the first period of each, joined by one space; a word goes if any run has it after its first period. A null or empty
    text has no words and no run. Rows are judged alone, so repeated and null ids stay as they are. Texts are read whole,
    other columns are not read, nothing is shuffled, an empty table gives an empty one.
    """
    if min_exponent < 3 or min_length < 1:
        raise ValueError("runs are found from three periods on")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_kernel(min_length, min_exponent, texts), _RESULT)
