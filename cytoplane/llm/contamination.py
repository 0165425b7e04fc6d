"""Benchmark decontamination: suffix arrays of training text, searched with every test suffix."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.shared import NO_ID, WordHasher, stored, text_column, text_slices, word_bounds

WINDOW = 13
#: Test text sent to the executors at once; a larger benchmark is searched in several blocks of items.
MOST_TEST_BYTES = 16 << 20


def letters() -> np.ndarray:
    """Byte table of words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    letter = np.zeros(256, bool)
    letter[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return letter


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)


@dataclass
class Tests:
    """Word ids (1.. in the order of ``vocabulary``) of a block of items; windows and suffixes are places in ``flat``."""

    vocabulary: np.ndarray
    spelling: bytes  # of the vocabulary, one word after another
    spelling_ends: np.ndarray
    flat: np.ndarray  # ids of all items' words
    bounds: np.ndarray  # of the items in flat
    item_ids: np.ndarray
    windows: np.ndarray  # one place of each distinct window
    lengths: np.ndarray
    owners: np.ndarray  # items of each window, one window after another
    owner_bounds: np.ndarray
    shortest: int
    widest: int

    def word(self, i: int) -> bytes:
        return self.spelling[self.spelling_ends[i - 2] if i > 1 else 0 : self.spelling_ends[i - 1]]

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of every word and the words from there to the end of its item."""
        at = np.arange(len(self.flat))
        return at, np.repeat(self.bounds[1:], np.diff(self.bounds)) - at


def hashed(hasher: WordHasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Word hashes, formed over runs of words of about ``most`` bytes."""
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, "right")))
        out.append(hasher(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]))
        a = b
    return np.concatenate(out)


def classes(flat: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers where the next ``window`` words, or those up to the item's end (``ends``), are equal."""
    rank, step, at = flat.astype(np.int64), 1, np.arange(len(flat))
    out, covered = np.zeros(len(flat), np.int64), 0

    def pair(a: np.ndarray, b: np.ndarray, ahead: int) -> np.ndarray:
        there = at + ahead
        follows = np.where(there < ends, b[np.minimum(there, len(b) - 1)], 0)
        return np.unique(a * (int(b.max()) + 1) + follows, return_inverse=True)[1].astype(np.int64) + 1

    while True:
        if window & step:
            out = pair(out, rank, covered) if covered else rank
            covered += step
        if 2 * step > window:
            return out
        rank, step = pair(rank, rank, step), 2 * step


def tests(items: list[tuple[int, str | None]], window: int = WINDOW) -> Tests | None:
    """None if no item has a word. Memory grows with the words of the items, whatever their lengths."""
    hasher, letter = WordHasher(), letters()
    ids, sizes, hashes, spelled, word_sizes = [], [], [], [], []
    for item, text in items:
        data = lowered(np.frombuffer((text or "").encode(), np.uint8))
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), letter)
        if len(starts):
            ids.append(item)
            sizes.append(len(starts))
            hashes.append(hashed(hasher, data, starts, ends))
            spelled.append(data[np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts) + np.arange((ends - starts).sum())])
            word_sizes.append(ends - starts)
    if not ids:
        return None
    vocabulary, first, flat = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    flat = (flat + 1).astype(np.int32)
    raw, length = np.concatenate(spelled), np.concatenate(word_sizes)
    begin = (np.cumsum(length) - length)[first]
    length = length[first]
    spelling_ends = np.cumsum(length)
    spelling = raw[np.repeat(begin - spelling_ends + length, length) + np.arange(length.sum())].tobytes()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = np.repeat(np.arange(len(ids)), sizes)
    left = bounds[1:][own] - np.arange(len(flat))
    full = np.minimum(window, np.diff(bounds))[own]
    places = np.flatnonzero(left >= full)
    _, first, which = np.unique(classes(flat, bounds[1:][own], window)[places], return_index=True, return_inverse=True)
    item_ids = np.array(ids, np.int64)
    names, named = np.unique(item_ids, return_inverse=True)
    pairs = np.unique(which.astype(np.int64) * len(names) + named[own[places]])
    windows = places[first]
    return Tests(
        vocabulary, spelling, spelling_ends, flat, bounds, item_ids, windows, full[windows], names[pairs % len(names)],
        np.searchsorted(pairs // len(names), np.arange(len(windows) + 1)), int(full.min()), int(full.max()),
    )


def suffix_array(sequence: np.ndarray, longest: int) -> np.ndarray:
    """Positions of the non-zero entries ordered by the words that follow, as far as ``longest`` words (doubling)."""
    rank, step = sequence.astype(np.int64), 1
    while step < longest:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] if step < len(rank) else 0
        _, following = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)
        following[sequence == 0] = 0
        if following.max(initial=0) == rank.max(initial=0) and (following == rank).all():
            break
        rank, step = following, 2 * step
    order = np.argsort(rank, kind="stable")
    return order[sequence[order] > 0]


def _common(sequence: np.ndarray, at: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int = 16) -> np.ndarray:
    """How many words from ``at`` in ``sequence`` (a zero at its end) are those from ``starts`` in ``flat``, at most ``lengths``."""
    if len(at) > (most := 1 << 16):
        parts = (slice(k, k + most) for k in range(0, len(at), most))
        return np.concatenate([_common(sequence, at[p], flat, starts[p], lengths[p], width) for p in parts])
    common = np.zeros(len(at), np.int64)
    open_, steps = np.arange(len(at)), np.arange(width)
    while len(open_):
        done = common[open_]
        here = sequence[np.minimum((at[open_] + done)[:, None] + steps, len(sequence) - 1)]
        there = flat[np.minimum((starts[open_] + done)[:, None] + steps, len(flat) - 1)]
        same = (here == there) & (steps < (lengths[open_] - done)[:, None])
        n = np.where(same.all(axis=1), width, same.argmin(axis=1))
        common[open_] += n
        open_ = open_[n == width]
    return common


def _place(sequence: np.ndarray, order: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: bool, most: int = 1 << 16) -> np.ndarray:
    """For each stretch of ``flat`` the first place in ``order`` not below it; with ``after``, above all that begin
    with it. ``most`` stretches are searched at once."""
    out, firsts = [], sequence[order]
    for k in range(0, len(starts), most):
        begin, size = starts[k : k + most], lengths[k : k + most]
        low, high = (np.searchsorted(firsts, flat[begin], side) for side in ("left", "right"))
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            at, b, n = order[middle], begin[open_], size[open_]
            common = _common(sequence, at, flat, b, n)
            whole = common == n
            less = ~whole & (sequence[at + common] < flat[np.minimum(b + common, len(flat) - 1)]) | whole & after
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        out.append(low)
    return np.concatenate([*out, np.zeros(0, np.int64)])


class Shard:
    """The training side of one batch: runs of test-vocabulary words, ordered as a suffix array.

    A word outside the test vocabulary ends every match, so only runs as long as the shortest window are indexed.
    """

    def __init__(self, column: pa.Array, t: Tests, hasher: WordHasher, longest: int | None = None) -> None:
        """Ordered by ``longest`` words, as far as the widest window if not given."""
        parts, rows, places, counts = [], [], [], []
        self.raw: dict[int, tuple[bytes, np.ndarray, np.ndarray]] = {}
        letter = letters()
        for begin, end, data, bounds in text_slices(text_column(column)):
            data = lowered(data)
            starts, ends, first = word_bounds(data, bounds, letter)
            counts.append(np.diff(first))
            if not len(starts):
                continue
            hashes = hashed(hasher, data, starts, ends)
            at = np.minimum(np.searchsorted(t.vocabulary, hashes), len(t.vocabulary) - 1)
            ids = np.where(t.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
            edge = np.zeros(len(ids) + 1, bool)
            edge[first] = True
            known = ids > 0
            head = known & (edge[:-1] | ~np.concatenate([[False], known[:-1]]))
            tail = known & (edge[1:] | ~np.concatenate([known[1:], [False]]))
            head, tail = np.flatnonzero(head), np.flatnonzero(tail) + 1
            long = tail - head >= t.shortest
            for a, b in zip(head[long], tail[long]):
                row = int(np.searchsorted(first, a, "right")) - 1
                self.raw.setdefault(begin + row, (data[bounds[row] : bounds[row + 1]].tobytes(), starts[first[row] : first[row + 1]] - bounds[row], ends[first[row] : first[row + 1]] - bounds[row]))
                parts += [ids[a:b], np.zeros(1, np.int32)]
                rows += [np.full(b - a + 1, begin + row)]
                places += [np.arange(a, b + 1) - first[row]]
        pad = [np.zeros(1, np.int32)]
        self.counts = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.sequence = np.concatenate(parts + pad)
        self.row = np.concatenate([*rows, np.zeros(0, np.int64)])
        self.place = np.concatenate([*places, np.zeros(0, np.int64)])
        self.order = suffix_array(self.sequence, longest or t.widest)
        self.tests = t

    def same(self, row: int, place: int, ids: np.ndarray) -> bool:
        """Whether the words are those of the ids, by their bytes."""
        text, starts, ends = self.raw[row]
        return all(text[starts[place + k] : ends[place + k]] == self.tests.word(int(i)) for k, i in enumerate(ids))

    def occurrences(self) -> Iterator[tuple[int, int, int]]:
        """(row, first word, window) of every verbatim occurrence of a window."""
        t = self.tests
        if not len(self.order):
            return
        low = _place(self.sequence, self.order, t.flat, t.windows, t.lengths, False)
        first = self.order[np.minimum(low, len(self.order) - 1)]
        hit = np.flatnonzero(self.sequence[first] == t.flat[t.windows])
        hit = hit[_common(self.sequence, first[hit], t.flat, t.windows[hit], t.lengths[hit]) == t.lengths[hit]]
        high = low.copy()
        high[hit] = _place(self.sequence, self.order, t.flat, t.windows[hit], t.lengths[hit], True)
        for w in hit:
            ids = t.flat[t.windows[w] : t.windows[w] + t.lengths[w]]
            for at in self.order[low[w] : high[w]]:
                row, place = int(self.row[at]), int(self.place[at])
                if self.same(row, place, ids):
                    yield row, place, int(w)

    def longest(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, its word, row, its word, words) of each test suffix's longest match in this shard, if one window long."""
        t = self.tests
        if not len(self.order):
            return
        starts, lengths = t.suffixes()
        at = _place(self.sequence, self.order, t.flat, starts, lengths, False)
        best = np.zeros(len(at), np.int64)
        where = np.zeros(len(at), np.int64)
        for near in (at - 1, at):
            ok = (near >= 0) & (near < len(self.order))
            here = self.order[np.clip(near, 0, len(self.order) - 1)]
            common = np.where(ok, _common(self.sequence, here, t.flat, starts, lengths), 0)
            best, where = np.maximum(best, common), np.where(common > best, here, where)
        own = np.searchsorted(t.bounds, starts, "right") - 1
        for k in np.flatnonzero(best >= t.shortest):
            row, place = int(self.row[where[k]]), int(self.place[where[k]])
            if self.same(row, place, t.flat[k : k + best[k]]):
                yield int(t.item_ids[own[k]]), int(k - t.bounds[own[k]]), row, place, int(best[k])


def pieces(text: str, window: int, most: int) -> Iterator[str]:
    """Stretches of about ``most`` bytes that overlap by a window less a word: together they hold every window once."""
    raw = text.encode()
    if len(raw) <= most:
        yield text
        return
    starts, ends, _ = word_bounds(lowered(np.frombuffer(raw, np.uint8)), np.array([0, len(raw)]), letters())
    a = 0
    while a < len(starts):
        b = min(len(starts), max(a + 2 * window, int(np.searchsorted(ends, starts[a] + most, "right"))))
        yield raw[starts[a] : ends[b - 1]].decode()
        a = len(starts) if b == len(starts) else b - window + 1


class Blocks:
    """The test items in blocks of about ``most`` bytes, one at a time: each is built when it is asked for and not kept.

    With ``cut`` an item longer than a quarter of the bound is dealt out in overlapping pieces; else it stays whole and
    may fill a block by itself.
    """

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int, cut: bool = True) -> None:
        self.window, self.most = window, most
        item = F.coalesce(F.col(item_col).cast("long"), F.lit(NO_ID))
        rows = benchmark.select(item.alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = -(-size // most) if size else 1
        if self.n > 1:

            def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        for p in pieces(text, window, most // 4):
                            yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), pa.array([p], pa.string())], ["item_id", "text"])

            rows = rows.distinct()  # copies of an item say nothing new
            rows = stored(rows.mapInArrow(kernel, "item_id long, text string") if cut else rows)
        self.rows = rows

    def __iter__(self) -> Iterator[Tests]:
        for k in range(self.n):
            part = self.rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k) if self.n > 1 else self.rows
            items, size = [], 0
            for r in part.toLocalIterator():
                more = len(r.text.encode())
                if items and size + more > self.most:
                    if t := tests(items, self.window):
                        yield t
                    del t
                    items, size = [], 0
                items.append((r.item_id, r.text))
                size += more
            if t := tests(items, self.window):
                yield t
            del t


_FOUND = "n_words long, n_hit long, n_items long, item_ids array<long>, spans array<struct<start:long,end:long>>"


def _found(column: pa.Array, t: Tests | None, hasher: WordHasher) -> list[pa.Array]:
    if t is None:
        t = tests([(0, "a")])  # counts the words only
        shard, found = Shard(column, t, hasher), []
    else:
        shard = Shard(column, t, hasher)
        found = shard.occurrences()
    items: dict[int, set[int]] = defaultdict(set)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for row, place, w in found:
        items[row].update(t.owners[t.owner_bounds[w] : t.owner_bounds[w + 1]].tolist())
        hits[row].append((place, place + int(t.lengths[w])))
    spans: list[list[dict]] = []
    for row in range(len(column)):
        merged: list[list[int]] = []
        for a, b in sorted(hits.get(row, ())):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        spans.append([{"start": a, "end": b} for a, b in merged])
    return [
        pa.array(shard.counts, pa.int64()),
        pa.array([sum(s["end"] - s["start"] for s in x) for x in spans], pa.int64()),
        pa.array([len(items.get(r, ())) for r in range(len(column))], pa.int64()),
        pa.array([sorted(items.get(r, ())) for r in range(len(column))], pa.list_(pa.int64())),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def _scan(rows: DataFrame, t: Tests | None) -> DataFrame:
    """doc_id, text_hash and the findings of one block in each of ``rows`` (doc_id, text, text_hash)."""
    names = ["doc_id", "text_hash", *(x.split()[0] for x in _FOUND.split(", "))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *_found(batch.column(1), t, hasher)], names)

    return rows.select("doc_id", "text", "text_hash").mapInArrow(kernel, f"doc_id long, text_hash long, {_FOUND}")


_MERGED = """
    aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.start <= element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
                  'end', greatest(x.end, element_at(acc, -1).end)))),
           concat(acc, array(x))))"""


def _in_blocks(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, item_ids, spans) of the rows with a hit, once for equal rows.

    One scan a block; its findings are written before the next block is built.
    """
    every = None
    for t in blocks:
        part = stored(_scan(rows, t).where("n_hit > 0").drop("n_hit", "n_items"))
        every = part if every is None else every.unionByName(part)
        del t
    if every is None:
        return _scan(rows, None).where("n_hit > 0")
    joint = every.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )
    return joint.withColumn("spans", F.expr(_MERGED)).withColumns({
        "n_hit": F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)"),
        "n_items": F.size("item_ids").cast("long"),
    })


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    most_test_bytes: int = MOST_TEST_BYTES,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, item_ids (sorted), spans of hit words, contaminated.

    A null text has no words. Items with a null text or no word match nothing; items with one id are one item. Words in
    items without an id are hit too, but such items are not among ``item_ids`` nor counted. An empty benchmark leaves
    every document clean. Rows with one id are judged each by itself (with several blocks of items they are told apart by
    their text, rows equal in both are given back once for each). Texts of any
    length are read whole; other columns are not read. A benchmark above ``most_test_bytes`` is searched block by block,
    one scan each when the plan is built.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = Blocks(benchmark, item_col, item_text_col, window, most_test_bytes)
    if blocks.n == 1:
        found = _scan(rows.withColumn("text_hash", F.lit(0).cast("long")), next(iter(blocks), None))
    else:
        rows = rows.withColumn("text_hash", F.xxhash64("text"))
        hits = _in_blocks(rows, blocks).select(
            F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "n_items", "item_ids", "spans"
        )
        counted = _scan(rows, None).select("doc_id", "text_hash", "n_words")
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
        found = counted.join(hits, same, "left").withColumns({
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "n_items": F.coalesce("n_items", F.lit(0).cast("long")),
            "item_ids": F.coalesce("item_ids", F.expr("cast(array() as array<bigint>)")),
            "spans": F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")),
        })
    named = found.withColumn("item_ids", F.array_remove("item_ids", F.lit(NO_ID).cast("long"))).withColumn("n_items", F.size("item_ids").cast("long"))
    return named.select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans", is_contaminated().alias("contaminated"))


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_test_bytes: int = MOST_TEST_BYTES) -> DataFrame:
    """(item_id, item_word, words, doc_id, doc_word): each test suffix's longest verbatim match over all shards.

    Suffixes that match less than the shortest window are left out; the smallest (doc_id, doc_word) of a shard's
    neighbours stands for equal lengths. Items without an id or a text are left out.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "item_id long, item_word long, doc_id long, doc_word long, words long"
    out = None
    blocks = Blocks(benchmark.where("item_id is not null"), "item_id", "text", window, most_test_bytes, cut=False)
    for t in blocks:

        def kernel(batches: Iterator[pa.RecordBatch], t: Tests = t) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher()
            for batch in batches:
                found = [*Shard(batch.column(1), t, hasher, int(np.diff(t.bounds).max())).longest()]
                ids = batch.column(0).to_pylist()
                rows = [(a, b, ids[r], p, n) for a, b, r, p, n in found]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)

        found = rows.mapInArrow(kernel, schema)
        found = stored(found) if blocks.n > 1 else found
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("words", (-F.col("doc_id")).alias("d"), (-F.col("doc_word")).alias("w"))).alias("best")
    return out.groupBy("item_id", "item_word").agg(best).selectExpr(
        "item_id", "item_word", "best.words", "-best.d as doc_id", "-best.w as doc_word"
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_test_bytes: int = MOST_TEST_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their own columns; null and empty texts stay."""
    blocks = Blocks(benchmark, "item_id", "text", window, most_test_bytes)
    if blocks.n > 1:
        rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        hits = _in_blocks(rows.withColumn("text_hash", F.xxhash64("text")), blocks).where(is_contaminated())
        gone = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"))
        same = documents[id_col].cast("long").eqNullSafe(gone["hit_id"]) & (F.xxhash64(documents[text_col]) == gone["hit_hash"])
        return documents.join(gone, same, "left_anti")
    t = next(iter(blocks), None)
    if t is None:
        return documents
    at = documents.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            words, hit = (np.asarray(x) for x in _found(batch.column(at), t, hasher)[:2])
            yield batch.filter(pa.array(~((hit > 0) & (20 * hit >= words))))

    return documents.mapInArrow(kernel, documents.schema)
