"""Exact repeats of word windows over the corpus: suffix automata of reference shards, streamed for matching statistics.

Broadcasting each shard of references to every document would cost the square of the corpus. Here a window of 13 words is
filed under its minimizer (the smallest hash of the five-word sequences in it), so equal windows meet in one shard and a
shard's automaton meets only documents that can match it. Minimizers of one document only are dropped before any text
moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.shared import NO_ID, WordHasher, mixed, spaces, stored, text_column, text_slices, word_bounds

WINDOW, GRAM = 13, 5
#: Minimizers a task gathers before it drops those it has seen in several documents.
MOST_GATHERED = 1 << 21
#: A minimizer of more documents than this is filed window by window, so that its windows go to many tasks.
MOST_IN_MINIMIZER = 10_000


def runs(data: np.ndarray, bounds: np.ndarray, hasher: WordHasher, window: int, gram: int):
    """Words, and runs of windows with one minimizer: first window, end window (both as words) and minimizer hash."""
    starts, ends, first = word_bounds(data, bounds, spaces())
    none = np.zeros(0, np.int64)
    n = len(starts) - window + 1
    if n < 1:
        return starts, ends, first, none, none, none
    words = hasher(data, starts, ends)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - gram + 1 + k]
    grams = mixed(grams)
    best, at = grams[:n].copy(), np.arange(n)
    for k in range(1, window - gram + 1):
        other = grams[k : n + k]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = np.flatnonzero(row[:n] == row[window - 1 :])  # inside one document
    if not len(windows):
        return starts, ends, first, none, none, none
    place = at[windows]
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    begin = windows[cut]
    end = windows[np.append(cut[1:], len(windows)) - 1] + 1
    return starts, ends, first, begin, end, best[begin].view(np.int64)


def _minimizers(window: int, gram: int, most: int):
    """Rows (h, id, kind): kind 0, one document of this task has h; 1, several; 2, this document shares h with another."""

    def settled(h: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
        h, ids = h[fresh], ids[fresh]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(cut, len(h)))
        several = np.repeat(size > 1, size)
        kind = np.concatenate([(size > 1).astype(np.int8), np.full(several.sum(), 2, np.int8)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([h[cut], h[several]])), pa.array(np.concatenate([ids[cut], ids[several]])), pa.array(kind)], ["h", "id", "kind"]
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, size = WordHasher(), [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, _, data, bounds in text_slices(text_column(batch.column(1))):
                _, _, first, begin, _, h = runs(data, bounds, hasher, window, gram)
                if len(h):
                    parts.append((h, ids[row + np.searchsorted(first, begin, "right") - 1]))
                    size += len(h)
                if size > most:
                    yield settled(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
                    parts, size = [], 0
        if parts:
            yield settled(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))

    return kernel


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by h: (id, h) of every document whose minimizer another document has too."""
    h, ids, kind = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)

    def of(h: np.ndarray, ids: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        known = kind == 2
        out_h, out_ids = [h[known]], [ids[known]]
        h, ids, kind = h[~known], ids[~known], kind[~known]
        if len(h):
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(cut, len(h)))
            shared = np.repeat((np.maximum.reduceat(ids, cut) != np.minimum.reduceat(ids, cut)) | (np.maximum.reduceat(kind, cut) > 0), size)
            out_h.append(h[shared & (kind == 0)])
            out_ids.append(ids[shared & (kind == 0)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_h))], ["id", "h"])

    for batch in batches:
        if batch.num_rows:
            h, ids, kind = (np.concatenate([a, np.asarray(b)]) for a, b in zip((h, ids, kind), batch.columns))
            end = int(np.searchsorted(h, h[-1]))  # the last run may go on
            if end:
                yield of(h[:end], ids[:end], kind[:end])
                h, ids, kind = h[end:], ids[end:], kind[end:]
    if len(h):
        yield of(h, ids, kind)


def digest(words: bytes) -> bytes:
    return hashlib.md5(words, usedforsecurity=False).digest()


def _unpacked(batch: pa.RecordBatch, column: int) -> pa.Array:
    import zstandard as z

    tool = z.ZstdDecompressor()
    return pa.array([tool.decompress(x) if x else b"" for x in batch.column(column).to_pylist()], pa.large_binary()).cast(pa.large_string())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are shuffled."""
    import zstandard as z

    tool = z.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.compress(t) if t else b"" for t in texts], pa.binary())], ["id", "z"])


def _segments(window: int, gram: int):
    """(key, h, segment, id) for the runs of windows under the shared minimizers of each document, equal ones once.

    The key is the minimizer; under a frequent one each window is a segment of its own with a key of its own.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, shared, frequent = batch.column(0), batch.column(2), batch.column(3)
            for row, end, data, bounds in text_slices(_unpacked(batch, 1)):
                starts, ends, first, begin, stop, h = runs(data, bounds, hasher, window, gram)
                raw, owner = data.tobytes(), np.searchsorted(first, begin, "right") - 1
                edges = np.searchsorted(owner, np.arange(end - row + 1))
                out_key, out_h, out_seg, out_id = [], [], [], []
                for k in range(end - row):
                    part = slice(edges[k], edges[k + 1])
                    found = np.flatnonzero(np.isin(h[part], shared[row + k].values.to_numpy())) + edges[k]
                    often = set(frequent[row + k].as_py() or ())
                    seen = {}
                    for x, a, b in zip(h[found].tolist(), begin[found].tolist(), stop[found].tolist()):
                        for c, d in [(a, b)] if x not in often else [(c, c + 1) for c in range(a, b)]:
                            seen[x, b" ".join(raw[starts[c] : ends[d + window - 2]].split())] = None
                    out_h += [x for x, _ in seen]
                    out_seg += [t for _, t in seen]
                    out_key += [x if x not in often else int.from_bytes(digest(t)[:8], "little", signed=True) for x, t in seen]
                    out_id += [ids[row + k].as_py()] * len(seen)
                columns = [pa.array(out_key, pa.int64()), pa.array(out_h, pa.int64()), pa.array(out_seg, pa.binary()), pa.array(out_id, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "h", "segment", "id"])

    return kernel


class Automaton:
    """Suffix automaton of word sequences; each state knows the smallest id it was first reached with."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.id = [0]

    def add(self, words: list, doc: int) -> None:
        """Adds one sequence; ids must come in ascending order."""
        last = 0
        for w in words:
            last = self._extend(last, w, doc)

    def _state(self, length: int, step: dict, link: int, doc: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.id.append(doc)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w) -> int:
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q], self.id[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w, doc: int) -> int:
        q = self.step[last].get(w)
        if q is not None:  # the longer sequence is known from an earlier one
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        now = self._state(self.length[last] + 1, {}, 0, doc)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = now
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[now] = q if self.length[p] + 1 == self.length[q] else self._split(p, q, w)
        return now

    def statistics(self, words: list, window: int) -> list[tuple[int, int]]:
        """At each word: length of the longest match that ends there, and the id its last ``window`` words were first
        seen with (-1 if shorter)."""
        state, length, out = 0, 0, []
        for w in words:
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.step[state].get(w, 0)
            length = length + 1 if state else 0
            at = state
            if length >= window:
                while self.length[self.link[at]] >= window:
                    at = self.link[at]
            out.append((length, self.id[at] if length >= window else -1))
        return out


def _match(window: int):
    """Over rows (key, h, segment, id) sorted by key and id: for each segment the first id of each of its windows."""

    def of(rows: list[tuple[int, bytes, int]]) -> Iterator[tuple[int, bytes, bytes, int]]:
        if len(rows) == 1:
            h, segment, doc = rows[0]
            yield h, segment, np.full(segment.count(b" ") + 2 - window, doc, "<i8").tobytes(), doc
            return
        automaton = Automaton()
        split = [s.split(b" ") for _, s, _ in rows]
        for words, (_, _, doc) in zip(split, rows):
            automaton.add(words, doc)
        for words, (h, segment, _) in zip(split, rows):
            first = [doc for _, doc in automaton.statistics(words, window)[window - 1 :]]
            yield h, segment, np.array(first, "<i8").tobytes(), min(first)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns = [
                pa.array([r[0] for r in out], pa.int64()), pa.array([digest(r[1]) for r in out], pa.binary()),
                pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.int64()),
            ]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["h", "segment", "first_ids", "first"])

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now and rows:
                    out += of(rows)
                    rows = []
                now = key
                rows.append(row)
            if out:
                yield flush()
        if rows:
            out += of(rows)
            yield flush()

    return kernel


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, removed array<struct<start:long,end:long>>"


def _cut(window: int, gram: int, texts: bool):
    """Removes the covered words of each document; rows (id, z, matches)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            matches = batch.column(2)
            n_words, n_removed, sums, kept_texts, spans = [], [], [], [], []
            for row, end, data, bounds in text_slices(_unpacked(batch, 1)):
                raw = data.tobytes()
                hit = [matches[k].as_py() for k in range(row, end)]
                if any(hit):
                    starts, ends, first, begin, stop, h = runs(data, bounds, hasher, window, gram)
                    edges = np.searchsorted(np.searchsorted(first, begin, "right") - 1, np.arange(end - row + 1))
                for k in range(end - row):
                    words = raw[bounds[k] : bounds[k + 1]].split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if hit[k]:
                        known = {(m["h"], m["segment"]): np.frombuffer(m["first_ids"], "<i8") for m in hit[k]}
                        heads = {x for x, _ in known}
                        for j in range(edges[k], edges[k + 1]):
                            if int(h[j]) in heads:
                                a, b = int(begin[j] - first[k]), int(stop[j] - first[k])
                                found = known.get((int(h[j]), digest(b" ".join(words[a : b + window - 1]))))
                                if found is None:  # filed window by window, or first here
                                    single = (known.get((int(h[j]), digest(b" ".join(words[c : c + window])))) for c in range(a, b))
                                    found = np.array([NO_ID if x is None else x[0] for x in single])
                                at = a + np.flatnonzero(found < ids[row + k])
                                if len(at):
                                    np.add.at(gone, at, 1)
                                    np.add.at(gone, at + window, -1)
                    covered = np.cumsum(gone)[:-1] > 0
                    kept = words if not covered.any() else [w for w, c in zip(words, covered.tolist()) if not c]
                    joined = b" ".join(kept)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(kept))
                    sums.append(hashlib.sha256(joined).hexdigest())
                    kept_texts.append(joined.decode() if texts else None)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if x == NO_ID else x for x in ids], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(sums, pa.string()), pa.array(kept_texts, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                [x.split()[0] for x in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed")],
            )

    return kernel


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = True, most_gathered: int = MOST_GATHERED, most_in_minimizer: int = MOST_IN_MINIMIZER
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (words joined by one space; null without ``texts``), removed
    (word spans).

    A word goes if a window of ``window`` words over it also starts in a row with a smaller id. A null or empty text has
    no word. A null id counts as larger than any other and stays null; rows with one id are not each other's repeats.
    Windows that repeat inside one document only stay. Texts are read whole, other columns are not read, an empty table
    gives an empty one.
    """
    rows = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_minimizers(window, gram, most_gathered), "h long, id long, kind byte")
    dealt = found.repartition(F.when(F.col("kind") == 2, F.xxhash64("h", "id")).otherwise(F.col("h"))).sortWithinPartitions("h", "id")
    shared = stored(dealt.select("h", "id", "kind").mapInArrow(_shared, "id long, h long"))
    packed = rows.mapInArrow(_packed, "id long, z binary")
    often = stored(shared.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most_in_minimizer).select("h"))
    marked = shared.withColumn("often", F.lit(None).cast("long"))
    if not often.isEmpty():
        marked = shared.join(often.select("h", F.col("h").alias("often")), "h", "left")
    wanted = marked.groupBy("id").agg(F.collect_set("h").alias("shared"), F.collect_set("often").alias("frequent"))
    segments = stored(
        packed.join(wanted, "id").select("id", "z", "shared", "frequent").mapInArrow(_segments(window, gram), "key long, h long, segment binary, id long")
    )
    references = segments.groupBy("key", "h", "segment").agg(F.min("id").alias("id"))
    filed = references.repartition("key").sortWithinPartitions("key", "id")
    matched = stored(filed.mapInArrow(_match(window), "h long, segment binary, first_ids binary, first long"))
    mine = segments.select("id", "h", F.unhex(F.md5("segment")).alias("segment")).join(matched, ["h", "segment"]).where("first < id")
    removals = stored(mine.groupBy("id").agg(F.collect_set(F.struct("h", "segment", "first_ids")).alias("matches")))
    return packed.join(removals, "id", "left").select("id", "z", "matches").mapInArrow(_cut(window, gram, texts), _RESULT)
