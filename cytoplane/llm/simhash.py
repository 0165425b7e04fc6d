"""Near duplicates by 64-bit SimHash: Golay-code keys find all fingerprints within four bits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.shared import NO_ID, connected, stored

BITS = 4
#: A run of fingerprints with one key that is longer is split into blocks over several tasks.
MOST_IN_KEY = 20_000
#: Bit offsets and lengths of the three segments of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes, size: int = 4) -> bytes:
    """Eight bytes, highest bit first, of the UTF-8 text's shingles of ``size`` words; no word: zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return bytes(8)
    digest = partial(xxhash.xxh64_digest, seed=42)
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: n - 1]]).tolist()
    ends = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = b"".join([digest(joined[a:b]) for a, b in zip(begins[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def _fingerprints(size: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            values = np.frombuffer(b"".join([fingerprint(t, size) for t in texts]), ">i8").astype(np.int64)
            columns = [batch.column(0).cast(pa.int64()), pa.array(values), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *batch.schema.names[2:]])

    return kernel


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high and low half of a 23-bit word, coset leaders, and offsets of nearby codeword indices.

    The perfect (23, 12) code with generator x^11+x^10+x^6+x^5+x^4+x^2+1: each word has one codeword within three
    bits. A word exactly three bits away has five more at four bits, along the weight-7 codewords that hold its three.
    """
    from itertools import combinations

    generator = 0b110001110101

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= generator << (bit - 11)
        return x

    high = np.array([syndrome(x << 11) for x in range(1 << 12)], np.int64)
    low = np.arange(1 << 11)
    leader = np.zeros(2048, np.int64)
    blocks = [c for m in range(1 << 12) if (c := m << 11 | int(high[m])).bit_count() == 7]
    near = np.full((2048, 6), -1, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            x = sum(1 << b for b in bits)
            at = int(high[x >> 11] ^ low[x & 2047])
            leader[at], near[at, 0] = x, 0
            if weight == 3:
                near[at, 1:] = [c >> 11 for c in blocks if c & x == x]
    return high, low, leader, near


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp): for each two segments, each pair of nearby codeword indices."""
    high, low, leader, near = golay_tables()
    for batch in batches:
        every = np.asarray(batch.column(0)).astype(np.int64)
        for at in range(0, len(every), 4096):
            fps = every[at : at + 4096]
            index = []
            for begin, length in SEGMENTS:
                word = (fps.view(np.uint64) >> np.uint64(begin)).astype(np.int64) & ((1 << length) - 1)
                s = high[word >> 11] ^ low[word & 2047]
                index.append(np.where(near[s] < 0, -1, ((word ^ leader[s]) >> 11)[:, None] ^ near[s]))
            for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                left, right = index[i][:, :, None], index[j][:, None, :]
                row, a, b = np.nonzero((left >= 0) & (right >= 0))
                key = (kind << 24) | (index[i][row, a] << 12) | index[j][row, b]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])


def forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that keep the connected parts of distinct fingerprints under links of at most ``bits`` bits.

    Breadth first over what is not reached yet: a dense group is reached in few steps and leaves n - 1 edges.
    """
    rest, src, dst = fps.view(np.uint64), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(rest ^ x) <= bits
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                src.append(np.full(len(found), x))
                dst.append(found)
                queue.extend(found)
    if not src:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)


def _links(bits: int, most: int):
    """Over rows sorted by (key, fp): edges (a, b, null), or the rows (null, fp, key) of a run longer than ``most``."""

    def of(key: np.ndarray, fp: np.ndarray) -> list[tuple]:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        length = np.diff(cut)
        out = []
        small = np.repeat(length <= 16, length)
        for step in range(1, 16):  # short runs all at once: each row against the one so many rows on
            same = small[:-step] & (key[:-step] == key[step:])
            at = np.flatnonzero(same)
            if not len(at):
                break
            at = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= bits]
            out.append((fp[at], fp[at + step], None))
        for k in np.flatnonzero(length > 16):
            run = fp[cut[k] : cut[k + 1]]
            if len(run) <= most:
                out.append((*forest(run, bits), None))
            else:
                out.append((None, run, np.full(len(run), key[cut[k]])))
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        parts: list = []
        for batch in _with_end(batches):
            if batch is not None:
                parts.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
                if parts[-1][0][-1] == parts[0][0][0]:  # still inside one run
                    continue
            key = np.concatenate([none, *(p[0] for p in parts)])
            fp = np.concatenate([none, *(p[1] for p in parts)])
            end = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            parts = [] if batch is None else [(key[end:], fp[end:])]
            if end:
                for a, b, k in of(key[:end], fp[:end]):
                    if len(b):
                        empty = pa.nulls(len(b), pa.int64())
                        columns = [empty if a is None else pa.array(a), pa.array(b), empty if k is None else pa.array(k)]
                        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key"])

    return kernel


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def links(fingerprints: DataFrame, bits: int = BITS, most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (fp) with the connected parts of all links of at most four bits.

    With four errors over three segments, two segments hold two at most together. Words two bits apart share one of
    their nearby Golay codewords, so the two fingerprints share the key of those segments. Rows of a key are compared
    as a sorted stream. A key with more than ``most_in_key`` rows is dealt out as pairs of blocks, none is left out.
    """
    keys = fingerprints.select("fp").mapInArrow(_keys, "key long, fp long")
    found = stored(
        keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(bits, most_in_key), "a long, b long, key long")
    )
    edges = found.where("key is null").select("a", "b")
    hot = found.where("key is not null").select("key", F.col("b").alias("fp"))
    if hot.isEmpty():
        return edges
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(most_in_key)).alias("blocks"))
    placed = hot.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp"
    )
    rest = pairs.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(bits, 1 << 62), "a long, b long, key long")
    return edges.unionByName(rest.select("a", "b"))


def _groups(documents: DataFrame, id_col: str, text_col: str, size: int, most_in_key: int, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, with ``digests`` the digest of the text), and fingerprints (fp, part, component_id)."""
    text = F.col(text_col).cast("string")
    extra = [F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest")] if digests else []
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *extra)
    rows = stored(rows.mapInArrow(_fingerprints(size), "doc_id long, fp long" + ", digest binary" * digests))
    distinct = stored(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first")))
    parts = connected(links(distinct, BITS, most_in_key))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", F.coalesce("low", "fp").alias("part"))
    lowest = named.groupBy("part").agg(F.min("first").alias("lowest"))
    return rows, stored(named.join(lowest, "part").select("fp", "part", F.nullif("lowest", F.lit(NO_ID)).alias("component_id")))


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, most_in_key: int = MOST_IN_KEY
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of each row; component_id is the smallest id reachable over links.

    A null, empty or wordless text has fingerprint zero and links like any other. Rows with one id are separate rows
    with one name. A null id counts as larger than any other and stays null. Other columns are not read. An empty table
    gives an empty one.
    """
    rows, named = _groups(documents, id_col, text_col, size, most_in_key)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", "fp", fingerprint, "component_id")


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, most_in_key: int = MOST_IN_KEY) -> DataFrame:
    """One document of each group of near duplicates, with its own columns: the one with the smallest id.

    Among rows of a group that share this id the smallest digest of a text decides, and of rows equal in id and text one
    stays. So rows that share an id are told apart by their texts: a copy goes even if another row of its id stays. A
    null id is larger than any other: it stays where no document of its group has an id. A null text is an empty one. An
    empty table gives an empty one.
    """
    rows, named = _groups(documents, id_col, text_col, size, most_in_key, digests=True)
    name = F.coalesce("doc_id", F.lit(NO_ID)).alias("id")
    alike = rows.groupBy("fp", name, "digest").agg(F.count("*").alias("n"))
    first = alike.groupBy("fp").agg(F.min(F.struct("id", "digest", "n")).alias("first"))
    firsts = first.join(named, "fp").groupBy("part").agg(F.min("first").alias("first"))
    mark = uuid.uuid4().hex
    by_id, by_digest = f"_id_{mark}", f"_digest_{mark}"
    stay = stored(firsts.select(F.col("first.id").alias(by_id), F.col("first.digest").alias(by_digest), "first.n"))
    keyed = documents.withColumns(
        {by_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), by_digest: F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))}
    )
    kept = keyed.join(stay.drop("n").hint("merge"), [by_id, by_digest], "left_semi")
    if not stay.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([by_id, by_digest])
    return kept.drop(by_id, by_digest)
