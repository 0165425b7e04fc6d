"""Best-fit packing of token sequences: exact complements by length sums, then best fit for what is left."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.llm.shared import stored

SIZE = 2048
#: Rows of one length that are numbered in one group; a more frequent length is dealt over more groups.
MOST_IN_GROUP = 50_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """Text -> token ids of the ``tokenizers`` file at ``path``, without special tokens added.

    Where the same vocabulary lies beside it as ranks, ordinary text takes the faster reader of those: same ids. Texts
    that spell a special token, or hold a word of thousands of letters, go through the file itself.
    """
    import base64
    import os

    from tokenizers import Tokenizer

    ranks = path.removesuffix(".json") + ".tiktoken"
    whole: list = []

    def plain(text: str) -> np.ndarray:
        if not whole:
            whole.append(Tokenizer.from_file(path))
        return np.array(whole[0].encode(text, add_special_tokens=False).ids, "<u4")

    if not (path.endswith("byte_bpe_50k.json") and os.path.exists(ranks)):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def quick(text: str) -> np.ndarray:
        if "<|endoftext|>" in text or len(text) > 2000 and max(map(len, text.split()), default=0) > 1000 or " " * 1000 in text or "\n" * 1000 in text:
            return plain(text)
        return np.array(fast.encode_ordinary(text), "<u4")

    return quick


def _pieces(path: str, size: int, id_at: int, text_at: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(text_at)
            docs: list[np.ndarray] = [np.zeros(0, np.int64)]
            pieces, starts, lengths, sums = [], [], [], []
            for row in range(batch.num_rows):
                ids = np.append(encode(texts[row].as_py() or ""), np.uint32(0)).astype("<u4")
                head = len(ids) % size
                cuts = [*([0] if head else []), *range(head, len(ids), size), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
                docs.append(np.full(len(cuts) - 1, row))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_at).take(pa.array(np.concatenate(docs))), pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                [x.split()[0] for x in _PIECES.split(", ")],
            )

    return kernel


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use up ``counts`` of pieces by length, each summing to ``size`` at most.

    Complements of up to three, of up to two and of one piece are each tried; the plan with the fewest sequences is kept.
    """
    return min((_plan(counts, size, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], size: int, most_parts: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first: its gap is filled exactly by up to ``most_parts`` available lengths (fewest and largest first), as
    often as the counts allow at once. Lengths without an exact complement are placed by best fit, longest first, again by counts:
    all equal gaps take all equal lengths in one step. Time depends on ``size`` only, not on the number of pieces.
    """
    left = Counter({k: n for k, n in counts.items() if n})
    have = sum(1 << k for k in left)
    mirror = sum(1 << (size - k) for k in left)
    out: list[tuple[tuple[int, ...], int]] = []
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def take(pattern: tuple[int, ...], n: int) -> None:
        nonlocal have, mirror
        for k in pattern:
            left[k] -= n
            if not left[k]:
                have &= ~(1 << k)
                mirror &= ~(1 << (size - k))
        bins[size - sum(pattern)].append((pattern, n))

    def times(pattern: tuple[int, ...]) -> int:
        return min(left[k] // m for k, m in Counter(pattern).items())

    def two(total: int, most: int) -> int:
        """Bits of the larger part a <= most of the available pairs a + b = total."""
        return have & (mirror >> (size - total)) & ((2 << min(most, total - 1)) - 1) & ~((1 << ((total + 1) // 2)) - 1)

    def fill(length: int) -> tuple[tuple[int, ...], int] | None:
        gap = size - length
        if not gap:
            return (length,), left[length]
        if n := times((length, gap)):
            return (length, gap), n
        found = two(gap, gap) if most_parts > 1 else 0
        while found:
            a = found.bit_length() - 1
            if n := times(p := (length, a, gap - a)):
                return p, n
            found ^= 1 << a
        firsts = have & ((1 << max(gap - 1, 0)) - 1) if most_parts > 2 else 0
        while firsts and 3 * (a := firsts.bit_length() - 1) >= gap:
            found = two(gap - a, a)
            while found:
                b = found.bit_length() - 1
                if n := times(p := (length, a, b, gap - a - b)):
                    return p, n
                found ^= 1 << b
            firsts ^= 1 << a
        return None

    for length in range(size, 0, -1):
        while left[length] and (found := fill(length)):
            take(*found)
    out += bins.pop(0, [])
    gaps = sum(1 << g for g in bins)
    for length in range(size, 0, -1):
        while left[length]:
            if fits := gaps >> length:
                gap = length + (fits & -fits).bit_length() - 1
                pattern, n = bins[gap].pop()
                used = taken = min(n, left[length])
                grown = (*pattern, length)
                if n > used:
                    bins[gap].append((pattern, n - used))
                elif not bins[gap]:
                    gaps &= ~(1 << gap)
            else:  # new sequences, each with as many of this length as go in
                each = min(size // length, left[length])
                used = left[length] // each
                grown, taken = (length,) * each, used * each
            left[length] -= taken
            rest = size - sum(grown)
            bins[rest].append((grown, used))
            if rest:
                gaps |= 1 << rest
    return out + [x for g in sorted(bins) for x in bins[g]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) ordered by length and rank."""
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None, most_in_group: int = MOST_IN_GROUP
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id 0 alone. A document longer than ``size`` is cut into full pieces, the first
    may be shorter. Rows that repeat an id, a text or both are packed each; a null id stays null. An empty table packs
    to an empty one. Only counts by length come to the driver (``size`` of them), and only the table of patterns goes
    out, whose size depends on ``size`` alone. Other columns are not read.
    """
    path = path or tokenizer_path()
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(path, size, 0, 1), _PIECES).withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(counts, size))
    groups = max(64, -(-max(counts.values(), default=0) // most_in_group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "group").agg(F.count("*").alias("n")).select(
        "length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("length", "group").orderBy("row")
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(offsets, ["length", "group"]).select(
        *[x.split()[0] for x in _PIECES.split(", ")], (F.col("rank") + F.col("base") - 1).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            at = slots[np.searchsorted(reach, length << 48 | rank, "right") - 1]
            columns = [*batch.columns[:5], pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
