"""URL filter: rules and listed addresses in a sorted array of 64-bit digests, probed by binary search."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.shared import stored

#: A list up to this size goes to every executor; a larger one is cut by digest and the distinct keys go to its parts.
MOST_LIST_BYTES = 64 << 20
#: Rows probed at once.
ROWS = 4096


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min((k for c in "?#" if (k := path.find(c)) >= 0), default=len(path))
    return host, path[:stop]


class DigestArray:
    """Entries ordered by XXH64, memory-mapped from an unlinked temporary file of the task: digests, string ends, strings.

    A probe is a vectorised binary search over all keys; equal digests are confirmed on the stored strings.
    """

    def __init__(self, entries: list[tuple[str, int]]) -> None:
        import xxhash

        rows = sorted({(xxhash.xxh64_intdigest(s.encode()), s.encode(), v) for s, v in entries})
        digests = np.array([r[0] for r in rows], np.uint64)
        ends = np.cumsum([len(r[1]) for r in rows], dtype=np.uint64)
        self.values = np.array([r[2] for r in rows], np.int64)
        self.n = len(rows)
        with tempfile.TemporaryFile() as file:
            file.write(digests.tobytes() + ends.astype(np.uint64).tobytes() + b"".join(r[1] for r in rows) + b"\0")
            file.flush()
            self.map = np.memmap(file, np.uint8, "r")
        self.digests = self.map[: 8 * self.n].view(np.uint64)
        self.ends = self.map[8 * self.n : 16 * self.n].view(np.uint64)
        self.strings = self.map[16 * self.n :]

    def string(self, k: int) -> bytes:
        begin = int(self.ends[k - 1]) if k else 0
        return self.strings[begin : int(self.ends[k])].tobytes()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Value of each key, -1 where it is not listed."""
        import xxhash

        wanted = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        out = np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.digests, wanted)
        for row in np.flatnonzero((at < self.n) & (self.digests[np.minimum(at, self.n - 1)] == wanted)) if self.n else ():
            k = int(at[row])
            while k < self.n and self.digests[k] == wanted[row]:  # several strings may have one digest
                if self.string(k) == keys[row]:
                    out[row] = self.values[k]
                    break
                k += 1
        return out


def keys_of(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """The listed strings that could fit: host and its parent domains of up to ``labels`` labels, each with the path's
    prefixes of given lengths."""
    parts = host.rsplit(".", labels)
    tails = parts[1:] if len(parts) > labels else parts  # the first part may hold several labels
    hosts = [".".join(tails[k:]) for k in range(len(tails))] if host else []
    return [h + path[:n] for h in hosts for n in lengths if n <= len(path)]


def _judged(urls: DataFrame, url_col: str, id_col: str) -> DataFrame:
    return urls.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))


def filter_urls(
    urls: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_list_bytes: int = MOST_LIST_BYTES
) -> DataFrame:
    """Per row: page_id, host, path, rule (the longest entry that fits, else null), priority, verdict (its, or ``default``).

    ``entries``: (rule, verdict, priority), a rule being host and path prefix in one string, such as ``example.net/en/``;
    it fits its host and all subdomains. Of the rules that fit, those of the highest priority (0 where the column is
    missing or null) are asked first. Null rules or verdicts fit nothing; of equal rules ``allow`` wins. A null url, or one
    without ``://``, has empty host and path and no rule fits. Rows that repeat are judged each, null ids stay null, other
    columns are not read. Lists above ``most_list_bytes`` are cut by digest into parts; then only the distinct keys of the
    urls are shuffled, never one row for each url of a frequent host.
    """
    spark = urls.sparkSession
    priority = F.coalesce(F.col("priority").cast("long"), F.lit(0)) if "priority" in entries.columns else F.lit(0).cast("long")
    value = (2 * priority + (F.col("verdict") == "allow").cast("long")).alias("value")
    listed = entries.where("rule is not null and verdict in ('allow', 'block')").select(F.col("rule").cast("string").alias("rule"), value)
    listed = stored(listed.groupBy("rule").agg(F.max("value").alias("value")))
    path_length = F.when(F.instr("rule", "/") > 0, F.length("rule") - F.instr("rule", "/") + 1).otherwise(0)
    labels = F.size(F.split(F.split_part("rule", F.lit("/"), F.lit(1)), r"\."))
    facts = listed.agg(
        F.sum(F.octet_length("rule") + 24).alias("size"), F.collect_set(path_length).alias("lengths"), F.max(labels).alias("labels")
    ).first()
    lengths, labels = sorted(facts["lengths"]), facts["labels"] or 0
    size = facts["size"] or 0
    if size > most_list_bytes:
        return _filter_in_parts(urls, listed, lengths, labels, -(-size // most_list_bytes), id_col, url_col, default)
    every = spark.sparkContext.broadcast([(r.rule, r.value) for r in listed.toLocalIterator()])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestArray(every.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                split = [split_url(u) for u in batch.column(1).to_pylist()]
                asked = [[k.encode() for k in keys_of(h, p, lengths, labels)] for h, p in split]
                values = index.probe([k for keys in asked for k in keys])
                rules, priorities, verdicts, at = [], [], [], 0
                for keys in asked:
                    found = [(int(v) >> 1, len(k.decode()), k, int(v) & 1) for k, v in zip(keys, values[at : at + len(keys)]) if v >= 0]
                    at += len(keys)
                    best = max(found, default=None)
                    rules.append(best and best[2].decode())
                    priorities.append(best and best[0])
                    verdicts.append(("block", "allow")[best[3]] if best else default)
                columns = [pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rules, pa.string())]
                columns += [pa.array(priorities, pa.int64()), pa.array(verdicts, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "priority", "verdict"])

    return _judged(urls, url_col, id_col).mapInArrow(kernel, "page_id long, host string, path string, rule string, priority long, verdict string")


def _filter_in_parts(urls: DataFrame, listed: DataFrame, lengths: list[int], labels: int, parts: int, id_col: str, url_col: str, default: str) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_url(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in found]), pa.array([p for _, p in found]), pa.array([keys_of(h, p, lengths, labels) for h, p in found], pa.list_(pa.string()))],
                ["page_id", "host", "path", "keys"],
            )

    rows = _judged(urls, url_col, id_col).mapInArrow(split, "page_id long, host string, path string, keys array<string>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    part = F.pmod(F.xxhash64("rule"), F.lit(parts)).alias("part")
    asked = rows.select(F.explode("keys").alias("rule")).distinct().select("rule", part)

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        index = DigestArray([*zip(right["rule"].to_pylist(), right["value"].to_pylist())])
        keys = left["rule"].to_pylist()
        values = index.probe([k.encode() for k in keys])
        found = np.flatnonzero(values >= 0)
        return pa.table({"rule": pa.array([keys[k] for k in found], pa.string()), "value": pa.array(values[found])})

    held = listed.select("rule", "value", part)
    matched = stored(asked.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(probe, "rule string, value long"))
    hits = rows.select("row", F.explode("keys").alias("rule")).join(matched, "rule")
    order = F.struct(F.shiftright("value", 1).alias("priority"), F.length("rule").alias("n"), "rule", "value")
    best = hits.groupBy("row").agg(F.max(order).alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.value") % 2 == 1, "allow").otherwise("block")
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.priority").alias("priority"), verdict.alias("verdict"))
