"""Line deduplication in DataFrame functions: hashes in range partitions, sorted by document and position.

Lines that occur too rarely to matter are dropped by exact counts before anything is sorted. The others are dealt out by
range of their hash, streamed in the order of document and position, and leave one compressed keep bitmap a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.llm.shared import stored

MIN_DOCUMENTS, MIN_CHARS = 10, 1
#: Lines of one key that are sorted as one group; a more frequent key is split by document into groups of about this size.
MOST_IN_GROUP = 1 << 12

_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased (other letters stay as they are)."""
    bare = F.btrim(line, F.lit(_SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _identity(id_col: str, text_col: str) -> list[Column]:
    """A document: its id and the digest of its text. Rows equal in both have the same lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_digest"), text.alias("text")]


def _bound(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), of)[0]


def _keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs of kept lines between sorted dropped positions."""

    def run(k: Column, places: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1) + 1)
        end = F.when(k == F.size(places), n_lines).otherwise(F.get(places, k))
        return F.struct(start.alias("start"), (end - start).alias("length"))

    def runs(places: Column) -> Column:
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(places)), lambda k: run(k, places)), lambda r: r["length"] > 0)

    return _bound(dropped, runs)


def keep_bitmaps(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    keep_first: bool = False,
    most_in_group: int = MOST_IN_GROUP,
) -> DataFrame:
    """(doc_id, text_digest, n_lines, n_dropped, keep_runs) of each document that loses lines.

    A key (see ``line_key``) of at least ``min_chars`` code points in at least ``min_documents`` documents loses all its
    lines, or with ``keep_first`` all but the first line of the first document in the order of id and text digest (null
    ids first). ``keep_runs`` is the bitmap of kept lines as (start, length) of its runs of ones; a document that is not
    returned keeps every line. Every row is a document and counts as one, repeated rows too; rows equal in id and text
    share one bitmap. A null or empty text is one empty line. Keys are told apart by 128-bit digests. Other columns are
    not read. An empty table gives an empty one.
    """
    rows = documents.select(*_identity(id_col, text_col))
    split = rows.select("doc_id", "text_digest", F.split("text", "\n").alias("lines"))
    each = split.select("doc_id", "text_digest", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("position", "line"))
    keyed = each.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = stored(keyed.select(F.unhex(F.md5("key")).alias("key"), "doc_id", "text_digest", "n_lines", "position"))

    # A key has at least as many lines as documents, so fewer lines settle it; partial sums spread the frequent ones.
    often = stored(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents))
    groups = F.ceil(F.col("n") / most_in_group)
    wanted = lines.join(often, "key").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_digest"), groups).cast("long"))

    ranged = wanted.repartitionByRange("key", "part").sortWithinPartitions("key", "part", "doc_id", "text_digest", "position")
    document = Window.partitionBy("key", "part", "doc_id", "text_digest").orderBy("position")
    first = F.col("position") == F.min("position").over(document)
    streamed = ranged.withColumn("first", first.cast("long"))
    counted = streamed.withColumn("documents", F.sum("first").over(Window.partitionBy("key", "part")))
    if keep_first:
        ahead = Window.partitionBy("key", "part").orderBy("doc_id", "text_digest", "position")
        counted = counted.withColumn("turn", F.rank().over(ahead))
    whole = F.col("n") <= most_in_group
    found = counted.where(~whole | (F.col("documents") >= min_documents))
    if keep_first:
        found = found.where(~whole | (F.col("turn") > 1))
    found = found.select("doc_id", "text_digest", "n_lines", "position", "key", "first", "n")
    split_keys = often.where(~whole).select("key")
    if not split_keys.isEmpty():
        # Keys of several groups: their documents are summed over the groups, one row a group and task.
        several = stored(found.where(~whole))
        least = F.min(F.struct("doc_id", "text_digest", "position")).alias("head")
        totals = several.groupBy("key").agg(F.sum("first").alias("documents"), least).where(F.col("documents") >= min_documents)
        rest = several.join(totals, "key")
        if keep_first:
            rest = rest.where(F.struct("doc_id", "text_digest", "position") != F.col("head"))
        found = found.where(whole).unionByName(rest.select(*found.columns))
    dropped = found.groupBy("doc_id", "text_digest").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("position")).alias("dropped"))
    return dropped.select(
        "doc_id", "text_digest", "n_lines", F.size("dropped").alias("n_dropped"), _keep_runs(F.col("dropped"), F.col("n_lines")).alias("keep_runs")
    )


def kept_lines(documents: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row: its lines that the bitmap keeps, joined by line feeds.

    ``bitmaps`` is the result of ``keep_bitmaps``; a row without one keeps all lines. A null text is an empty one.
    """
    rows = documents.select(*_identity(id_col, text_col))
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_digest"), F.col("n_dropped").alias("_dropped"), "keep_runs")
    joined = rows.join(marks, (rows["text_digest"] == marks["_digest"]) & rows["doc_id"].eqNullSafe(marks["_id"]), "left")

    def kept(lines: Column) -> Column:
        return F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")

    shorter = _bound(F.split("text", "\n"), kept)
    return joined.select(
        "doc_id",
        (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(shorter).alias("kept"),
    )
