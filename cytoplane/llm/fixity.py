"""Fixity audit of WARC replicas: Merkle trees over records in byte ranges, descended only where they differ.

Ranges and inner nodes are cut by content, so that the trees of two replicas meet again after a lost or added record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.llm.shared import stored

#: Bytes of a leaf range and children of an inner node, on average; records that a range has at most.
RANGE_BYTES, FANOUT, MOST_RECORDS = 1 << 16, 16, 1 << 12


def warc_records(pages: DataFrame, pages_in_archive: int = 100) -> DataFrame:
    """Pages as records of archives: (archive, record_id, offset, length, digest), offsets in order of page_id.

    A record is the header line ``page_id url`` and the html; nulls are empty strings. Only lengths and digests are kept.
    An archive holds the rows of ``pages_in_archive`` consecutive ids; rows without an id are spread over archives of
    their own by digest.
    """
    body = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    records = pages.select(
        F.col("page_id").cast("long").alias("record_id"), F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest")
    )
    spread = -1 - F.pmod(F.xxhash64("digest"), F.lit(4096))
    records = records.withColumn("archive", F.coalesce(F.floor(F.col("record_id") / pages_in_archive).cast("long"), spread))
    before = Window.partitionBy("archive").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _cut(rows: DataFrame, by: list[str], ends, most: int, into: str) -> DataFrame:
    """Groups of consecutive rows of an archive: a group ends after a row whose content says so, at ``most`` rows at last.

    As content decides, groups meet again soon after rows that one side lacks.
    """
    before = Window.partitionBy("side", "archive").orderBy(*by)
    run = F.coalesce(F.sum(ends.cast("long")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("side", "archive", "run").orderBy(*by)) - 1
    return rows.withColumn("run", run).withColumn(into, F.col("run") * (1 << 32) + F.floor(place / most)).drop("run")


def _hashed(rows: DataFrame, by: list[str], node: str, content) -> DataFrame:
    """Nodes (side, archive, node, hash, first): hash of the ordered contents. A group is bounded by ``_cut``."""
    ordered = F.array_sort(F.collect_list(F.struct(*by, content.alias("content"))))
    joined = F.concat_ws(",", F.transform(ordered, lambda x: x["content"]))
    first = F.min("offset" if "offset" in rows.columns else "first").alias("first")
    return rows.groupBy("side", "archive", F.col(node).alias("node")).agg(F.sha2(joined, 256).alias("hash"), first)


_ORDER = ["offset", "digest", "length", "record_id"]


def trees(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """Records with their range, and the levels of the trees over the ranges, leaves first.

    ``records`` holds both sides: (side, archive, record_id, offset, length, digest). A range ends after a record whose
    digest falls below the share of its length in ``range_bytes``, so ranges are about that long; inner nodes end by the
    hash of a child and have about ``fanout`` of them. Levels are (side, archive, node, hash, first, parent), ``first``
    being the offset at which the node begins; the last level's parent is the root. Both sides have equal heights.
    """
    ends = F.pmod(F.xxhash64("digest"), F.lit(range_bytes)) < F.col("length")
    ranged = stored(_cut(records, _ORDER, ends, MOST_RECORDS, "range"))
    nodes = _hashed(ranged, _ORDER, "range", F.concat_ws(":", F.col("length").cast("string"), "digest"))
    levels = []
    while True:
        nodes = stored(nodes)
        most = nodes.groupBy("side", "archive").count().agg(F.max("count")).first()[0] or 0
        if most <= 2 * fanout:
            return ranged, [*levels, nodes.withColumn("parent", F.lit(0).cast("long"))]
        ends = F.pmod(F.xxhash64("hash"), F.lit(fanout)) == 0
        levels.append(stored(_cut(nodes, ["node"], ends, 4 * fanout, "parent")))
        nodes = _hashed(levels[-1], ["node"], "parent", F.col("hash"))


def _sides(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows of both sides paired by equal keys in the order of ``by``: columns of side 0, and of side 1 with a 1 behind."""
    turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy("side", *keys).orderBy(*by)))
    left, right = (turned.where(F.col("side") == k).drop("side") for k in (0, 1))
    right = right.select(*[F.col(c).alias(f"{c}1") for c in right.columns])
    same = [left[c].eqNullSafe(right[f"{c}1"]) for c in (*keys, "turn")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return left.withColumn("here", F.lit(True)).join(right.withColumn("there", F.lit(True)), condition, "full")


def _out_of_order(pairs: DataFrame, place: str) -> DataFrame:
    """Pairs that come before their predecessor on the other side."""
    back = F.lag(f"{place}1").over(Window.partitionBy("archive").orderBy(place))
    return pairs.where("here and there").withColumn("back", back).where(F.col("back") > F.col(f"{place}1"))


def audit(original: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas: (archive, offset, kind, record_id, replica_record_id, digest,
    replica_digest, replica_offset).

    Both tables are (archive, record_id, offset, length, digest). Roots are compared first; at each level only the
    children of nodes that the other side lacks are looked at, down to the records of such ranges. Ranges are cut by
    content and compared by hash, so a record that is lost or new shifts the offsets of all later ones without making
    them differ. ``kind`` is ``missing`` or ``extra`` for a record that only the original or only the replica has (as
    often as one side has more equal ones), ``altered`` for two such with one record id in one archive (without ids: at
    the same place between intact records), and ``moved`` for an intact record, or an intact node (its hash as digest,
    no record id), that comes before its predecessor in the replica. The offset is that in the original, for an extra
    record that in the replica. A digest and length, not an id, tell whether a record is intact. Rows with a null archive
    or offset lie in no archive and are left out; a null digest or length is an empty string or 0. Records at one offset
    are ordered by digest, length and id. Other columns are not read; empty tables are replicas without records.
    """
    def whole(records: DataFrame, side: int) -> DataFrame:
        return records.where("archive is not null and offset is not null").select(
            F.lit(side).alias("side"), F.col("archive").cast("long").alias("archive"), F.col("record_id").cast("long").alias("record_id"), F.col("offset").cast("long").alias("offset"),
            F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), F.coalesce("digest", F.lit("")).alias("digest"),
        )

    ranged, levels = trees(whole(original, 0).unionByName(whole(replica, 1)), range_bytes, fanout)
    roots = _hashed(levels[-1], ["node"], "parent", F.col("hash"))
    apart = roots.groupBy("archive").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")).where("n < 2 or low <> high")
    wanted = levels[-1].join(apart, "archive", "left_semi")
    moved = []
    for k in range(len(levels) - 1, -1, -1):
        pairs = stored(_sides(wanted.select("side", "archive", "node", "hash", "first"), ["archive", "hash"], ["node"]))
        moved.append(_out_of_order(pairs, "node").select("archive", "first", "first1", "hash"))
        lacking = pairs.where("here is null or there is null").select(
            F.when(F.col("here"), 0).otherwise(1).alias("side"), F.coalesce("archive", "archive1").alias("archive"), F.coalesce("node", "node1").alias("parent")
        )
        below = levels[k - 1] if k else ranged.withColumnRenamed("range", "parent")
        wanted = below.join(lacking, ["side", "archive", "parent"], "left_semi")

    wanted = stored(wanted.withColumn("place", F.row_number().over(Window.partitionBy("side", "archive").orderBy(*_ORDER))))
    pairs = stored(_sides(wanted, ["archive", "digest", "length"], ["place"]))
    intact = pairs.where("here and there")
    lone = pairs.where("here is null or there is null").select(
        F.when(F.col("here"), 0).otherwise(1).alias("side"), *[F.coalesce(c, f"{c}1").alias(c) for c in ("archive", "place", "record_id", "offset", "digest")]
    )
    known = intact.select(F.lit(0).alias("side"), "archive", "place").unionByName(intact.select(F.lit(1).alias("side"), F.col("archive1").alias("archive"), F.col("place1").alias("place")))
    every = lone.withColumn("intact", F.lit(0)).unionByName(known.withColumn("intact", F.lit(1)), allowMissingColumns=True)
    gap = F.sum("intact").over(Window.partitionBy("side", "archive").orderBy("place"))
    gaps = every.withColumn("gap", F.when(F.col("record_id").isNull(), gap)).where("intact = 0").drop("intact")
    differ = _sides(gaps, ["archive", "record_id", "gap"], ["place"])
    kind = F.when(F.col("here").isNull(), "extra").when(F.col("there").isNull(), "missing").otherwise("altered")
    found = differ.select(
        F.coalesce("archive", "archive1").alias("archive"), F.coalesce("offset", "offset1").alias("offset"), kind.alias("kind"), "record_id",
        F.col("record_id1").alias("replica_record_id"), "digest", F.col("digest1").alias("replica_digest"), F.col("offset1").alias("replica_offset"),
    )
    late = _out_of_order(intact, "place").select(
        "archive", "offset", F.lit("moved").alias("kind"), "record_id", F.col("record_id1").alias("replica_record_id"), "digest",
        F.col("digest1").alias("replica_digest"), F.col("offset1").alias("replica_offset"),
    )
    found = found.unionByName(late)
    for nodes in moved:
        none = F.lit(None).cast("long")
        found = found.unionByName(
            nodes.select(
                "archive", F.col("first").alias("offset"), F.lit("moved").alias("kind"), none.alias("record_id"), none.alias("replica_record_id"),
                F.col("hash").alias("digest"), F.col("hash").alias("replica_digest"), F.col("first1").alias("replica_offset"),
            )
        )
    return found
