"""Exact top-k by Hamming distance over binary codes: multi-index hashing with radii that grow until proven enough."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.llm.shared import stored


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 64) -> DataFrame:
    """(vec_id, code): bit i of the 64-bit code is set where component i is above zero; missing and null components are
    not. Components beyond ``bits`` (at most 64) are not part of the code. A null vector is code zero."""
    component = lambda i: F.coalesce(F.try_element_at(F.col(vector_col), F.lit(i + 1)) > 0, F.lit(False)).cast("long")
    code = F.lit(0).cast("long")
    for i in range(bits):
        code = code.bitwiseOR(F.shiftleft(component(i), i))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), code.alias("code"))


def segments_for(distinct: int, bits: int = 64) -> int:
    """Segments of about log2(n) bits, the width at which a probe meets about one code."""
    width = min(24, max(8, round(math.log2(max(distinct, 2)))))
    return max(2, -(-bits // width))


def _keys(bits: int, m: int, low: int, high: int):
    """Rows (key, code): the segment values of each code with ``low`` to ``high`` flipped bits."""
    edges = [bits * k // m for k in range(m + 1)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [
            np.array([sum(1 << b for b in c) for r in range(low, high + 1) for c in combinations(range(edges[k + 1] - edges[k]), r)], np.int64).reshape(-1)
            for k in range(m)
        ]
        for batch in batches:
            codes = np.asarray(batch.column(0))
            for at in range(0, len(codes), 512):
                part = codes[at : at + 512]
                for k in range(m):
                    value = (part.view(np.uint64) >> np.uint64(edges[k])).astype(np.int64) & ((1 << (edges[k + 1] - edges[k])) - 1)
                    key = (value[:, None] ^ masks[k]) | (k << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part, len(masks[k])))], ["key", "code"])

    return kernel


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest ids of each query, an id at its nearest code."""
    once = found.groupBy("query", "vec_id").agg(F.min(F.struct("distance", "code")).alias("best")).select("query", "vec_id", "best.*")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")


def _scan(members: DataFrame, left: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """The k + 1 nearest ids of each query code by comparing it with every row: blocks of queries go to all tasks."""

    def against(queries: np.ndarray):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 4096):
                    code, ids = (np.asarray(c) for c in whole.slice(begin, 4096).columns)
                    order = np.argsort(ids, kind="stable")
                    code, ids = code[order], ids[order]
                    for query in queries:
                        distance = np.bitwise_count((code ^ query).view(np.uint64)).astype(np.int32)
                        # an id may stand here with several codes: every row up to the (k + 1)th different id
                        near = np.argsort(distance, kind="stable")
                        _, firsts = np.unique(ids[near], return_index=True)
                        end = np.sort(firsts)[k] + 1 if len(firsts) > k else len(near)
                        near = near[:end]
                        columns = [pa.array(np.full(len(near), query)), pa.array(ids[near]), pa.array(code[near]), pa.array(distance[near])]
                        yield pa.RecordBatch.from_arrays(columns, ["query", "vec_id", "code", "distance"])

        return kernel

    out, part = None, []

    def added(out: DataFrame | None, part: list[int]) -> DataFrame:
        found = members.mapInArrow(against(np.array(part, np.int64)), "query long, vec_id long, code long, distance int")
        found = stored(_nearest(found, k))
        return found if out is None else out.unionByName(found)

    for row in left.toLocalIterator():
        part.append(row.code)
        if len(part) == block:
            out, part = added(out, part), []
    return added(out, part) if part or out is None else out


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): for each query the k nearest rows of ``codes`` other than itself, by (distance,
    vec_id).

    Both tables are (vec_id, code). Rows with a null id or code are neither found nor asked. Rows with the query's own id
    are not its neighbours; an id that repeats with different codes counts at its nearest. With fewer than k other ids all
    are returned; an empty table gives an empty one. Equal codes are searched once, and each keeps its k + 1 smallest ids,
    which is all that any query can return of it.

    Every code has ``segments`` parts. Once all parts have been searched to radius r, each code within
    ``segments * (r + 1) - 1`` bits has been met: a query ends when its kth verified distance is within that. The next
    round flips one bit more for the queries that are left. A query whose next round would ask for more keys than there
    are codes (an outlier, or k above the number of ids) is held against all codes instead, in blocks of queries.
    """
    known = stored(codes.where("vec_id is not null and code is not null").select("vec_id", "code").distinct())
    nth = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    members = stored(known.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("code", "vec_id"))
    distinct = stored(members.select("code").distinct())
    n_codes = distinct.count()
    m = segments or segments_for(n_codes, bits)
    widths = [bits * (j + 1) // m - bits * j // m for j in range(m)]
    asked = stored(queries.where("vec_id is not null and code is not null").select(F.col("vec_id").alias("query_id"), "code").distinct())
    left = stored(asked.select("code").distinct())
    index = stored(distinct.mapInArrow(_keys(bits, m, 0, 0), "key long, code long"))
    met, finished, radius = None, None, -1
    while not left.isEmpty():
        low, radius = (0, 1) if radius < 0 else (radius + 1, radius + 1)
        if radius > 1 and sum(math.comb(w, radius) for w in widths) > n_codes:
            ended = _scan(members, left, k)
            finished = ended if finished is None else finished.unionByName(ended)
            break
        probes = left.mapInArrow(_keys(bits, m, low, radius), "key long, code long").withColumnRenamed("code", "query")
        # probes outgrow the table they are made of, so neither side is broadcast
        fresh = probes.join(index.hint("merge"), "key").select("query", "code").distinct()
        if met is not None:
            again = met.join(left.select(F.col("code").alias("query")).hint("merge"), "query", "left_semi").select("query", "code")
            fresh = fresh.unionByName(again).distinct()
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int").alias("distance")
        found = fresh.select("query", "code", distance).join(members.hint("merge"), "code")
        met = stored(_nearest(found, k))
        covered = m * (radius + 1) - 1
        enough = met.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        enough = stored(enough.where((F.col("n") > k) & (F.col("far") <= covered)).select("query"))
        ended = met.join(enough.hint("merge"), "query", "left_semi")
        finished = ended if finished is None else finished.unionByName(ended)
        left = stored(left.join(enough.withColumnRenamed("query", "code").hint("merge"), "code", "left_anti"))
    if finished is None:
        return asked.selectExpr("query_id", "query_id as vec_id", "0 as distance", "0 as rank").limit(0)
    pairs = asked.join(finished.select(F.col("query").alias("code"), "vec_id", "distance").hint("merge"), "code").where("vec_id <> query_id")
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    nearest = pairs.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    return nearest.withColumn("rank", final).where(F.col("rank") <= k)
