"""Divergence of sources: how far the words of each source of a language are from those of the others and of all.

Equal texts of a language are collapsed into one with the number of its copies in each source, so every text is tokenized
once. Pairs of sources are evaluated over the words that both have; what the other words add follows from how often each
count occurs in a source, and from the number of words that neither has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoplane.llm.shared import stored, text_column, text_slices, word_bounds

#: Shares are counted in parts of this. Sources that one block of a pair evaluation holds on each side.
UNIT, BLOCK = 10**9, 256


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` and of A-Z in lower case."""
    letter = np.zeros(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    return letter, lower


def collapsed(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, text, copies): one row for each distinct text of a language, ``copies`` its (source, n).

    Copies are counted by digest before texts move; the text itself leaves a task once, however often it occurs there.
    """
    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rows = documents.select(value(lang_col).alias("lang"), value(source_col).alias("source"), value(text_col).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    counts = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = counts.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, documents) summed over about a megabyte of text."""
    letter, lower = _letters()
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        copies = batch.column(2)
        many = np.diff(np.asarray(copies.offsets))
        held = copies.flatten()
        source = held.field(0).dictionary_encode()
        source_code, times = np.asarray(source.indices).astype(np.int64), np.asarray(held.field(1))
        width = max(len(source.dictionary), 1)
        group = np.repeat(np.asarray(lang.indices).astype(np.int64), many) * width + source_code  # of each copy entry
        entry = np.concatenate([[0], np.cumsum(many)])
        for begin, end, data, bounds in text_slices(text_column(batch.column(1))):
            data = lower[data]
            starts, ends, first = word_bounds(data, bounds, letter)
            if not len(starts):
                continue
            inside = letter[data]
            offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
            words = words.dictionary_encode()
            n_words = len(words.dictionary)
            row = np.repeat(np.arange(begin, end), np.diff(first))
            in_text, count = np.unique(row * n_words + np.asarray(words.indices), return_counts=True)
            row, word = in_text // n_words, in_text % n_words
            each = many[row]  # entries that hold this text
            at = np.repeat(entry[row] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            word, count, weight = np.repeat(word, each), np.repeat(count, each), times[at]
            keys, back = np.unique(group[at] * n_words + word, return_inverse=True)
            total, documents = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(total, back, count * weight)
            np.add.at(documents, back, weight)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(keys // n_words // width)), source.dictionary.take(pa.array(keys // n_words % width)),
                    words.dictionary.take(pa.array(keys % n_words)).cast(pa.large_string()).cast(pa.string()), pa.array(total), pa.array(documents),
                ],
                ["lang", "source", "term", "count", "documents"],
            )


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, count, documents) of collapsed texts: occurrences and documents, every copy counted."""
    counted = texts.mapInArrow(_terms, "lang string, source string, term string, count long, documents long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact for any count."""
    exact = [c.cast("decimal(20,0)") for c in (count + 1, total + terms)]
    quotient = F.call_function("div", (exact[0] * F.lit(UNIT).cast("decimal(10,0)")), exact[1])
    return F.lit(1).cast("long") + quotient.cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares, which fit in a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(block: int):
    """Rows (lang, [(source, p, p of a word without occurrences)]), a word each, to partial sums (lang, a, b, value).

    value is what a word that both sources have adds beyond what it would add as a word of one of them: f(p, q) - f(p, q0)
    - f(p0, q) + f(p0, q0). Sums stay within a long, as those of f over all words of a pair do.
    """
    def f(p, q):
        return (p - q) * (p - q) // q

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            many = np.diff(np.asarray(lists.offsets))
            entries = lists.flatten()
            lang = batch.column(0).dictionary_encode()
            term = np.repeat(np.arange(batch.num_rows), many)
            of_lang = np.repeat(np.asarray(lang.indices), many)
            source = entries.field(0).dictionary_encode()
            code = np.asarray(source.indices).astype(np.int64)
            share_of, absent = np.asarray(entries.field(1)), np.asarray(entries.field(2))
            for k in range(len(lang.dictionary)):
                mine = np.flatnonzero(of_lang == k)
                names, column = np.unique(code[mine], return_inverse=True)
                rows, line = np.unique(term[mine], return_inverse=True)
                p0 = np.zeros(len(names), np.int64)
                p0[column] = absent[mine]
                out_a, out_b, out = [], [], []
                for a in range(0, len(names), block):
                    for b in range(0, len(names), block):
                        total = _block(line, column, share_of[mine], p0, a, b, block, f)
                        i, j = np.nonzero(total)
                        apart = a + i != b + j
                        i, j = i[apart], j[apart]
                        out_a.append(names[a + i]), out_b.append(names[b + j]), out.append(total[i, j])
                if out:
                    a, b, value = (np.concatenate(x) for x in (out_a, out_b, out))
                    yield pa.RecordBatch.from_arrays(
                        [lang.dictionary.take(pa.array(np.full(len(a), k))), source.dictionary.take(pa.array(a)), source.dictionary.take(pa.array(b)), pa.array(value)],
                        ["lang", "source", "item", "value"],
                    )

    return kernel


def _block(line, column, shares, p0, a: int, b: int, block: int, f, most_cells: int = 1 << 20) -> np.ndarray:
    """Sums over words for sources a.. against b.., by runs of words so that no grid exceeds ``most_cells``."""
    left, right = (np.flatnonzero((column >= x) & (column < x + block)) for x in (a, b))
    wide, high = min(block, len(p0) - b), min(block, len(p0) - a)
    total = np.zeros((high, wide), np.int64)
    step = max(1, most_cells // (wide * 2))
    n = int(line.max()) + 1 if len(line) else 0
    for begin in range(0, n, step):
        inside = right[(line[right] >= begin) & (line[right] < begin + step)]
        q = np.zeros((min(step, n - begin), wide), np.int64)
        q[line[inside] - begin, column[inside] - b] = shares[inside]
        own = left[(line[left] >= begin) & (line[left] < begin + step)]
        by_source = np.argsort(column[own], kind="stable")
        own = own[by_source]
        edges = np.searchsorted(column[own], np.arange(a, a + high + 1))
        for i in range(high):
            mine = own[edges[i] : edges[i + 1]]
            if len(mine):
                there = q[line[mine] - begin]
                have = there > 0
                p, q0 = shares[mine][:, None], p0[b : b + wide][None, :]
                safe = np.where(have, there, 1)
                extra = f(p, safe) - f(p, q0) - f(p0[a + i], safe) + f(p0[a + i], q0)
                total[i] += np.where(have, extra, 0).sum(axis=0)
    return total


def source_divergence(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = 3, top_terms: int = 200, block: int = BLOCK
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of each language, and their telling terms.

    A term is kept in a language if ``min_documents`` of its documents or more have it. Part ``pair`` has every other
    source of the language with the summed distance of the source's shares to its shares; part ``term`` the ``top_terms``
    kept terms most above their share in the whole language. Ranks go by value descending, then item. Null lang, source
    and text are empty strings; every row is a document, repeated ones too, and a group without kept terms has value 0 in
    languages without any. Other columns are not read; an empty table gives an empty one.
    """
    groups = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    groups = stored(groups.distinct())
    counts = stored(term_counts(collapsed(documents, text_col, lang_col, source_col)))
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("count").alias("lang_count"), F.collect_list(F.struct("source", "count")).alias("sources")
    )
    kept = stored(by_term.where(F.col("documents") >= min_documents).select("lang", "term", "lang_count", "sources"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    each = kept.select("lang", "term", "lang_count", F.explode("sources").alias("s")).select("lang", "term", "lang_count", "s.source", "s.count")
    sums = each.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("own"))
    none = F.lit(0).cast("long")
    facts = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("terms", "lang_total", "total", "own")]
    )
    absent = F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"))).alias("p0")
    facts = stored(facts.select("*", absent))

    shares = each.join(facts, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_count"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    shares = stored(shares)
    value = distance(F.col("p"), F.col("q")).alias("value")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value)

    ahead = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(ahead)).where(F.col("rank") <= top_terms)

    # Sums over pairs: words of neither source; words of one, by how many of its words have each share; words of both.
    other = facts.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("other_own"))
    neither = (F.col("terms") - F.col("own") - F.col("other_own")) * distance(F.col("p0"), F.col("q0"))
    pairs = facts.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(neither, none).alias("value"))
    bars = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n"))
    against = bars.join(other, "lang").where("source <> item")
    mine = against.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * distance(F.col("p"), F.col("q0"))).alias("value"))
    theirs = against.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(
        F.sum(F.col("n") * distance(F.col("q0"), F.col("p"))).alias("value")
    )
    entries = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where(F.size("entries") > 1)
    both = entries.select("lang", "entries").mapInArrow(_pairs(block), "lang string, source string, item string, value long")
    summed = pairs.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ahead).alias("rank"))
    return ranked.unionByName(terms)
