"""Source divergence, line deduplication and periodic runs against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.llm import catalog, divergence, line_dedup, periodic
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("term", "lines", "key", "n", "copies", "count", "value", "rank", "digest", "position", "part", "item", "runs", "_id")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASH}).repartition(4)


def rows_of(found, *columns):
    return Counter(tuple(r) for r in found.select(*(columns or found.columns)).collect())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("La", "be", "Éc", "dø", "x-y", "漢") for b in "abcdefgh"]

    def text():
        return " ".join(r.choices(words, k=r.randint(0, 40))) + r.choice(["", "9 _", "\n", " 1a2"])

    rows = [(k, text(), r.choice(["en", "fr", None]), r.choice(["s1", "s2", "Ä", None, "s9"])) for k in range(90)]
    rows += [(200 + k, "Copied words beyond La beyond", "en", "s1" if k % 3 else "s2") for k in range(40)]
    rows += [(300, None, "en", "s1"), (301, "", "fr", "only here"), (302, None, "de", "a"), (303, "1 2", "de", "b"), (None, "La La", "en", "s1"), (300, "La bb", "en", "s1")]
    rows += [(304, "once only words", "xx", "a"), (305, "other", "xx", "b"), (306, "la " * 3000 + "Lb", "en", "s2"), (300, "La bb", "en", "s1")]
    return [(*row, 1) for row in rows]


@pytest.mark.parametrize("block", [256, 2])
def test_source_divergence(spark, corpus, block):
    found = divergence.source_divergence(frame(spark, corpus), block=block)
    assert rows_of(found) == Counter(brute.divergence([r[1:4] for r in corpus]))


def test_few_terms_are_reported_by_rank(spark, corpus):
    found = divergence.source_divergence(frame(spark, corpus), min_documents=1, top_terms=2)
    assert rows_of(found) == Counter(brute.divergence([r[1:4] for r in corpus], 1, 2))


def test_equal_texts_are_one_row_with_their_copies(spark, corpus):
    found = divergence.collapsed(frame(spark, corpus)).where("text like 'Copied%'").collect()
    assert [(r.lang, sorted(map(tuple, r.copies))) for r in found] == [("en", [("s1", 26), ("s2", 14)])]


def test_shares_of_huge_counts_are_exact(spark):
    counts = [(0, 1, 1), (10**15, 3 * 10**15, 7), (3 * 10**15, 3 * 10**15, 1), (10**10 + 3, 10**17 + 1, 10**9)]
    table = spark.createDataFrame(counts, "c long, n long, v long")
    found = table.select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.n + r.v) for r in found)


@pytest.fixture(scope="module")
def lined():
    r = random.Random(4)
    lines = ["Terms of Use", " terms of use\t", "", "  ", "É line", "é line", "unique %d", "x", "A footer \v", "all rights reserved"]

    def text():
        return "\n".join(r.choice(lines).replace("%d", str(r.random())) for _ in range(r.randint(1, 9)))

    rows = [(k, text()) for k in range(70)]
    rows += [(100 + k, "x\nTERMS OF USE\n\nx") for k in range(30)] + [(7, rows[7][1]), (7, "x\nother"), (None, "x\nx\nnone"), (None, None), (None, "x\nx\nnone")]
    rows += [(200, ""), (201, None), (202, "\n\n"), (203, "\n".join(["x", "A footer"] * 3000 + ["kept"])), (204, "x")]
    return [(d, t, "en", "s", 1) for d, t in rows]


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("most", [1 << 12, 5])
def test_line_dedup(spark, lined, first, most):
    documents = frame(spark, lined)
    bitmaps = line_dedup.keep_bitmaps(documents, keep_first=first, most_in_group=most)
    found = line_dedup.kept_lines(documents, bitmaps)
    want = brute.kept_lines([r[:2] for r in lined], 10, first)
    assert rows_of(found) == Counter(want)
    assert rows_of(bitmaps.select("doc_id", "n_lines", "n_dropped")).keys() == {w[:3] for w in want if w[2]}


@pytest.mark.parametrize("documents_needed,chars", [(1, 1), (2, 8), (1000, 1)])
def test_line_dedup_by_other_bounds(spark, lined, documents_needed, chars):
    documents = frame(spark, lined)
    found = line_dedup.kept_lines(documents, line_dedup.keep_bitmaps(documents, min_documents=documents_needed, min_chars=chars))
    assert rows_of(found) == Counter(brute.kept_lines([r[:2] for r in lined], documents_needed, False, chars))


def test_line_dedup_runs_without_python(spark, lined):
    documents = spark.createDataFrame(lined, SCHEMA)
    found = line_dedup.kept_lines(documents, line_dedup.keep_bitmaps(documents))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))


def test_bitmaps_are_runs_of_kept_lines(spark):
    rows = [(k, "a\nb\nx\nx\nc%d" % k, "en", "s", 1) for k in range(3)] + [(9, "x\nx", "en", "s", 1)]
    found = line_dedup.keep_bitmaps(spark.createDataFrame(rows, SCHEMA), min_documents=4)
    assert {(r.doc_id, r.n_lines, tuple(map(tuple, r.keep_runs))) for r in found.collect()} == {
        *((k, 5, ((0, 2), (4, 1))) for k in range(3)), (9, 2, ()),
    }


def periodic_texts():
    r = random.Random(8)
    rows = []
    for k in range(150):
        base = [r.choice("abc") for _ in range(r.randint(1, 12))]
        words = [r.choice("abc") for _ in range(r.randint(0, 9))] + base * r.randint(1, 14) + [r.choice("abcd") for _ in range(r.randint(0, 9))]
        rows.append((k, r.choice([" ", "\t ", "\n"]).join(words * r.randint(1, 3))))
    rows += [(200 + k, " ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(1, 200)))) for k in range(60)]
    rows += [(300, "the " * 400), (301, None), (302, ""), (303, " \t"), (304, "one"), (None, "a b " * 40), (None, None), (5, "É é " * 30), (5, "É é " * 30)]
    passage = " ".join(f"p{i}" for i in range(20))
    return rows + [(305, " ".join(f"{passage} s{i}" for i in range(60))), (306, " ".join(["x"] * 30 + ["y"] + ["x"] * 24 + ["y"] + ["x"] * 23))]


def test_periodic_query(spark, monkeypatch):
    rows = periodic_texts()
    monkeypatch.setattr(catalog, "table", lambda *_: frame(spark, [(d, t, "en", "s", 1) for d, t in rows]))
    found = catalog.op13_periodic(spark, "")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert found.columns == columns
    assert rows_of(found) == Counter(brute.periodic(d, t) for d, t in rows)


def test_runs_and_collapsed_texts(spark):
    texts = [(d, t, "en", "s", 1) for d, t in periodic_texts()]
    found = periodic.periodic_runs(frame(spark, texts), min_length=9, min_exponent=4)
    for row in found.collect():
        assert row.n_dropped == row.n_words - len((row.collapsed or "").split())
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs))) for r in found.collect())
    split = [(d, brute.WORDS.findall(t or "")) for d, t, *_ in texts]
    assert got == Counter((d, len(w), tuple(brute.runs(w, 9, 4))) for d, w in split)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_small_alphabets(seed):
    r = random.Random(seed)
    for _ in range(150):
        rows = [[r.randrange(2) for _ in range(r.randint(1, 5))] * r.randint(1, 20) + [r.randrange(3) for _ in range(r.randint(0, 60))] for _ in range(3)]
        rows = [row * r.randint(1, 4) for row in rows]
        length, exponent = r.choice([(24, 3), (1, 3), (10, 5)])
        found = periodic.runs_of(np.concatenate(rows).astype(np.int64), np.repeat(np.arange(3), [len(x) for x in rows]), length, exponent)
        first = np.cumsum([0, *map(len, rows)])
        assert found == sorted((s + int(first[k]), n, q) for k, row in enumerate(rows) for s, n, q in brute.runs(row, length, exponent))


def test_many_repeats_far_apart_cost_little():
    words = np.array([x for k in range(20_000) for x in (*range(19), 100 + k)])
    places, _ = periodic.near_repeats(words, np.zeros(len(words), np.int64), 16, 2)
    assert not len(places)
    assert periodic.runs_of(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, min_exponent=2)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.source_divergence(empty).collect() == []
    assert line_dedup.kept_lines(empty, line_dedup.keep_bitmaps(empty)).collect() == []
    assert periodic.periodic_runs(empty).collect() == []
    assert catalog.with_planted_periods(empty).collect() == []
