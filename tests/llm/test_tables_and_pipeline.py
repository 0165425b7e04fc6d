"""URL rules, fixity audits, top-k and the pipeline against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cytoplane.llm import catalog, fixity, topk, url_filter
from tests.llm import brute


def judged(url, entries, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = brute.ascii_lower(rest[:n]), rest[n:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    best = None
    for rule, verdict, priority in entries:
        h, slash, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (-1,), (priority, len(rule), rule, verdict))
    return (host, path, best and best[2], best and best[0], best[3] if best else default)


@pytest.mark.parametrize("most", [64 << 20, 60])
def test_urls(spark, most):
    entries = catalog.RULES + catalog.LISTED + [("a.b", "block", 0), ("a.b/x", "allow", 0), ("É.org/é", "block", 0)]
    urls = [
        "http://x.NET/a?b", "https://net/", "http://net", "http://example.net/en/1", "http://a.example.net/en", "http://com/de/", "ftp://q.example.com/de/x#y",
        "http://badexample.com/de/", "http://w.org/fr/é?x", "x://spam-farm.example.org", "://a.b/xy", "http://A.b?x", "http://", "none", "", None, "http://É.org/é/1",
        "http://a.b:80/x", "http://x.net/a?b", "http://a://b.net/c",
    ]
    urls += ["http://" + "a." * 20_000 + "example.net/en/x", "http://" + "." * 3000, "http://net/de/", "http://b.org/fr/" + "p" * 5000]
    rows = [(k % 7 if k != 9 else None, u) for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit("z"), "host": F.lit("z"), "keys": F.lit(1)})
    listed = spark.createDataFrame(entries + [(None, "block", 1), ("q.org", None, 1), ("net/", "allow", 0)], "rule string, verdict string, priority long")
    found = url_filter.filter_urls(pages, listed, most_list_bytes=most)
    want = Counter((i, *judged(u, entries)) for i, u in rows)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert url_filter.filter_urls(pages, listed.limit(0)).where("verdict = 'allow' and rule is null").count() == len(rows)
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_equal_digests_are_told_apart_by_their_strings(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x, seed=0: len(x))
    index = url_filter.DigestArray([("aa", 1), ("bb", 2), ("c", 3)])
    assert index.probe([b"bb", b"aa", b"cc", b"c", b"zzz"]).tolist() == [2, 1, -1, 3, -1]


def test_fixity(spark):
    r = random.Random(1)
    rows = [(k // 40, k, (k % 40) * 100, 90, f"d{k}") for k in range(400)]
    rows += [(3, 900, 300, 90, "d900"), (None, 1, 0, 1, "x"), (2, None, 9000, None, None), (4, 5, 7000, 5, "same"), (4, 5, 7000, 5, "same")]
    other = [list(x) for x in rows]
    for k in r.sample(range(400), 9):
        other[k][4] += "!"
    lost = set(r.sample(range(400), 4))
    other = [tuple(x) for k, x in enumerate(other) if k not in lost and k != 404] + [(20, 1, 0, 5, "new"), (1, 7, 99, 1, "late"), (3, 1, 90_000, 1, "far")]
    schema = "archive long, record_id long, offset long, length long, digest string"
    a, b = (spark.createDataFrame(x, schema).withColumn("node", F.lit(1)) for x in (rows, other))

    def kinds(x, y):
        left, right = (Counter((t[0], t[2], t[3] or 0, t[4] or "") for t in z if t[0] is not None) for z in (x, y))
        out = Counter()
        for at in {k[:2] for k in left | right}:
            mine, yours = (sorted((k[3], k[2]) for k in z.elements() if k[:2] == at) for z in (left, right))
            n = min(len(mine), len(yours))
            out.update({(*at, "altered"): sum(p != q for p, q in zip(mine, yours)), (*at, "missing"): len(mine) - n, (*at, "extra"): len(yours) - n})
        return +out

    for size, fanout in ((1 << 16, 16), (300, 2), (1000, 4)):
        found = fixity.audit(a, b, size, fanout)
        assert Counter((x.archive, x.offset, x.kind) for x in found.collect()) == kinds(rows, other)
        assert fixity.audit(a, a, size, fanout).count() == 0
    assert fixity.audit(a, b.limit(0)).where("kind = 'missing'").count() == fixity.audit(a.limit(0), a).where("kind = 'extra'").count() == len(rows) - 1


@pytest.mark.parametrize("size, fanout, ids", [(1 << 16, 16, True), (500, 2, True), (500, 2, False)])
def test_fixity_of_a_rewritten_replica(spark, size, fanout, ids):
    """Lost, new and altered records at random places; every later offset shifts, and nothing else is reported."""
    r = random.Random(size + fanout)
    content = [[(a, k, r.randint(20, 400), f"digest {a} {k // 2 if k % 10 == 0 else k}") for k in range(300)] for a in range(5)]
    content.append([(5, 0, 7, "same")] * 40)

    def placed(archives):
        out = []
        for archive in archives:
            at = 0
            for a, k, length, digest in archive:
                out.append((a, k if ids else None, at, length, digest))
                at += length
        return out

    want, changed = Counter(), []
    for archive in content:
        offsets, at = [], 0
        for x in archive:
            offsets.append(at)
            at += x[2]
        touched = set(range(5, len(archive), 11)) & set(r.sample(range(len(archive)), len(archive) // 9))
        new, shift = [], 0
        for i, (a, k, length, digest) in enumerate(archive):
            what = r.choice(["missing", "altered", "extra"]) if i in touched and a < 5 else None
            if what == "missing":
                want[a, offsets[i], "missing"] += 1
                shift -= length
                continue
            if what == "extra":
                new.append((a, 1000 + i, 33, f"new {a} {i}"))
                want[a, offsets[i] + shift, "extra"] += 1
                shift += 33
            if what == "altered":
                want[a, offsets[i], "altered"] += 1
                new.append((a, k, length + 5, digest + "!"))
                shift += 5
            else:
                new.append((a, k, length, digest))
        changed.append(new)
    changed[5] = changed[5][:-3]
    want += Counter({(5, 7 * (37 + k), "missing"): 1 for k in range(3)})
    schema = "archive long, record_id long, offset long, length long, digest string"
    a, b = (spark.createDataFrame(placed(x), schema).repartition(3) for x in (content, changed))
    found = [x for x in fixity.audit(a, b, size, fanout).collect()]
    assert Counter((x.archive, x.offset, x.kind) for x in found) == want


def test_moved_records_and_ranges(spark):
    rows = [(0, k, 10 * k, 10, f"d{k}") for k in range(200)]
    order = [*range(50), 51, 50, *range(52, 100), *range(150, 200), *range(100, 150)]
    moved = [(0, k, 10 * i, 10, f"d{k}") for i, k in enumerate(order)]
    a, b = (spark.createDataFrame(x, "archive long, record_id long, offset long, length long, digest string") for x in (rows, moved))
    for size, fanout in ((1 << 20, 16), (100, 2)):
        found = fixity.audit(a, b, size, fanout).collect()
        assert {x.kind for x in found} == {"moved"} and 2 <= len(found) <= 8
        assert fixity.audit(a, a.unionByName(a.limit(0)), size, fanout).count() == 0


def test_only_differing_branches_are_read(spark):
    rows = [(k // 1000, k, 10 * (k % 1000), 10, f"d{k}") for k in range(4000)]
    other = [x for x in rows if x[1] != 1500]
    a, b = (spark.createDataFrame(x, "archive long, record_id long, offset long, length long, digest string") for x in (rows, other))
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    ranged, levels = fixity.trees(both, 100, 4)
    leaves = {s: Counter(x.hash for x in levels[0].where(F.col("side") == s).collect()) for s in (0, 1)}
    assert sum((leaves[0] - leaves[1]).values()) <= 3 and sum(leaves[0].values()) > 250 and len(levels) > 2


def test_records_of_pages_without_ids(spark):
    pages = spark.createDataFrame([(None, None, None), (None, "u", None), (1, "u", "é"), (1, "u", "é")], "page_id long, url string, html string")
    found = fixity.warc_records(pages).collect()
    assert sorted((x.record_id or -1, x.offset, x.length) for x in found)[2:] == [(1, 0, 6), (1, 6, 6)] and all(x.archive < 0 for x in found if x.record_id is None)


@pytest.mark.parametrize("segments", [None, 2, 5])
def test_top_k(spark, segments):
    r = np.random.default_rng(4)
    codes = [int(x) for x in r.integers(-(1 << 63), (1 << 63) - 1, 150)]
    codes += [codes[0]] * 30 + [codes[1] ^ (1 << int(b)) for b in r.integers(0, 63, 20)] + [~codes[2]]
    rows = list(enumerate(codes)) + [(3, codes[9]), (7, codes[7]), (None, 1), (999, None)]
    frame = spark.createDataFrame(rows, "vec_id long, code long").withColumn("key", F.lit(1))
    queries = frame.where("vec_id % 10 = 0 or vec_id = 3")
    got = {(x.query_id, x.rank): (x.distance, x.vec_id) for x in topk.top_k(frame, queries, 6, segments=segments).collect()}
    want = {}
    known = [x for x in rows if None not in x]
    for q in {v for v, _ in known if v % 10 == 0 or v == 3}:
        best = {}
        for v, c in known:
            for w, d in known:
                if v == q and w != q:
                    n = ((c ^ d) & (2**64 - 1)).bit_count()
                    best[w] = min(best.get(w, 99), n)
        for k, (n, w) in enumerate(sorted((n, w) for w, n in best.items())[:6], 1):
            want[q, k] = (n, w)
    assert got == want
    few = frame.where("vec_id in (5, 6)")
    assert topk.top_k(few, few, 6).count() == 2 and topk.top_k(few.limit(0), few.limit(0)).count() == 0


def test_codes(spark):
    frame = spark.createDataFrame([(1, [0.5, -1.0, None, 2.0]), (2, None), (3, []), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert {x.vec_id: x.code for x in topk.sign_codes(frame).collect()} == {1: 9, 2: 0, 3: 0, None: -1}


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(-1, "123 456", "en", "s", 7), (-2, None, None, None, None), (-3, "The password=hunter2222 of the house is that", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    bench = [(x.item_id, x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "best_fit_packing":
            assert Counter(tuple(x)[:5] for x in out.collect()) == Counter(brute.pieces(left))
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        got = {x.doc_id: x.text for x in docs.collect()}
        if name == "language_id":
            assert set(got) == {d for d, t in left if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert set(got) == {d for d, _, c in brute.components(left) if d == c}
        elif name == "decontamination":
            assert set(got) == {x[0] for x in brute.contaminated(left, bench) if not x[-1]}
        else:
            assert set(got) == {d for d, _ in left}
            assert not any(sum(x[1:4]) for x in brute.secrets(list(got.items())) if got[x[0]] == dict(left)[x[0]])
            assert any(t != got[d] for d, t in left)
        left = list(got.items())
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, folder).count() > 0
