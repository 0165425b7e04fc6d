"""Plain Python forms of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    import xxhash

    words = WORDS.findall(ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """{index: (fingerprint hex, smallest id)} of (id, text) rows."""
    fps = [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for i, f in enumerate(fps):
        if f in first:
            parent[root(i)] = root(first[f])
        first.setdefault(f, i)
    distinct = list(first)
    for a, x in enumerate(distinct):
        for y in distinct[a + 1 :]:
            if (x ^ y).bit_count() <= 4:
                parent[root(first[x])] = root(first[y])
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, f"{fps[i]:016x}", low.get(root(i))) for i, (d, _) in enumerate(rows)]


def repeats(rows, window=13):
    first = {}
    split = [WORDS.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None and (key not in first or d < first[key]):
                first[key] = d
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            f = first.get(tuple(w[i : i + window]))
            if f is not None and (d is None or f < d):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contaminated(rows, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        w = LETTERS.findall(ascii_lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in rows:
        w = LETTERS.findall(ascii_lower(text))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[key]
        found.discard(None)  # an item without an id hits words only
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), sum(hit), len(found), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def secrets(rows):
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    out = []
    for d, text in rows:
        found = [(m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in p.finditer(text or "") if ok(m)]
        spans = ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))
        counts = [sum(x[2] == name for x in found) for name in kinds]
        out.append((d, *counts, hashlib.sha256(spans.encode()).hexdigest()))
    return out


def pieces(rows, size=2048):
    """(id, piece, start, length, crc) of every piece."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % size
        cuts = ([0] if head else []) + list(range(head, len(ids), size)) + [len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def runs(words, min_length=24, min_exponent=3):
    """(start, length, smallest period) of the maximal periodic stretches, every period tried."""
    found = {}
    for period in range(1, len(words) // min_exponent + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - start + period >= max(min_length, min_exponent * period):
                found.setdefault((start, end - start + period), period)
            start = max(end, start + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def planted_periods(doc_id, text):
    words = WORDS.findall(text or "")
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic(doc_id, text):
    """The contract's row of one document."""
    words = planted_periods(doc_id, text)
    own = runs(words)
    gone = {i for start, length, period in own for i in range(start + period, start + length)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(own, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(own), *told, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def kept_lines(rows, min_documents, keep_first=False, min_chars=1):
    """(id, lines, dropped, kept text) of (id, text) rows."""
    split = [(d, (t or "").split("\n")) for d, t in rows]
    keys = [[ascii_lower(x.strip(" \t\n\v\f\r")) for x in lines] for _, lines in split]
    documents = Counter(k for own in keys for k in set(own) if len(k) >= min_chars)
    often = {k for k, n in documents.items() if n >= min_documents}
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).digest())
    first = {}
    for i in sorted(range(len(rows)), key=order, reverse=True):
        for place in range(len(keys[i]) - 1, -1, -1):
            first[keys[i][place]] = (order(i), place)
    out = []
    for i, (d, lines) in enumerate(split):
        kept = [x for p, (x, k) in enumerate(zip(lines, keys[i])) if k not in often or (keep_first and first[k] == (order(i), p))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def divergence(rows, min_documents=3, top=200):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, every word of every pair."""
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = terms.findall(ascii_lower(text))
        counts[lang or "", source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = []
    for lang in documents:
        kept = [t for t, n in documents[lang].items() if n >= min_documents]
        groups = {source: c for (of, source), c in counts.items() if of == lang}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}

        every = {source: shares(c) for source, c in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        for source, p in every.items():
            pairs = [(sum(f(p[t], q[t]) for t in kept), item) for item, q in every.items() if item != source]
            told = [(f(p[t], whole[t]), t) for t in kept if groups[source][t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", told)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return out
