"""Secret scan: exact patterns, and a small convolutional network over every other candidate and its context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.shared import stored

#: Kinds in the order of the output; patterns of the exact findings and the shortest accepted length.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: What the network judges: words of 16 and more key characters that hold a digit.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Exact findings in code points, end exclusive, per kind leftmost and not overlapping.

    Runs of hex digits are maximal, so the short ones can be left out of the search; the other two kinds are searched
    only in texts that hold their fixed characters.
    """
    out: list[Span] = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def apart(found: list[tuple[int, int]], base: list[Span]) -> list[bool]:
    """Whether each candidate (in order, not overlapping) touches no finding; both lists are passed once."""
    out, k, reach = [], 0, 0
    for a, b in found:
        while k < len(base) and base[k][1] < b:
            reach = max(reach, base[k][2])
            k += 1
        out.append(reach <= a)
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    if not any(c in text for c in "0123456789"):
        return []
    return [m.span() for m in CANDIDATE.finditer(text)]


CONTEXT, VALUE = 24, 64


def windows(text: str, begin: int, end: int) -> list[str]:
    """The candidate in windows of 64 characters, each with 24 characters before and after it; none is left out."""
    cuts = [*range(begin, end, VALUE)]
    return [text[max(0, a - CONTEXT) : a].rjust(CONTEXT, "\0") + text[a : min(a + VALUE, end)].ljust(VALUE, "\0") + text[(e := min(a + VALUE, end)) : e + CONTEXT].ljust(CONTEXT, "\0") for a in cuts]


def encoded(rows: list[str]) -> np.ndarray:
    """Character classes: ASCII as it is, all other characters as 1."""
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), -1)
    return np.where(points < 128, points, 1).astype(np.int64)


WEIGHTS = ("embed", "filters", "bias", "out", "spread")


@dataclass
class Network:
    """Character embedding, one convolution, maximum and mean over places, logistic output; all numpy.

    The maximum tells that a feature occurs, the mean how much of the window shows it.
    """

    embed: np.ndarray
    filters: np.ndarray  # width x embedding, filters
    bias: np.ndarray
    out: np.ndarray
    spread: np.ndarray  # weights of the means
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1
    held_recall: float = float("nan")  # of the calibration rows at the threshold
    held_precision: float = float("nan")
    windows: tuple[int, int] = (0, 0)  # of the corpus: learned from, held out for calibration and threshold

    @staticmethod
    def new(seed: int = 7, size: int = 12, width: int = 5, filters: int = 24) -> Network:
        r = np.random.default_rng(seed)
        return Network(
            r.normal(0, 0.3, (128, size)), r.normal(0, (width * size) ** -0.5, (width * size, filters)), np.zeros(filters), r.normal(0, 0.3, filters), np.zeros(filters), 0.0
        )

    def forward(self, x: np.ndarray) -> tuple:
        width = len(self.filters) // self.embed.shape[1]
        e = self.embed[x]
        n = x.shape[1] - width + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(width)], axis=2)
        h = cols @ self.filters + self.bias
        at = h.argmax(axis=1)
        top = np.take_along_axis(h, at[:, None, :], 1)[:, 0]
        above = np.maximum(h, 0)
        return cols, at, top, above, np.maximum(top, 0) @ self.out + above.mean(axis=1) @ self.spread + self.out_bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[k : k + 256])[-1] for k in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -40, 40)))

    def packed(self) -> np.ndarray:
        return np.concatenate([*(getattr(self, k).ravel() for k in WEIGHTS), [self.out_bias]])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for k in WEIGHTS:
            old = getattr(self, k)
            setattr(self, k, values[at : at + old.size].reshape(old.shape))
            at += old.size
        self.out_bias = float(values[at])

    def learn(self, x: np.ndarray, y: np.ndarray, moments: np.ndarray, step: float, r: np.random.Generator, rate: float) -> tuple[np.ndarray, float]:
        """One pass of Adam on the logistic loss over the rows, classes weighed alike; the embedding learns through the maxima only.

        ``moments`` are the two running means of the gradient (rows) for all weights but the last; both and the steps are returned.
        """
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        size = self.embed.shape[1]
        width = len(self.filters) // size
        for rows in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
            xs, ys, ws = x[rows], y[rows], weight[rows]
            cols, at, top, above, z = self.forward(xs)
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - ys) * ws / len(rows)
            g = {"out": np.maximum(top, 0).T @ d, "spread": above.mean(axis=1).T @ d}
            wide = (above > 0) * (d[:, None] * self.spread / above.shape[1])[:, None, :]
            dtop = d[:, None] * self.out * (top > 0)
            picked = np.take_along_axis(cols, at[:, :, None], 1)
            g["filters"] = np.einsum("bf,bfc->cf", dtop, picked) + cols.reshape(-1, cols.shape[2]).T @ wide.reshape(-1, wide.shape[2])
            g["bias"] = dtop.sum(axis=0) + wide.sum(axis=(0, 1))
            g["embed"] = np.zeros_like(self.embed)
            back = np.einsum("bf,cf->bfc", dtop, self.filters).reshape(len(rows), -1, width, size)
            for k in range(width):
                np.add.at(g["embed"], np.take_along_axis(xs, at + k, 1), back[:, :, k])
            step += 1
            slope = np.concatenate([g[k].ravel() for k in WEIGHTS])
            moments = moments + np.array([[0.1], [0.001]]) * (np.stack([slope, slope**2]) - moments)
            move = moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            self.unpack(self.packed() - rate * np.append(move, d.sum()))
        return moments, step

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out logits with their counts, and the highest threshold that finds at least ``recall`` of their secrets."""
        positives, negatives = float(n[y == 1].sum()), float(n[y == 0].sum())
        target = np.where(y == 1, (positives + 1) / (positives + 2), 1 / (negatives + 2))

        def loss(slope: float, shift: float) -> float:
            return float((n * (np.logaddexp(0, slope * z + shift) - target * (slope * z + shift))).sum())

        def probability() -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))

        for _ in range(50):
            p = probability()
            w = n * np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, np.array([(n * (p - target) * z).sum(), (n * (p - target)).sum()]))
            while np.abs(step).max() >= 1e-8 and loss(self.slope - step[0], self.shift - step[1]) > loss(self.slope, self.shift):
                step = step / 2  # a whole step can leave the range where the loss falls
            self.slope, self.shift = self.slope - step[0], self.shift - step[1]
            if np.abs(step).max() < 1e-8:
                break
        p = probability()
        order = np.flatnonzero(y == 1)
        order = order[np.argsort(p[order], kind="stable")]
        lost = np.cumsum(n[order]) > (1 - recall) * positives  # from here on the secrets found are enough
        self.threshold = float(p[order[lost.argmax()]]) if len(order) else 1.1
        found = p >= self.threshold
        if found.any():
            self.held_recall, self.held_precision = float(n[found & (y == 1)].sum() / positives), float(n[found & (y == 1)].sum() / n[found].sum())


SHAPES = ("AKIA{16:ABCDEFGHIJKLMNOPQRSTUVWXYZ234567}", "ghp_{36:aA0}", "sk-{40:aA0}", "xoxb-{12:0}-{24:aA0}", "eyJ{40:aA0}", "{40:aA0+/}", "{32:h}", "{40:h}", "glpat-{20:aA0}", "npm_{36:aA0}")
PLAIN = ("{16:0}", "{4:0}-{2:0}-{2:0}T{6:0}", "+{2:0}-{3:0}-{4:0}-{4:0}", "/{6:a}/{8:a}/{4:0}/{6:a}", "{8:a}-{6:a}-{2:0}-{7:a}", "{12:a}{2:0}{5:a}", "{6:a}_{6:a}_{4:0}", "{18:0}", "{10:a}={8:0}", "{8:h}-{4:h}-{4:h}-{4:h}-{12:h}", "{8:a}{8:A}{2:0}", "{6:a}{1:A}{6:a}{1:A}{5:a}{1:0}", "{3:A}-{6:0}-{4:A}-{2:0}", "{9:a}.{7:a}.{6:a}{1:A}{7:a}")


def made(shape: str, r: np.random.Generator) -> str:
    sets = {"a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789", "h": "0123456789abcdef"}

    def fill(m: re.Match) -> str:
        pool = sets[m[2]] if m[2] in sets else "".join(sets.get(c, c) for c in m[2]) if m[2][0] in sets else m[2]
        return "".join(r.choice(list(pool), int(m[1])))

    return re.sub(r"\{(\d+):([^}]+)\}", fill, shape)


#: Known key formats inside a candidate; a bare run of 40 characters counts if it has small letters, capitals and digits.
KEY = re.compile(r"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10}|eyJ[A-Za-z0-9_-]{17})")
RUN = re.compile(r"[A-Za-z0-9+/]{40,}")


def key_shaped(value: str) -> bool:
    return bool(KEY.search(value)) or any(all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")) for m in RUN.finditer(value))


#: Corpus windows of a shard, about: what one task learns from at a time.
SHARD = 4096
EPOCHS = 12


def rate(epoch: int) -> float:
    """Of learning; it falls, so that the shards' weights come together and the last rows seen do not weigh most."""
    return 0.01 * (1 - epoch / EPOCHS)


def train(documents: DataFrame, text_col: str = "text", most: int = 2000, recall: float = 0.98) -> Network:
    """Fits the network on the labelled windows of all candidates, and on ``most`` windows written by shape.

    A window whose part of the candidate touches an exact finding is a secret, any other of the corpus is not, save that
    candidates of a known key format teach nothing; the written ones follow published key formats or everyday numbers,
    codes, identifiers, names and paths, set between the surroundings of some corpus windows. Each distinct window counts
    once. Four of five windows are learned from: they are dealt by hash into shards, each pass goes over every shard (the
    written ones are in each) from the same weights, and the mean of the weights it ends with starts the next pass. The
    fifth ones set calibration and threshold, by counts of their logits in steps of a thousandth; the written ones weigh at least
    half as much as the corpus there, class by class. A candidate is judged by its most suspicious window, so the recall
    of whole candidates is that of windows at least. Null and empty texts have no candidate; an empty table leaves the
    written shapes to learn from.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if text and (found := candidates(text)):
                    base = base_spans(text)
                    for (a, b), alone in zip(found, apart(found, base)):
                        if alone and key_shaped(text[a:b]):
                            continue
                        parts = [(k, min(k + VALUE, b)) for k in range(a, b, VALUE)]
                        clean = [True] * len(parts) if alone else apart(parts, base)
                        rows += [(w, int(not c)) for w, c in zip(windows(text, a, b), clean, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["window", "secret"]
            )

    found = documents.select(text_col).mapInArrow(kernel, "window string, secret int")
    order, place = F.xxhash64("window"), F.xxhash64("window", F.lit(1))
    distinct = stored(found.groupBy("window").agg(F.max("secret").alias("secret")))
    rows = distinct.select((F.pmod(order, F.lit(5)) == 4).alias("held"), "secret", place.alias("place"), "window")
    counts = {(x.held, x.secret): x.n for x in rows.groupBy("held", "secret").agg(F.count("*").alias("n")).collect()}
    n_shards = max(1, -(-sum(counts.values()) // SHARD))
    tasks = min(n_shards, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("shard", F.pmod("place", F.lit(n_shards))).repartition(tasks, "shard")
    dealt = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("place", "window", "secret", "held"))).alias("rows"))
    shards = stored(dealt.select("shard", "rows.window", "rows.secret", "rows.held"))
    some = [distinct.where(F.col("secret") == s).orderBy(order, "window").limit(most).select("window") for s in (0, 1)]
    written, labels, aside = written_windows([x.window for x in some[0].unionByName(some[1]).collect()], most)
    network = Network.new()
    moments, step = np.zeros((2, len(network.packed()) - 1)), 0.0
    for epoch in range(EPOCHS):
        if not counts:
            moments, step = network.learn(written[~aside].astype(np.int64), labels[~aside], moments, step, np.random.default_rng([11, epoch]), rate(epoch))
            continue
        ends = shards.mapInArrow(_pass(network, moments, step, written[~aside], labels[~aside], epoch), "place int, value double")
        values = F.array_sort(F.collect_list("value"))  # one from each shard; added in order, so that every run gives the same
        mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values)
        ended = np.array([x.value for x in ends.groupBy("place").agg(mean.alias("value")).orderBy("place").collect()])
        size = len(network.packed())
        network.unpack(ended[:size])
        moments, step = ended[size:-1].reshape(2, -1), float(ended[-1])
    seen = shards.mapInArrow(_held_logits(network), "at long, secret int").groupBy("at", "secret").agg(F.count("*").alias("n"))
    rows = [(x["at"] / 1000, x.secret, x.n) for x in seen.orderBy("at", "secret").collect()]
    z = network.logits(written[aside].astype(np.int64))
    for label in (0, 1):
        own = z[labels[aside] == label]
        rows += [(v, label, max(1.0, counts.get((True, label), 0) / 2 / max(len(own), 1))) for v in own]
    network.calibrate(*(np.array(v, float) for v in zip(*rows)), recall)
    network.windows = tuple(sum(n for (held, _), n in counts.items() if held == kept) for kept in (False, True))
    return network


def written_windows(around: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Encoded windows of published key formats (1) and of everyday strings (0), alone or between surroundings of ``around``.

    The third array tells which are held out: every fifth of each shape.
    """
    r = np.random.default_rng(5)
    around = around or ["\0" * (2 * CONTEXT + VALUE)]
    rows = []
    for shapes, label in ((SHAPES, 1), (PLAIN, 0)):
        for k in range(most // 2):
            value = made(shapes[k % len(shapes)], r)
            other = around[int(r.integers(len(around)))]
            before, after = (" " * CONTEXT, " " * CONTEXT) if k % 3 == 0 else (re.sub(r"\S*$", "", other[:CONTEXT]).rjust(CONTEXT), " " + other[-CONTEXT + 1 :])
            rows += [(w, label, k // len(shapes) % 5 == 4) for w in windows(before + value + after, CONTEXT, CONTEXT + len(value))]
    text, labels, aside = zip(*rows)
    return encoded([*text]).astype(np.uint8), np.array(labels, float), np.array(aside)


def _pass(network: Network, moments: np.ndarray, step: float, written: np.ndarray, labels: np.ndarray, epoch: int):
    """Kernel over shards: the weights, moments and steps after one pass over each, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                own = [k for k, held in enumerate(shard["held"]) if not held]
                x = written.astype(np.int64)
                if own:
                    x = np.concatenate([encoded([shard["window"][k] for k in own]), x])
                y = np.concatenate([[float(shard["secret"][k]) for k in own], labels])
                after = replace(network)
                ended = after.learn(x, y, moments, step, np.random.default_rng([11, epoch, shard["shard"]]), rate(epoch))
                values = np.concatenate([after.packed(), ended[0].ravel(), [ended[1]]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["place", "value"])

    return run


def _held_logits(network: Network):
    """Kernel over shards: logits of the windows held out, rounded down to a thousandth, and their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                held = [k for k, held in enumerate(shard["held"]) if held]
                if held:
                    z = network.logits(encoded([shard["window"][k] for k in held]))
                    at = np.floor(np.clip(z, -40, 40) * 1000).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([shard["secret"][k] for k in held], pa.int32())], ["at", "secret"])

    return run


def all_spans(texts: list[str], network: Network | None) -> list[list[Span]]:
    """Exact findings of each text and the candidates apart from them that the network calls secret."""
    out, asked, owner = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append(base)
        found = candidates(text) if network is not None else []
        for (a, b), alone in zip(found, apart(found, base)):
            if alone:
                for w in windows(text, a, b):
                    asked.append(w)
                    owner.append((k, a, b))
    if asked:
        p = network.probability(encoded(asked))
        hits = {owner[i] for i in np.flatnonzero(p >= network.threshold)}
        for k, a, b in hits:
            out[k] = [*out[k], ("model", a, b)]
        for k in {h[0] for h in hits}:
            out[k] = ordered(out[k])
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", network: Network | None = None) -> DataFrame:
    """Per row: doc_id, findings (kind, start, end), n_assign, n_access, n_hex, n_model, base_sha256, spans.

    A null text is read as empty and has none. Whole texts are searched, positions are code points. Rows that repeat
    are judged each. Without a network only exact findings are given. Other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans(batch.column(1).fill_null("").to_pylist(), network)
            base = [[s for s in spans if s[0] != "model"] for spans in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column(0), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in x] for x in found], kind)]
            columns += [pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in KINDS]
            columns += [pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in found])]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, findings array<struct<kind:string,start:long,end:long>>, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"
    names = ["doc_id", "findings", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, schema)


def redact(text: str, spans: list[Span]) -> str:
    """Each joint stretch of findings becomes ``[kind]`` of its first one."""
    out, at = [], 0
    stretches: list[list] = []
    for kind, a, b in spans:
        if stretches and a < stretches[-1][2]:
            stretches[-1][2] = max(b, stretches[-1][2])
        else:
            stretches.append([kind, a, b])
    for kind, a, b in stretches:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(documents: DataFrame, text_col: str = "text", network: Network | None = None) -> DataFrame:
    """The documents with every finding replaced; texts without one, nulls and all other columns stay as they are."""
    at = documents.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = column.to_pylist()
            found = all_spans([t or "" for t in texts], network)
            clean = pa.array([redact(t, s) if s else t for t, s in zip(texts, found)], column.type)
            yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return documents.mapInArrow(kernel, documents.schema)
