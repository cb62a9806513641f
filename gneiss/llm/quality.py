"""Quality classifier by positive-unlabelled learning: trusted positives against unlabelled web text, an estimated class
prior, and the non-negative unbiased risk, minimised by a small network.

Each text is read once, whole, and becomes a vector of TRAITS numbers that do not grow with it; all else works on those."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_batch, settle

#: Documents that a fit learns from at most: trusted positives, and unlabelled ones (their labels, if any, are not looked at).
POSITIVES, UNLABELLED = 4_000, 8_000
THRESHOLD = 0.3
HIDDEN, STEPS, RATE, DECAY = 16, 800, 5e-3, 1e-3
#: Bins of the scores from which the class prior is estimated.
BINS = 1_000
#: Kinds of bytes: what they are in ASCII, and all beyond it. Digits, letters by case, white space, and groups of signs.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "'\"`", "()[]{}<>", "#$%&*|~^\\/_=+@-")
_KIND = np.full(256, len(KINDS), np.uint8)
for _n, _chars in enumerate(KINDS):
    _KIND[list(_chars.encode())] = _n
K = len(KINDS) + 1
WORD_TRAITS = 14
TRAITS = WORD_TRAITS + K + K * K
BLOCK = 1 << 20


def traits(text: str) -> np.ndarray:
    """The vector of a text: how words and lines repeat, their case and length, shares of kinds of bytes and of pairs of
    kinds. All but the number of words are shares, means or logarithms. An empty text: all 0."""
    out = np.zeros(TRAITS, np.float32)
    if not text:
        return out
    data = text.encode("utf-8", "replace")
    pairs = np.zeros(K * K, np.int64)
    for start in range(0, len(data), BLOCK):
        kind = _KIND[np.frombuffer(data, np.uint8, min(BLOCK + 1, len(data) - start), start)].astype(np.int32)
        if len(kind) > 1:
            pairs += np.bincount(kind[:-1] * K + kind[1:], minlength=K * K)
    single = pairs.reshape(K, K).sum(1)
    single[_KIND[data[-1]]] += 1
    words, lines = text.split(), text.split("\n")
    n = len(words)
    if n:
        counts, two = Counter(words), len(set(zip(words, words[1:])))
        sizes = np.fromiter(map(len, words), np.float64, n)
        out[:10] = (
            math.log1p(n), 1 - len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - (two + 1) / n,
            sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, sum(map(str.isalpha, words)) / n, math.log1p(sizes.mean()), math.log1p(sizes.std()),
        )
    out[10:14] = 1 - len(set(lines)) / len(lines), math.log1p(len(lines)), math.log1p(len(text) / len(lines)), sum(not x.strip() for x in lines) / len(lines)
    out[WORD_TRAITS : WORD_TRAITS + K] = np.sqrt(single / len(data))
    out[WORD_TRAITS + K :] = np.sqrt(pairs / max(1, len(data) - 1))
    return out


@dataclass
class Net:
    """One hidden layer; the output is the log-odds of a positive."""

    middle: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray] = field(default_factory=list)  # first weights and bias, last weights and bias

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.parts
        return np.tanh(self.ready(x) @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 13, steps: int = STEPS) -> Net:
    """Minimise a risk with the logistic loss, by Adam on random batches; the result is the mean of the later weights.

    prior given: the non-negative unbiased risk  prior * R+(P) + max(0, R-(U) - prior * R-(P)). Where the second part is
    below 0, the step goes up its slope in place of down the whole's, so the fit does not chase a negative risk.
    prior None: positives against unlabelled ones, each side as heavy as the other."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = Net(both.mean(0), both.std(0) + 1e-3)
    p, u = net.ready(positive), net.ready(unlabelled)
    start = rng.normal(0, 1 / math.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)
    parts = [x.astype(np.float32) for x in start]
    first, second, mean, meant = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts], 0
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), min(256, len(p)))], u[rng.integers(0, len(u), min(512, len(u)))]
        x = np.concatenate([a, b])
        h = np.tanh(x @ parts[0] + parts[1])
        z = h @ parts[2] + parts[3][0]
        up = _sigmoid(z)  # slope of the loss of a negative; that of a positive is up - 1
        n, m = len(a), len(b)
        if prior is None:
            slope = np.concatenate([(up[:n] - 1) / n, up[n:] / m]) / 2
        else:
            negative = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
            of_negatives = np.concatenate([-prior * up[:n] / n, up[n:] / m])
            slope = of_negatives + np.concatenate([prior * (up[:n] - 1) / n, np.zeros(m)]) if negative >= 0 else -of_negatives
        slope = slope.astype(np.float32)
        back = np.outer(slope, parts[2]) * (1 - h * h)
        slopes = [x.T @ back + DECAY * parts[0], back.sum(0), h.T @ slope + DECAY * parts[2], np.array([slope.sum()])]
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, g in enumerate(slopes):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            parts[i] -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        if 2 * t > steps:
            meant += 1
            for i, x in enumerate(parts):
                mean[i] += (x - mean[i]) / meant
    net.parts = mean
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float = 0.1) -> float:
    """The share of positives among the unlabelled, from counts of both by bin of a score that tells them apart.

    Above a score that hardly a negative reaches, the unlabelled are thinner than the positives by the prior. So it is the
    ratio of what lies above a score, at the score where the ratio and the error of its estimate are least together."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    error = (1 + risk) * (math.sqrt(math.log(4 / risk) / (2 * n_p)) + math.sqrt(math.log(4 / risk) / (2 * n_u)))
    there = above_p > 0
    best = np.argmin((above_u[there] + error) / above_p[there])
    return float(np.clip(above_u[there][best] / above_p[there][best], 0.01, 0.99))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is not learned from: crc32 of doc_id as text can be divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def vectors(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs without the text but with `traits`, TRAITS half-precision numbers. Null text: as an empty one."""
    name, docs = f"{prefix}traits", docs.drop(f"{prefix}traits")
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([traits(t.as_py() or "").astype(np.float16).tobytes() for t in batch.column(at)], pa.binary())
        return pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], x], [*[c for c in batch.schema.names if c != text], name])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != text)
    return by_batch(docs, run, f"{kept}{name} binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), np.float16).astype(np.float32).reshape(-1, TRAITS)


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most `most` of the vectors of rows (_key, traits; a row per document), those with the least keys. Rows are thinned
    by their key to about twice as many first, so the driver and the last task of the sort see no more."""
    n = rows.count()
    part = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    thin = rows.where(part <= min(1.0, (2 * most + 100) / max(1, n)))
    return _matrix(r[0] for r in thin.orderBy("_key", "traits").limit(most).select("traits").collect())


@dataclass
class Model:
    prior: float
    net: Net | None


def learn(found: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """found: doc_id and traits, a settled table. labels: doc_id, quality; only labels of 1 are used, and none of held-out rows.

    Trusted are documents all of whose labels are 1. The unlabelled are all documents that are not held out, whatever their
    labels. Each document counts once, by the least of its vectors. The prior is estimated on all of them: two classifiers
    are fitted, each on a half of the documents (by a digest of doc_id), and count the scores of the other half. Without a
    trusted document: a model without a network."""
    name = F.col(doc_id).cast("string")
    rows = found.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(name.alias("_id"), "traits")
    rows = rows.groupBy("_id").agg(F.min("traits").alias("traits")).withColumn("_key", F.md5("_id"))
    told = labels.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(name.alias("_id")).agg(F.min(quality).alias("_q"), F.max(quality).alias("_r"))
    trusted = told.where((F.col("_q") == 1) & (F.col("_r") == 1)).select("_id", F.lit(True).alias("_trusted"))
    pool = settle(rows.join(trusted, "_id", "left").select("_key", "traits", F.coalesce("_trusted", F.lit(False)).alias("_trusted"), (F.conv(F.substring("_key", 9, 1), 16, 10).cast("int") % 2).alias("_half")), "pool")
    halves = [(_sample(pool.where(F.col("_trusted") & (F.col("_half") == h)), positives // 2), _sample(pool.where(F.col("_half") == h), unlabelled // 2)) for h in (0, 1)]
    if not all(len(p) and len(u) for p, u in halves):
        p, u = (np.concatenate([h[i] for h in halves]) for i in (0, 1))
        return Model(0.5, fit(p, u, 0.5) if len(p) else None)
    nets = [fit(p, u, None) for p, u in halves]
    held = pool.sparkSession.sparkContext.broadcast(nets)  # two small networks

    def bins(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, half = _matrix(v.as_py() for v in batch.column(0)), batch.column(2).to_numpy()
        scores = np.where(half == 0, held.value[1].score(x), held.value[0].score(x))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(scores * BINS, BINS - 1).astype(np.int32)), batch.column(1)], ["bin", "trusted"])

    counts = by_batch(pool.select("traits", "_trusted", "_half"), bins, "bin int, trusted boolean").groupBy("bin").agg(F.count(F.lit(1)), F.count(F.when(F.col("trusted"), 1))).collect()
    of_all, of_trusted = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for b, n, p in counts:
        of_all[b], of_trusted[b] = n, p
    prior = class_prior(of_trusted, of_all)
    return Model(prior, fit(np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves]), prior))


def score(found: DataFrame, model: Model, prefix: str = "", threshold: float = THRESHOLD) -> DataFrame:
    """found (with traits) with score, the chance that quality is 1, and predicted, 1 from the threshold on. A model without
    a network: score 0.5."""
    held = found.sparkSession.sparkContext.broadcast(model)
    names = (f"{prefix}score", f"{prefix}predicted")
    found = found.drop(*names)
    at = found.columns.index(f"{prefix}traits")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(v.as_py() for v in batch.column(at))
        scores = held.value.net.score(x).astype(np.float64) if held.value.net else np.full(len(x), 0.5)
        return pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*[c for i, c in enumerate(batch.schema.names) if i != at], *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for i, f in enumerate(found.schema) if i != at)
    return by_batch(found, run, f"{kept}{names[0]} double, {names[1]} int")


def rate_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of docs.

    The score is made from the text alone. Null or empty text: the score of an empty text. Null doc_id: scored, not held
    out, not learned from. Repeated rows: one score each, alike; a document's labels count once, and not at all where they
    differ. Null labels are none. Empty docs: no rows. Empty labels: every score 0.5. Other columns take no part."""
    found = settle(vectors(docs.select(doc_id, text), text), "traits")
    model = learn(found, labels, doc_id, quality, positives, unlabelled)
    return score(found, model, threshold=threshold).select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", "predicted")
