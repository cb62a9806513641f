"""Language ID by error-correcting output codes: binary n-gram classifiers predict the bits of language codewords;
loss-weighted decoding chooses the nearest codeword and flags ambiguity."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import by_batch

#: Hashed n-gram features of the lower-cased UTF-8 text.
ORDERS = (2, 3, 4)
DIMS = 8192
#: Documents of one language that the classifiers learn from at most (chosen by md5 of doc_id).
PER_LANGUAGE = 250
#: Two best codewords whose scores differ by less than this are ambiguous.
MARGIN = 0.1
UNKNOWN = "und"
CHUNK = 1 << 20
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)  # odd numbers that spread the n-grams


def _counts(data: bytes) -> np.ndarray:
    """Hashed n-gram counts of a whole text; blocks overlap by the longest n-gram less one byte."""
    total = np.zeros(DIMS, np.int64)
    most = max(ORDERS)
    shift = 32 - DIMS.bit_length() + 1
    for start in range(0, max(1, len(data)), CHUNK):
        x = np.frombuffer(data[start : start + CHUNK + most - 1], np.uint8).astype(np.uint32)
        gram = x
        for n in range(2, most + 1):
            if len(x) < n:
                break
            gram = (gram[: len(x) - n + 1] << np.uint32(8)) | x[n - 1 :]
            if n in ORDERS:
                own = gram[:CHUNK]
                total += np.bincount((own * np.uint32(_MULTIPLIERS[n % 3])) >> np.uint32(shift), minlength=DIMS)
    return total


def features(text: str) -> np.ndarray:
    """Square roots of n-gram frequencies: a vector of length 1, or 0 for a text without any."""
    counts = _counts(text.lower().encode())
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 per language: all ways to part up to 7 languages in two, beyond that random columns, the set of
    100 with the farthest nearest pair. No column is constant."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    rng, bits, best, far = np.random.default_rng(8), int(10 * np.ceil(np.log2(n))), None, -1.0
    for _ in range(100):
        code = rng.choice((-1.0, 1.0), (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1
        apart = (bits - code @ code.T) / 2
        near = apart[~np.eye(n, dtype=bool)].min()
        if near > far:
            best, far = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMS x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each codeword: the weighted mean logistic loss of its bits against the classifiers' margins."""
        margins = x @ self.weights + self.bias
        each = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (each * self.trust).sum(2)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, that of the next, and the scores of all (they sum to 1)."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.zeros(len(x), int), np.ones((len(x), 1))
        loss = self.losses(x)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        order = np.argsort(loss, axis=1, kind="stable")
        return order[:, 0], order[:, 1], odds / odds.sum(1, keepdims=True)


def fit(x: np.ndarray, labels: list[str], rounds: int = 400, ridge: float = 1e-4) -> Model:
    """One logistic classifier per bit, all fitted at once by accelerated gradient steps on the weights.

    Memory and time follow examples x DIMS, whatever the number of languages. Rows of x have length 1 or 0."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    index = np.searchsorted(np.array(languages), np.array(labels))
    target = code[index]
    per = 1.0 / np.bincount(index)[index]  # each language counts alike
    per = per / per.sum()
    used = np.flatnonzero(x.any(0))  # n-grams that no example has stay at 0
    x = np.column_stack([x[:, used], np.ones(len(x), x.dtype)])  # the last is the bias
    weights = np.zeros((x.shape[1], target.shape[1]), x.dtype)
    look = weights
    step = 1.0 / (0.25 * 2 + ridge)  # the weighted Gram matrix has no eigenvalue above a row's squared length, 2 at most
    for t in range(rounds):
        slope = -target * (per[:, None] / (1 + np.exp(np.clip(target * (x @ look), -500, 500))))
        fresh = look - np.asarray(step, x.dtype) * (x.T @ slope.astype(x.dtype) + np.asarray(ridge, x.dtype) * look)
        look = fresh + np.asarray(t / (t + 3), x.dtype) * (fresh - weights)
        weights = fresh
    right = (x @ weights * target > 0).astype(float)
    error = np.clip((per[:, None] * (1 - right)).sum(0), 1e-3, 0.5 - 1e-3)
    whole = np.zeros((DIMS, target.shape[1]))
    whole[used] = weights[:-1]
    return Model(languages, code, whole, weights[-1].astype(float), np.log((1 - error) / error))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> DataFrame:
    """At most per_language labelled rows of each language, those with the lowest md5 of doc_id; never a held-out row.

    A language's rows are first thinned by their digest to about twice the bound, so that ranking them is no hot group."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    keyed = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.md5(F.col(doc_id).cast("string")).alias("_key"))
    counts = {r["lang"]: r["count"] for r in keyed.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return keyed.select("lang", "text").limit(0)
    part = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    share = F.map_from_arrays(F.array(*[F.lit(k) for k in counts]), F.array(*[F.lit(min(1.0, (2 * per_language + 50) / n)) for n in counts.values()]))
    thin = keyed.where(part <= share[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_key", "doc_id", F.md5("text")))
    chosen = thin.withColumn("_place", place).where(F.col("_place") <= per_language)
    return chosen.select("lang", "text")


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample. Executors make the vectors; the driver gets per_language * languages of them at most."""

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)], pa.binary())], ["lang", "x"])

    rows = by_batch(sample(docs, doc_id, text, lang, per_language), vectors, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the fit does not depend on the order of arrival
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(-1, DIMS)
    return fit(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (0 to 1), runner_up and ambiguous, from the text alone.

    Null text or one without a letter, or a model without languages: `und`, score 0, not ambiguous. Every whole text is
    read, in blocks. Columns of docs are kept, but for those named like the new ones (a prefix tells them apart). Empty
    table: no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x bits numbers, whatever the corpus
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "runner_up", "ambiguous")]
    docs = docs.select(*[c for c in docs.columns if c not in names])
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        out: list[tuple] = []
        for value in batch.column(at):
            t = value.as_py()
            if not t or not m.languages or not any(map(str.isalpha, t)):
                out.append((UNKNOWN, 0.0, None, False))
                continue
            first, second, odds = m.decode(features(t)[None])
            a, b = float(odds[0, first[0]]), float(odds[0, second[0]])
            several = len(m.languages) > 1
            out.append((m.languages[first[0]], a, m.languages[second[0]] if several else None, several and a - b < MARGIN))
        kinds = (pa.string(), pa.float64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], [*batch.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_batch(docs, run, f"{kept}, {names[0]} string, {names[1]} double, {names[2]} string, {names[3]} boolean")
