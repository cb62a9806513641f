"""Importance resampling, periodic runs and the quality classifier against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import importance, periodic, quality, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Nulls, empties, a long text, repeated rows, a repeated id, columns whose names the operators use."""
    r = random.Random(5)
    long = " ".join(r.choice(["aa", "b", "C3", "é", "ÉÉ", "x-y"]) for _ in range(30_000))
    some = "one two three four five six seven " * 4
    rows = [(1, None), (2, ""), (3, some), (3, some), (4, long), (5, long + " z"), (6, "  \n\t "), (7, "é" * 300), (7, "other text of some words " * 9), (None, "no id at all here in this row " * 5), (None, some), (8, "A b \x85 c")]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    return frame.withColumns({c: F.lit(9) for c in ("_words", "_row", "_bucket", "_buckets", "_score", "_found", "_keep0", "rank", "runs", "n_words", "collapsed", "score", "predicted", "traits", "held_out", "_n", "_at", "_out")})


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# ---- 11 --------------------------------------------------------------------------------------------------------------


def plain_features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain_resample(rows, target):
    """(doc_id, features, weight, score, rank) of all rows, rows equal in all else in any order."""
    found = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000.0 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in range(10_000)]
    scored = []
    for i, w, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(f), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    n = 25 * len(able) // 100
    return Counter([(*x[:4], i + 1 if i < n else None) for i, x in enumerate(able)] + [(*x[:4], None) for x in scored if not x[4]])


def test_resampling_equals_a_plain_version(spark):
    docs, target = odd(spark), ["one two", None, "", "other text é", "aa b aa"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, frame).select("doc_id", "_features", "_weight", "_score", "_rank")
    assert Counter(tuple(r) for r in got.collect()) == plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], target)


def test_resampling_of_a_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    got = queries.op11_importance(spark, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(docs, target)


def test_very_many_equal_rows_are_each_ranked(spark):
    rows = [(7, "w " * 30)] * 400 + [(None, "w " * 30)] * 400 + [(i, "v " * 25) for i in range(8, 108)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("w",)], "text string"))
    found = Counter(tuple(r) for r in got.select("doc_id", "_features", "_weight", "_score", "_rank").collect())
    assert found == plain_resample(rows, ["w"]) and sorted(r[4] for r in found if r[4]) == list(range(1, 226))


def test_resampling_of_empty_tables(spark):
    docs, none = odd(spark), spark.createDataFrame([], "text string")
    assert importance.resample(docs.where("false"), none).count() == 0
    got = importance.resample(docs, none, keep=("source",)).collect()
    assert len(got) == docs.count() and {r["source"] for r in got} == {"s"} and sum(r["_rank"] is not None for r in got) == 25 * sum(r["_words"] >= 20 for r in got) // 100


# ---- 12 --------------------------------------------------------------------------------------------------------------


def plain_runs(words):
    """By definition: for each period, stretches in which words that far apart are equal, unless a smaller period holds."""
    names = {}
    x = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    found = {}
    for q in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a + q >= max(6, 4 * q) and (int(a), int(b - a + q)) not in found:
                found[int(a), int(b - a + q)] = q
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    told, left = "".join(f"{a},{m},{q}\n" for a, m, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_equal_a_plain_version():
    r = random.Random(1)
    for _ in range(3_000):
        w = [r.choice("abcde"[: r.choice((1, 2, 3, 5))]).encode() for _ in range(r.randrange(60))]
        if r.random() < 0.6:
            w = w[: r.randrange(len(w) + 1)] + [r.choice("abc").encode() for _ in range(r.randrange(1, 8))] * r.randrange(1, 9) + w[-5:]
        assert periodic.document_runs(w) == plain_runs(w)
        assert periodic.runs_of(np.array([ord(x) for x in w], np.int64)) == plain_runs(w)  # without parting into stretches


def test_every_run_of_three_periods_has_a_square():
    r = random.Random(2)
    for _ in range(300):
        ids = [r.randrange(2) for _ in range(r.randrange(2, 50))]
        seeds = set(periodic.squares(ids))
        assert all(ids[e - p + 1 : e + 1] == ids[e + 1 : e + p + 1] for e, p in seeds)
        for a, n, q in [(a, n, q) for a, n, q in periodic.runs_of(np.array(ids), 1, 3)]:
            assert any(p == q and a <= e - p + 1 and e + p < a + n for e, p in seeds)


def test_ordered_sets_of_ends():
    r = random.Random(3)
    values = r.sample(range(100_000), 4_000)
    ends, held = periodic.Ends(values[0]), [values[0]]
    for v in values[1:]:
        below, above = [x for x in held if x < v], [x for x in held if x > v]
        assert ends.add(v) == (max(below, default=None), min(above, default=None))
        held.append(v)
    assert list(ends) == sorted(values) and len(ends.blocks) > 1


def test_runs_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, SMALL)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_row(*d) for d in docs)
    assert sum(zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in docs) > 5


def test_runs_of_odd_rows(spark, tmp_path):
    docs = odd(spark).unionByName(odd(spark).select(*[F.lit(29 if c == "doc_id" else 9).cast(t).alias(c) if c != "text" else "text" for c, t in odd(spark).dtypes]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_row(r["doc_id"], r["text"]) for r in docs.collect())
    assert zlib.crc32(b"29") % 10 == 0  # its words are repeated
    rows = periodic.periodic_runs(odd(spark), prefix="p_")
    assert [c for c in rows.columns if not c.startswith("p_")] == odd(spark).columns and rows.count() == 12
    assert periodic.periodic_runs(odd(spark).where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least_periods=2)


def test_long_periodic_texts_take_little_more_than_their_length():
    import time

    def took(words):
        began = time.process_time()
        periodic.document_runs(words)
        return time.process_time() - began

    for unit in ([b"a"], [b"a", b"b"], [b"a", b"b", b"a", b"a", b"c"]):
        assert any(took(unit * (80_000 // len(unit))) < 7 * took(unit * (20_000 // len(unit))) + 0.1 for _ in range(3))


# ---- 13 --------------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    """Labels of held-out documents, which nothing is learned from; four of five junk texts at least are told, and hardly
    a good one goes."""
    told = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries.op13_quality(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(told[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in told]
    good, junk = [p for q, p in held if q == 1], [p for q, p in held if q == 0]
    assert len(junk) > 50 and sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.1


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = spark.read.parquet(f"{SMALL}/labels.parquet")
    other = given.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    a, b = (sorted(tuple(r) for r in quality.rate_documents(d, x).collect()) for d, x in ((docs, given), (changed, other)))
    assert a == b


def test_risk_and_prior_on_known_mixtures():
    """Two normal clouds: the estimated prior is near the true one, and the fit separates what it was never told apart."""
    rng = np.random.default_rng(7)
    for share in (0.3, 0.6, 0.85):
        def cloud(n, positive):
            x = rng.normal(0, 1, (n, 5))
            x[:, 0] += 2.5 if positive else -2.5
            return x.astype(np.float32)

        p = cloud(3_000, True)
        n = 4_000
        truth = rng.random(n) < share
        u = np.where(truth[:, None], cloud(n, True), cloud(n, False))
        first = quality.fit(p[:1_500], u[:2_000], None)
        bins = lambda x: np.bincount(np.minimum((first.score(x) * quality.BINS).astype(int), quality.BINS - 1), minlength=quality.BINS)
        prior = quality.class_prior(bins(p[1_500:]), bins(u[2_000:]))
        assert abs(prior - share) < 0.08
        net = quality.fit(p, u, prior)
        assert ((net.score(u) > 0.5) == truth).mean() > 0.95
    assert quality.class_prior(np.zeros(5), np.ones(5)) == 0.5


def test_traits():
    a = quality.traits("One two, three.\nOne two, three.\n\n" * 3)
    assert a.shape == (quality.TRAITS,) and np.isfinite(a).all() and not quality.traits("").any() and quality.traits("\n").any()
    junk, good = quality.traits("x " * 500), quality.traits(" ".join(f"w{i}" for i in range(500)))
    assert junk[3] > 0.99 and good[3] == 0 and junk[1] > 0.99 and good[1] == 0
    long = "ab, Cd. " * 300_000  # more than a block
    assert np.allclose(quality.traits(long)[quality.WORD_TRAITS :], quality.traits(long[: 8 * 1_000])[quality.WORD_TRAITS :], atol=1e-2)
    assert np.isfinite(quality.traits("\ud800 lone")).all()


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    told = labels(spark, (3, 1, 0), (3, 0, 0), (4, 1, 0), (4, 1, 1), (5, None, 0), (None, 1, 0), (7, 1, 0), (99, 1, 0), (8, 1, 0))
    got = quality.rate_documents(docs, told).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[1] == by_id[2] and len(set(by_id[3])) == 1 and all(0 <= s <= 1 for v in by_id.values() for s in v)
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]
    assert {r["score"] for r in quality.rate_documents(docs, labels(spark)).collect()} == {0.5}
    assert quality.rate_documents(docs.where("false"), told).count() == 0
