"""Operators and shared pieces against plain versions: Ogg features, k-d tree, language codewords, bins, hot joins."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_small import docs, empty

from gneiss.llm import common, langid, ogg, packing, sharding
from gneiss.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", [None, "", "a", "é" * 700, "some words " * 3000])
def test_ogg_features_by_definition(spark, text):
    got = ogg.media_columns(docs(spark, text)).first()["feature"]
    data = ogg.payload_of((text or "").encode())
    n = len(data)
    mean = sum(data) / n
    rms = math.sqrt(sum((b - 128) ** 2 for b in data) / n)
    turns = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values()) + 0.0
    packets = -(-n // 4096)
    sample_pages, lacing = 1, 0  # a page for the header; then 255 lacing values to a page
    for i in range(packets):
        lacing += len(data[4096 * i : 4096 * (i + 1)]) // 255 + 1
    sample_pages += -(-lacing // 255)
    mark_pages = 1 + -(-(4 * packets // 255 + 1) // 255)
    want = f"seconds={n / 8000:.6f};last={4096 * (packets - 1) / 8000:.6f};pages={sample_pages + mark_pages};packets={packets};mean={mean:.4f};rms={rms:.4f};turns={turns};entropy={entropy:.4f}"
    assert got == want


def test_ogg_stream_that_begins_late():
    packets = [b"head", *(bytes([i]) * 3000 for i in range(40))]
    pages = ogg.paginate(5, [(p, 0 if not i else 3000 * i) for i, p in enumerate(packets)])
    streams, _ = ogg.demultiplex(b"".join(pages))
    assert ogg.packet_starts(streams[5]) == [0, *range(0, 120_000, 3000)]


def tree_of(rows, first, n, widths):
    """Checks that shards first to first + n are the leaves of a k-d tree over rows; rows: (coordinates, tie, weight, shard)."""
    if n == 1 or not rows:
        return
    d = max(range(len(widths)), key=lambda i: (max(r[0][i] for r in rows) - min(r[0][i] for r in rows), -i))
    low, high = [r for r in rows if r[3] < first + n // 2], [r for r in rows if r[3] >= first + n // 2]
    if low and high:
        assert max((r[0][d], r[1]) for r in low) < min((r[0][d], r[1]) for r in high)
    total, most = sum(r[2] for r in rows), max(r[2] for r in rows)
    assert abs(sum(r[2] for r in low) - total * (n // 2) / n) <= most + 1
    tree_of(low, first, n // 2, widths)
    tree_of(high, first + n // 2, n - n // 2, widths)


@pytest.mark.parametrize(("seed", "broadcast"), [(0, 50_000), (1, 3)])
def test_kd_tree_by_definition(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(sharding, "BROADCAST_VALUES", broadcast)
    r = random.Random(seed)
    rows = [(i, r.choice(["a_long_common_start_1", "a_long_common_start_2", "a_long_common_start_3", None, "z"] + ["a_long_common_start_2"] * 4), r.randint(1, 300)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    placed = sharding.kd_partition(frame, ["source", "size", "doc_id"], "size", ["doc_id"], shards=11)
    ranks = {s: i for i, s in enumerate(sorted({s for _, s, _ in rows if s is not None}))}
    spans = [(0, len(ranks) - 1), (min(w for *_, w in rows), max(w for *_, w in rows)), (0, 1499)]
    top = float((1 << 31) - 2)
    at = lambda v, i: 0 if v is None else 1 + math.floor((v - spans[i][0]) / float(spans[i][1] - spans[i][0]) * top)
    ties = {x["doc_id"]: x["t"] for x in frame.select("doc_id", F.xxhash64("doc_id").bitwiseAND((1 << 31) - 1).alias("t")).collect()}
    got = [([at(ranks.get(x["source"]), 0), at(x["size"], 1), at(x["doc_id"], 2)], ties[x["doc_id"]], x["size"], x["_shard"]) for x in placed.collect()]
    assert len(got) == 1500 and {x[3] for x in got} == set(range(11))
    tree_of(got, 0, 11, spans)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_language_by_definition(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(rows)
    some = rows.where("length(text) < 1500").limit(40)
    for row in langid.identify(some, model).collect():
        counts = Counter()
        data = row["text"].lower().encode()
        for n in langid.ORDERS:
            for i in range(len(data) - n + 1):
                counts[(int.from_bytes(data[i : i + n], "big") * langid._MULTIPLIERS[n % 3] & 0xFFFFFFFF) >> 19] += 1
        total = sum(counts.values())
        margins = [model.bias[b] + sum(math.sqrt(c / total) * model.weights[k, b] for k, c in counts.items()) for b in range(model.code.shape[1])]
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, word)) for word in model.code]
        odds = [math.exp(-v) for v in loss]
        best = max(range(len(loss)), key=lambda i: odds[i])
        assert row["lang_pred"] == model.languages[best] and row["score"] == pytest.approx(odds[best] / sum(odds), abs=1e-3)


def test_fit_is_the_least_loss():
    r = np.random.default_rng(1)
    x = np.sqrt(r.dirichlet(np.ones(30) * 0.2, 40)).astype(np.float64)
    x = np.pad(x, ((0, 0), (0, langid.DIMS - 30)))
    labels = [f"l{i % 3}" for i in range(40)]
    model = langid.fit(x, labels, rounds=6000, ridge=1e-2)
    per = np.array([1 / labels.count(v) / 3 for v in labels])
    for b in range(model.code.shape[1]):
        target = np.array([model.code[model.languages.index(v), b] for v in labels])
        slope = -target * per / (1 + np.exp(target * (x @ model.weights[:, b] + model.bias[b])))
        assert np.abs(x.T @ slope + 1e-2 * model.weights[:, b]).max() < 1e-5 and abs(slope.sum() + 1e-2 * model.bias[b]) < 1e-5


@pytest.mark.parametrize("text", ["½ ² ① 12", "٣ 4", "___ !?", "", " \n"])
def test_no_letter_is_und(spark, text):
    model = langid.fit(np.array([langid.features(t) for t in ["aba bab", "cdc dcd"] * 5]), ["a", "c"] * 5)
    assert langid.identify(docs(spark, text), model).first()["lang_pred"] == "und"
    assert langid.identify(docs(spark, text + "ª"), model).first()["lang_pred"] != "und"


def least_bins(sizes, capacity):
    """The fewest bins, by trying all subsets."""
    n = len(sizes)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)  # bins closed, fill of the last
    for s in range(1, 1 << n):
        for i in range(n):
            if s >> i & 1:
                bins, fill = best[s ^ (1 << i)]
                new = (bins, fill + sizes[i]) if bins and fill + sizes[i] <= capacity else (bins + 1, sizes[i])
                best[s] = min(best[s], new)
    return best[-1][0]


def test_bins_are_nearly_as_few_as_can_be():
    r, over = random.Random(9), 0
    for _ in range(120):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 10))]
        used = sum(t for t, _ in packing.plan_bins(dict(Counter(sizes)), 30))
        least = least_bins(sizes, 30)
        assert least <= used <= least + 1
        over += used - least
    assert over <= 6


def test_cache_of_words_is_bounded(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    r = random.Random(1)
    monkeypatch.setattr(packing, "CACHE_BYTES", 500)
    packing.word_encoder.cache_clear()
    encode = packing.word_encoder(tokenizer_path())
    for _ in range(50):
        text = " ".join("".join(r.choice("abcXé,1") for _ in range(r.choice([1, 3, 9, 300]))) for _ in range(30))
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    packing.word_encoder.cache_clear()


def test_hot_keys_meet_as_others(spark):
    rows = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700)).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("k <> 5")
    got = common.join_on_hot(rows, facts, "k", "n", 5000)
    assert sorted(map(tuple, got.select("k", "id", "n", "least").collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "id", "n", "least").collect()))


def test_order_numbers(spark):
    values = ["b", "a", "", "é", "a", None, "zz", "z"]
    got = common.order_numbers(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()
    assert {r["v"]: r["_rank"] for r in got} == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=str.encode))}
    assert common.order_numbers(spark.createDataFrame([(None,)], "v string"), "v").count() == 0


def test_tidy_deletes_what_was_settled(spark):
    frame = common.settle(spark.range(3).toDF("x"), "gone")
    path = common.SETTLED[-1].removeprefix("file://")
    assert frame.count() == 3 and os.path.isdir(path)
    common.tidy(spark)
    assert not os.path.isdir(path) and not common.SETTLED


def test_batches_without_a_bound(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    seen = common.by_batch(spark.range(0, 3000, 1, 1).toDF("x"), lambda b: b.slice(0, 1), "x long").count()
    assert seen >= 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert packing.token_pieces(empty(spark), tokenizer_path()).count() == 0
