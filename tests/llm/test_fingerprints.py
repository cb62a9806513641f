"""Order min-hash against a plain version, on texts with and without spaces, and the order of neighbours."""

import os
import random
from collections import defaultdict

import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from test_small import docs, table

from gneiss.llm import order_minhash

SMALL = "/root/testdata/sf0.001"
LETTER = r"[A-Za-z0-9[[\p{L}\p{N}]--[฀-໿ༀ-࿿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-鿿豈-﫿\U00020000-\U0003FFFF]]]"
WORD = regex.compile(rf"(?V1){LETTER}{{1,24}}+(?!{LETTER})|[A-Za-z0-9--[048DHLPTXdhlptx]]{{0,15}}+[048DHLPTXdhlptx]|[^ \t\n\x0b\f\r]")
BITS = (1 << 64) - 1


def hashed(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p[0] & (1 << 8 * p[1]) - 1).to_bytes(p[1], "little"), h)
    return h


def signature(text, k=3, pick=2, bins=64):
    """By the definition: number the occurrences, draw, keep the lowest of each bin, put them in text order, hash."""
    words = WORD.findall(text or "")
    kmers = [hashed(*words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    seen, chosen = defaultdict(int), defaultdict(list)
    for i, h in enumerate(kmers):
        number = hashed((h, 8), (seen[h], 4))
        seen[h] += 1
        chosen[number >> 58].append((number, i))
    out = []
    for b in sorted(chosen):
        lowest = sorted(i for _, i in sorted(chosen[b])[:pick])
        out.append(b << 57 | hashed(*[(kmers[i], 8) for i in lowest]) >> 7)
    return out


def signatures(spark, texts):
    made = order_minhash.fingerprints(docs(spark, *texts), F.col("text"), "f").select("doc_id", "f")
    return [r["f"] for r in made.orderBy("doc_id").collect()]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_as_by_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = order_minhash.fingerprints(rows, F.col("text"), "f").select("text", "f").collect()
    assert len(got) > 100 and all(r["f"] == signature(r["text"]) for r in got)


def test_odd_texts_as_by_brute_force(spark):
    r = random.Random(2)
    pool = ["a" * 24, "a" * 25, "b" * 300, "0123456789abcdef" * 9, "語" * 5, "ภาษาไทย", "é" * 40, "x", "-", "12.5", "😀", "ab", "ab", "　", "\x85"]
    texts = [None, "", " ", *("".join(r.choice(pool) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(60))]
    assert signatures(spark, texts) == [signature(t) for t in texts]


def test_queries_rows_as_by_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab cd,é語") for _ in range(r.randint(0, 300))) for _ in range(30)]
    got = order_minhash.neighbour_fingerprints(docs(spark, *texts)).orderBy("doc_id").collect()

    def likeness(a, b):
        filled = {x >> 57 for x in a} | {x >> 57 for x in b}
        return len(set(a) & set(b)) / len(filled) if filled else 1.0

    for i, row in enumerate(got):
        n, after = len(texts[i]) // 4, texts[(i + 1) % len(texts)]
        own, edited, other = signature(texts[i]), signature(texts[i][: len(texts[i]) - n] + after[:n]), signature(after)
        assert row["fingerprint"] == "".join(f"{x:016x}" for x in own) and row["edited_fingerprint"] == "".join(f"{x:016x}" for x in edited)
        assert (row["near_edited"], row["near_next"]) == pytest.approx((likeness(own, edited), likeness(own, other)))


@pytest.mark.parametrize("alphabet", ["".join(chr(0x4E00 + i) for i in range(900)), "acgt", "0123456789abcdef", "กขคงจฉชซ", "абвгдежз"])
def test_an_inserted_character_changes_little(spark, alphabet):
    r = random.Random(7)
    one, other = ("".join(r.choice(alphabet) for _ in range(4000)) for _ in range(2))
    a, b, c = signatures(spark, [one, one[:100] + alphabet[0] + one[100:], other])
    frame = spark.createDataFrame([(a, b, c)], "a array<bigint>, b array<bigint>, c array<bigint>")
    near, far = frame.select(order_minhash.likeness(F.col("a"), F.col("b")), order_minhash.likeness(F.col("a"), F.col("c"))).first()
    assert near > 0.9 and near > far + 0.25


@pytest.mark.parametrize(("given", "none", "factor"), [(300, 0, 1), (0, 60, 1), (200, 90, 1), (1, 1, 1), (1, 0, 1), (0, 1, 1), (250, 9, 9_000_000_000_000_000)])
def test_neighbours_in_many_ranges(spark, monkeypatch, given, none, factor):
    monkeypatch.setattr(order_minhash, "NEIGHBOUR_ROWS", 7)
    rows = [((i * i % 1009 if i % 9 else 4) * factor + i % 2, f"t{i}", "", "", 0) for i in range(given)] + [(None, f"n{i}", "", "", 0) for i in range(none)]
    frame = table(spark, rows)
    met = order_minhash.with_next(frame, "doc_id", ["text"], ["text"]).collect()
    ties = {x["text"]: x["h"] for x in frame.select("text", F.shiftrightunsigned(F.xxhash64("text"), 12).alias("h")).collect()}
    order = [t for _, _, t in sorted((i is not None, ties[t] if i is None else i, t) for i, t, *_ in rows)]
    assert {x["text"]: x["_next_text"] for x in met} == dict(zip(order, order[1:] + order[:1])) and len(met) == len(rows)
