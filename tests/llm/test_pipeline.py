"""The pipeline against a brute-force version of its stages, and the queries of the llm operators."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import langid, packing, pii, queries
from gneiss.llm.queries import tokenizer_path

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def odd_documents(spark):
    from test_small import odd

    base = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id > 100").orderBy("doc_id").limit(60)
    more = odd(spark)
    clash = [c for c in more.columns if c not in base.columns]
    return base.withColumns({c: F.lit(9) for c in clash}).unionByName(more.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang"))))


@pytest.mark.parametrize("n", range(5))
def test_stage_on_odd_rows(spark, n):
    frame = odd_documents(spark)
    name, stage = corpus_pipeline.STAGES[n]
    rows = [r.asDict() for r in stage(spark, frame, SMALL).collect()]
    given = [r.asDict() for r in frame.collect()]
    if name == "pack":
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in given)
        return
    assert all(set(r) == set(given[0]) and all(r[c] == 9 for c in r if c not in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows)
    ids, texts = Counter(r["doc_id"] for r in rows), Counter((r["doc_id"], r["text"]) for r in rows)
    if name == "language":
        assert not [r for r in rows if not r["text"] or not any(c.isalpha() for c in r["text"])] and len(rows) > 55
    elif name == "near_duplicates":
        assert max(texts.values()) == 1 and ids[1] == ids[2] == ids[6] == 1 and ids[4] == 1 and ids[5] == 0 and ids[3] == 1 and ids[7] == 2
    elif name == "personal_data":
        assert len(rows) == len(given) and [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    else:
        assert not any(ids[i] for i in (1, 2, 6)) and ids[4] + ids[5] + ids[7] > 0


@pytest.mark.parametrize("n", range(5))
def test_stage_on_an_empty_table(spark, n):
    from test_small import empty

    frame = empty(spark)
    got = corpus_pipeline.STAGES[n][1](spark, frame, SMALL)
    assert got.count() == 0 and (n == 4 or got.columns == frame.columns)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0


def test_as_by_brute_force(spark):
    from test_small import brute_links, brute_mix
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    # Language ID: fit on the same bounded sample; documents without a letter or without a clear language go.
    learnable = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    sample = []
    for lang in {r[2] for r in learnable}:
        sample += sorted((r for r in learnable if r[2] == lang), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())[: langid.PER_LANGUAGE]
    x = [(r[2], langid.features(r[1]).astype(np.float16)) for r in sample]
    x.sort(key=lambda r: (r[0], r[1].tobytes()))
    model = langid.fit(np.array([v for _, v in x], np.float32), [k for k, _ in x])

    def clear(text):
        if not text or not any(c.isalpha() for c in text):
            return False
        first, second, odds = model.decode(langid.features(text)[None])
        return odds[0, first[0]] - odds[0, second[0]] >= langid.MARGIN

    rows = [r for r in rows if clear(r[1])]
    # Near duplicates: the least of each class stays.
    leads = {i for i, label, _ in brute_links([(r[0], r[1]) for r in rows]) if i == label}
    rows = [r for r in rows if r[0] in leads]
    # Personal data.
    rows = [(i, pii.masked(t, sum(pii.find(t, pii.weights()), [])), lang, s) for i, t, lang, s in rows]
    # Mixing: whole epochs, then the first tokens of the rest.
    taken, _ = brute_mix([(i, t, s) for i, t, _, s in rows])
    texts = {i: t for i, t, _, _ in rows}
    mixed = Counter()
    for i, size, n in taken:
        whole, rest = divmod(n, size) if size else (0, 0)
        mixed[i, texts[i]] += whole
        if rest:
            mixed[i, re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % rest, texts[i])[0]] += 1
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = Counter()
    for (i, t), n in mixed.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            pieces[i, k // packing.CAPACITY, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += n
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +pieces
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    assert len(bins) <= -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_cover_their_table(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    ids = "page_id" if table == "pages" else "doc_id"
    rows = queries.queries()[name](spark, SMALL)
    assert rows.select(ids).distinct().count() == spark.read.parquet(f"{SMALL}/{table}.parquet").select(ids).distinct().count()
