"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Stages but the last return
the columns of documents. Other columns travel along, whatever their names; any stage may get an empty table, and gives one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import chosen_path, langid, mixing, packing, pii
from gneiss.llm.common import read, settle
from gneiss.llm.queries import tokenizer_path


#: Words that a worker remembers: half of what packing alone takes, since the executors have come from other stages.
CACHE_WORDS = 300_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose two nearest codewords are about as near. The classifiers learn
    from the documents' own labels, of those that are not held out.

    A null or empty text goes. Without any label nothing can be told, and every document goes. Rows are judged one by one:
    null and repeated doc_ids and repeated rows need nothing special; long texts are read whole."""
    new = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # like no column of docs
    found = langid.identify(docs, langid.learn(docs), prefix=new)
    return found.where((F.col(f"{new}lang_pred") != langid.UNKNOWN) & ~F.col(f"{new}ambiguous")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near duplicates (five words, similarity 0.8).

    A null doc_id counts as the largest, ties go by the digest of the text, of equal rows one stays. A null text, or one
    without words, is like no other and stays, once per doc_id."""
    return chosen_path.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces personal data in its text by [KIND]. A null text stays null; each row by itself."""
    return pii.mask_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each epoch of a document; documents beyond their source's budget go.

    A document without words takes no part. A null source is one of its own. Repeated rows each count; ties in the random
    order go by doc_id, then by size."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 2048 tokens. A null or empty text: one piece, the end token.
    Repeated rows are packed each; long texts are cut into pieces."""
    return packing.pack_documents(docs, tokenizer_path(), cache_words=CACHE_WORDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: SQL can express neither the classifiers nor the tokenizer; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}")
    return docs
