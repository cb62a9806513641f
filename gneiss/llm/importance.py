"""Target-distribution importance resampling: hashed n-gram counts of the corpus and of a target give each bucket a gain,
a document's mean gain is its weight, and a Gumbel draw without replacement keeps the documents with the highest scores.

Spark SQL throughout: n-gram arrays, crc32 modulo, exploded and counted by group, a broadcast join with the gains, sums per
document, a range sort numbered by the offsets of its partitions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import settle

#: What parts words; a word is a run of ASCII letters (in lower case) and digits, and of anything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDERS = 2
BUCKETS = 10_000
#: Weights, gains and draws are whole thousandths.
SCALE = 1_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"


def words(text: Column) -> Column:
    """The words in order; only A to Z are lower-cased. Null: none. A split costs a fifth of taking out matches one by one."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    bare = F.trim(F.regexp_replace(low, BETWEEN, " "))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, " ")).otherwise(F.array().cast("array<string>"))


def ngram_buckets(found: Column, orders: int = ORDERS, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to `orders` consecutive words, joined by a space, repeats included: crc32 of their UTF-8
    bytes, modulo. found: a column that is there already, since it is named several times."""

    def run(n: int) -> Column:
        def one(word: Column, i: Column) -> Column:
            parts = [word]
            for k in range(1, n):
                parts += [F.lit(" "), F.get(found, i + k)]
            return (F.crc32(F.concat(*parts).cast("binary")) % buckets).cast("int")

        return F.transform(F.slice(found, F.lit(1), F.greatest(F.size(found) - (n - 1), F.lit(0))), one)

    return F.concat(*[run(n) for n in range(1, orders + 1)])


def bucketed(texts: DataFrame, text: str, keep: dict[str, str], orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """The columns of `keep` by their new names, _words (how many) and _buckets (an array of a bucket per feature)."""
    found = texts.select(*[F.col(c).alias(k) for k, c in keep.items()], words(F.col(text)).alias("_found"))
    return found.select(*keep, F.size("_found").cast("long").alias("_words"), ngram_buckets(F.col("_found"), orders, buckets).alias("_buckets"))


def bucket_counts(found: DataFrame) -> DataFrame:
    """(_bucket, _n): features by bucket, summed before they move."""
    return found.select(F.explode("_buckets").alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))


def gains(found: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(_bucket, _gain), a row per bucket: the log of how much likelier the target is to have the bucket than the corpus,
    each bucket counted once more than it is seen, in thousandths, floored. found, target: with _buckets."""
    own, other = bucket_counts(found), bucket_counts(target)
    all_buckets = found.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket"))
    met = all_buckets.join(own.withColumnRenamed("_n", "_s"), "_bucket", "left").join(other.withColumnRenamed("_n", "_t"), "_bucket", "left")
    met = met.select("_bucket", F.coalesce("_s", F.lit(0)).cast("double").alias("_s"), F.coalesce("_t", F.lit(0)).cast("double").alias("_t"))
    totals = met.agg(F.sum("_s").alias("_own"), F.sum("_t").alias("_other"))
    # One row meets `buckets` rows.
    rated = met.join(F.broadcast(totals))
    ratio = (F.col("_t") + 1) * (F.col("_own") + buckets) / ((F.col("_s") + 1) * (F.col("_other") + buckets))
    return rated.select("_bucket", F.floor(F.lit(float(SCALE)) * F.log(ratio)).cast("long").alias("_gain"))


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A Gumbel draw that doc_id alone decides, in thousandths, floored. Null doc_id: drawn as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32))))).cast("long")


def weigh(found: DataFrame, gain: DataFrame, keep: dict[str, str]) -> DataFrame:
    """A row per row of found (_row, the columns of `keep`, _words, _buckets): the columns by their own names, _row, _words,
    _features, _weight.

    gain: what `gains` gives, broadcast (a row per bucket). A document's features are summed in the task that explodes
    them, so a row per document moves and not one per feature. No features: weight 0."""
    by = ["_row", *keep, "_words"]
    met = found.select(*by, F.explode_outer("_buckets").alias("_bucket")).join(F.broadcast(gain), "_bucket", "left")
    sums = met.groupBy(*by).agg(F.count("_bucket").alias("_features"), F.coalesce(F.sum("_gain"), F.lit(0)).alias("_sum"))
    weight = F.when(F.col("_features") > 0, F.floor(F.col("_sum") / F.col("_features"))).otherwise(F.lit(0)).cast("long")
    return sums.select(*[F.col(k).alias(c) for k, c in keep.items()], "_row", "_words", "_features", weight.alias("_weight"))


def draw(weighed: DataFrame, doc_id: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `weigh`, with a _score, and _rank: 1, 2, 3 ... of the drawn ones by falling score, then doc_id (nulls last); null of
    the others. floor(percent * N / 100) are drawn of the N rows with at least `least_words` words.

    The order is cut into ranges by Spark's own sample and sorted within them; the driver gets two counts per partition,
    whose running sum is where a partition's ranks begin. Rows alike in all columns stand by their place in the input, so
    that very many of them are still dealt over several ranges."""
    spark = weighed.sparkSession
    order = [F.col("_out"), F.col("_score").desc(), F.col(doc_id).asc_nulls_last(), F.col("_features"), F.col("_row")]
    sorted_rows = weighed.withColumn("_out", F.col("_words") < least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)), F.count(F.when(~F.col("_out"), 1))).collect())
    starts, before, fit = [], 0, 0
    for p, n, able in counts:
        starts.append((p, before))
        before, fit = before + n, fit + able
    drawn = percent * fit // 100
    offsets = spark.createDataFrame(starts, "_part long, _before long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part", "left")  # a row per partition
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return numbered.withColumn("_rank", F.when(~F.col("_out") & (rank <= drawn), rank)).drop("_part", "_before", "_at", "_out", "_row")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: tuple[str, ...] = (), orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """Every row of docs as doc_id, the columns in `keep`, and _words, _features, _weight, _score, _rank (null: not drawn).

    The texts of docs are read once: their features go to the shared folder as arrays of buckets, with the row's place in
    the input, which tells repeated rows apart. Empty docs: no rows. Empty target: every bucket counts once, so rare
    features win. Null texts have no words and are never drawn; null doc_ids share a draw and come last among equal scores;
    repeated rows each count and are ranked each; other columns of docs, whatever their names, take no part."""
    kept = {f"_keep{i}": c for i, c in enumerate(dict.fromkeys([doc_id, *keep]))}
    found = settle(bucketed(docs, text, kept, orders, buckets).withColumn("_row", F.monotonically_increasing_id()), "buckets")
    gain = gains(found, bucketed(target, target_text, {}, orders, buckets), buckets)
    return draw(weigh(found, gain, kept).withColumn("_score", F.col("_weight") + gumbel(F.col(doc_id), seed)), doc_id, least_words, percent)
