"""Mixing sources to target weights: hash-random keys, range-sort within each source, distributed prefix sums of
token counts, a cut at each source's exact budget, whole epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import buckets_for, running_total

#: What a token is here: a run of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2


def token_count(text: Column) -> Column:
    """Number of TOKEN matches; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """A row per source: source_size, weight, target.

    sizes: a row per source with source_size. Sources by code point, null last, weigh `weights`, repeating. They share
    `share` of all sizes; a target stops at `most` times its source's size and the excess goes to the others by weight
    until none is above. That fixed point is found at once: in order of cap per weight, the sources up to some place are
    at their caps and the rest get one rate. The windows here run over one row per source, not over documents.
    No sources: no rows. All sizes 0: targets 0."""
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("_cap") / F.col("weight")), "_n")
    earlier, rest, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rated = weighed.withColumn("_rate", (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.min(F.when(F.col("_rate") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_n", "_rate"))).over(all_rows)
    return rated.select(source, "source_size", "weight", F.least("_cap", F.coalesce(fits["_rate"] * F.col("weight"), F.col("_cap"))).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = "mix", size: str | None = None) -> DataFrame:
    """docs with _size, _source_size, _target, _taken (tokens the mix takes of this row, repeats counted).

    A source's budget is its target rounded to whole tokens. Every row is taken whole as often as the budget holds the
    source; what is left goes to rows in order of md5(seed:doc_id), then doc_id, then size, until the budget is met,
    the last row in part. A null doc_id is drawn by the row's size. Null text: size 0, taken 0. Null source: a source of its own. Repeated rows each count.
    Empty table: no rows. Columns of docs named like the new ones are replaced. size: a column that has the tokens of a row
    already; then no text is needed."""
    sized = docs.withColumn("_size", F.col(size) if size else token_count(F.col(text)))
    sized = sized.withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("size"), F.col("_size").cast("string"))))))
    totals = sized.groupBy(source).agg(F.sum("_size").alias("source_size"))
    targets = source_targets(totals, source, weights, share, most).select(source, F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    sized = sized.drop("_source_size", "_target")
    met = running_total(sized, [source], "_key", [doc_id, "_size"], "_size", "_before", buckets_for(docs.count()), targets)
    budget = F.floor(F.col("_target") + 0.5)
    whole = F.when(F.col("_source_size") > 0, F.floor(budget / F.col("_source_size"))).otherwise(F.lit(0))
    cut = F.greatest(F.lit(0), F.least(F.col("_size"), budget - whole * F.col("_source_size") - F.col("_before")))
    return met.withColumn("_taken", (whole * F.col("_size") + cut).cast("long")).drop("_key", "_before")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of a document; one taken in part keeps its first
    tokens and the white space between them. A column n_chars, if there, follows the text."""
    text = options.get("text", "text")
    aside = {c: f"kept{c}" for c in docs.columns if c.startswith("_")}  # names that the operator uses
    mixed = mix_sources(docs.withColumnsRenamed(aside), **options)
    whole = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(0)
    left = (F.col("_taken") - whole * F.col("_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(None).cast("int"), whole.cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<int>")))
    rows = mixed.select(*[mixed[aside.get(c, c)] for c in docs.columns], F.explode(copies).alias("_part"))
    parts = F.slice(F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.coalesce(F.col("_part"), F.lit(0)))
    rows = rows.withColumn(text, F.when(F.col("_part").isNull(), F.col(text)).otherwise(F.array_join(parts, "")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
