"""The queries opN_<name> with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import chosen_path, html, importance, langid, mixing, ogg, order_minhash, packing, periodic, pii, quality, sharding, suffixes
from gneiss.llm.common import read, settle

SHARDS = 40


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.neighbour_fingerprints(read(spark, sf_dir, "documents"))


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read(spark, sf_dir, "pages"))


#: For pages with one article element of headings and paragraphs, which is what the given tables hold.
OP2_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<br\s*/?>', ' ', 'g') AS inside FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split_regex(inside, '</?(p|h1)\b[^>]*>'), lambda x: regexp_replace(regexp_replace(replace(replace(regexp_replace(
    regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS blocks FROM a
), t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(read(spark, sf_dir, "documents"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = sharding.kd_partition(rows, ["source", "size", "lang", "doc_id"], "size", ["doc_id", "text_crc32"], shards=SHARDS)
    numbered = sharding.slots(placed, "_shard", ["doc_id", "text_crc32", "size"], docs.count())
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM w WHERE len(w) > 0
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)
), c(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT p.b, c.r FROM c JOIN p ON c.doc_id = p.a
)
SELECT d.doc_id, (SELECT min(r) FROM c WHERE c.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM p WHERE p.a = d.doc_id) AS n_links
FROM documents d
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # Tokens are counted once; the sums and the cut then read a narrow table.
    sizes = settle(docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("tokens")), "tokens")
    mixed = mixing.mix_sources(sizes, size="tokens")
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'size' || CAST(size AS VARCHAR))) AS key, size
  FROM (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM s
), r AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM w
), f AS (
  SELECT arg_min(rate, cap / weight) AS rate FROM r WHERE rate * weight <= cap
), t AS (
  SELECT r.source, source_size, least(cap, coalesce(f.rate * weight, cap)) AS target FROM r, f
), b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM b
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


#: crc32 by its definition, byte by byte: what a byte changes is the exclusive or of what its bits change.
OP11_SQL = r"""
WITH RECURSIVE bits(i, v) AS (
  SELECT 0, 1::UBIGINT UNION ALL SELECT i + 1, v * 2 FROM bits WHERE i < 7
), steps(i, k, v) AS (
  SELECT i, 0, v FROM bits
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM steps WHERE k < 8
), t AS (
  SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark
), rows AS (
  SELECT side, doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM texts
), feats AS (
  SELECT side, doc_id, r, len(w) AS n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM rows
), own AS (
  SELECT side, doc_id, r, n, f, count(*) AS c FROM feats GROUP BY ALL
), known AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, xor(xor(xor((xor(c, b) & 1) * t[1], ((xor(c, b) >> 1) & 1) * t[2]), xor(((xor(c, b) >> 2) & 1) * t[3], ((xor(c, b) >> 3) & 1) * t[4])),
      xor(xor(((xor(c, b) >> 4) & 1) * t[5], ((xor(c, b) >> 5) & 1) * t[6]), xor(((xor(c, b) >> 6) & 1) * t[7], ((xor(c, b) >> 7) & 1) * t[8]))))), 4294967295::UBIGINT) % 10000 AS b
  FROM (SELECT DISTINCT f FROM own), t
), bucket AS (
  SELECT b, sum(CASE WHEN side = 'd' THEN c ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN c ELSE 0 END)::DOUBLE AS t
  FROM own JOIN known USING (f) GROUP BY b
), gain AS (
  SELECT b, floor(1000::DOUBLE * ln((bucket.t + 1) * (all_s + 10000) / ((bucket.s + 1) * (all_t + 10000))))::BIGINT AS g
  FROM bucket, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM bucket)
), summed AS (
  SELECT r, sum(c)::BIGINT AS n_features, sum(c * g)::BIGINT AS total FROM own JOIN known USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT rows.doc_id, rows.r, len(w) AS n, coalesce(n_features, 0)::BIGINT AS n_features,
         coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight,
         floor(-1000::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || coalesce(rows.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g
  FROM rows LEFT JOIN summed USING (r) WHERE side = 'd'
), ranked AS (
  SELECT *, weight + g AS score, row_number() OVER (ORDER BY n < 20, weight + g DESC, doc_id NULLS LAST, n_features) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n >= 20 AND place <= 25 * (SELECT count(*) FROM scored WHERE n >= 20) // 100 THEN place END AS rank
FROM ranked
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    turned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    parted = docs.select("doc_id", "text", F.when(turned, periodic.words(F.col("text"))).alias("_words"))
    given = parted.select("doc_id", F.when(turned, F.array_join(periodic.repeating(F.col("_words"), F.col("doc_id")), " ")).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic_runs(given).withColumn("_most", periodic.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_most.start", "_most.length", "_most.period", F.expr("1000 * _most.length div _most.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_order_minhash, op2_line_blocks, op3_ogg, op4_kd_shards, op5_suffix_dedup, op6_chosen_path, op7_mixing, op8_language, op9_pii, op10_packing, op11_importance, op12_periodic_runs, op13_quality]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_blocks": OP2_SQL, "op6_chosen_path": OP6_SQL, "op7_mixing": OP7_SQL, "op11_importance": OP11_SQL}
