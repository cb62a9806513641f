"""Shared pieces: shared-folder tables, distributed running totals, Arrow batch helpers."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents that one bucket of a running total holds on average.
ROWS_PER_BUCKET = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session within one machine
    gets a folder made here; elsewhere that is an error, since no local folder is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gneiss-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables that settle wrote and nothing has deleted yet.
SETTLED: list[str] = []


def tidy(spark: SparkSession) -> None:
    """Delete the tables that settle wrote so far; for long sessions, once their results are written elsewhere."""
    while SETTLED:
        path = SETTLED.pop()
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session is gone: nothing is left to tidy with
            pass


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors.

    The files go at the end of the Python process, or by tidy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gneiss-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not SETTLED:
        atexit.register(tidy, spark)
    SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets_for(rows: int) -> int:
    """A number of buckets in proportion to the rows, so that a bucket stays small: ROWS_PER_BUCKET up to a billion rows,
    25,000 at 25 billion; a window over the buckets of one group stays a task of a million rows."""
    return max(1, min(1 << 20, -(-rows // ROWS_PER_BUCKET)))


def hex_bucket(key: Column, buckets: int) -> Column:
    """Which of `buckets` equal ranges of the first 32 bits a hex digest lies in; follows the digest's order."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int")


def running_total(df: DataFrame, group: list[str], key: str, ties: list[str], value: str, out: str, buckets: int, facts: DataFrame | None = None) -> DataFrame:
    """`out`: the sum of `value` over rows of the same group that come earlier by (key, ties).

    key is a hex digest; its ranges are the buckets, so a hot group is dealt over all of them. Each bucket is summed
    first (partial sums before the shuffle), the bucket sums get prefix sums, and the rows add theirs within a bucket.
    Rows equal in group, key and ties may take each other's place. facts: a row per group, whose other columns are added;
    they travel with the bucket sums, so the rows move once."""
    # Groups by columns that are never null: the windows and the join then share one partitioning, so rows move once.
    keys = {f"_v{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(group)} | {f"_z{i}": F.col(c).isNull() for i, c in enumerate(group)}
    added = [c for c in facts.columns if c not in group] if facts is not None else []
    rows = df.withColumns({**keys, "_bucket": hex_bucket(F.col(key), buckets)})
    by = [*keys, "_bucket"]
    sums = rows.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    if facts is not None:
        starts = starts.join(facts.withColumns(keys).select(*keys, *added), [*keys], "left")
    inside = Window.partitionBy(*by).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    met = placed.join(starts, by, "left")
    return met.select(*df.columns, *added, (F.col("_start") + F.col("_inside")).cast("long").alias(out))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts' UTF-8 bytes; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: What workers remember between tasks; the next operator that runs in a worker frees it.
CACHES: list[Callable[[], None]] = []


def let_go() -> None:
    """Give memory back: a worker lives on between tasks, beside its executor and its neighbour."""
    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows that an Arrow batch holds at most, so that long texts fit in a worker's memory.
BATCH_ROWS = 1_000


def by_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int | None = None, remember: bool = False) -> DataFrame:
    """Apply f to each Arrow batch of BATCH_ROWS rows at most; one batch is held at a time. rows: slices of so many rows are
    given to f. remember: what workers remember is kept for the next task.

    The session's own bound on batches is lowered to BATCH_ROWS if it is higher or none."""
    conf = df.sparkSession.conf
    most = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if most <= 0 or most > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    step = min(rows or BATCH_ROWS, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remember:
            let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield f(batch.slice(at, step))
        if not remember:
            let_go()

    return df.mapInArrow(run, schema)


def order_numbers(values: DataFrame, column: str) -> DataFrame:
    """(column, _rank) for the different values of a column that are not null: 0, 1, 2, ... in their order.

    The values are range-partitioned by Spark's own sample and sorted within partitions; the driver gets one count per
    partition. No values: no rows."""
    spark = values.sparkSession
    parted = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = settle(parted.withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    if not starts:
        return placed.select(column, F.lit(0).cast("long").alias("_rank"))
    first = F.create_map(*[F.lit(x).cast("long") for pair in starts for x in pair])
    return placed.select(column, (first[part] + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_rank"))


#: Keys of a join that count as hot: those with more than this part of all rows, so fewer keys than its inverse; and over
#: how many places of the shuffle such a key's rows are spread.
HOT_PART, HOT_SPREAD = 1_000, 1_024


def join_on_hot(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined (inner) with facts, a row per key; n: a column of facts that counts a key's rows of all `total` in rows.

    A key with more than a HOT_PART-th of the rows gets its facts by a broadcast: there are fewer than HOT_PART of them. In
    the shuffle by which the others get theirs, such a key's rows are spread, so no key is a large part of a task. facts is
    read three times: settle it before; its columns but the key are in none of rows."""
    limit = max(1, total // HOT_PART)
    hot, cold = facts.where(F.col(n) > limit), facts.where(F.col(n) <= limit)
    if not hot.limit(1).count():
        return rows.join(facts, key)
    added = [c for c in facts.columns if c != key]
    told = hot.select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in added])
    met = rows.join(F.broadcast(told), rows[key] == told["_hot"], "left")
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SPREAD)) + 1).cast("int")
    met = met.withColumn("_spread", spread).join(cold.withColumn("_spread", F.lit(0)), [key, "_spread"], "left")
    out = met.select(*rows.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in added])
    return out.where(F.col(n).isNotNull())
