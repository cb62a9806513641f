"""Incremental scans over a stream of files: only contents that are new or changed are scanned.

What was seen is keyed state, a hash per path, in a RocksDB state store; a batch looks up its own paths and reads nothing
else of what came before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gneiss.functions import text as X
from gneiss.sources import findings

CHANGES = "batch long, path string"
#: Every so many batches the findings that still count are written whole, so that readers read them and what came after.
COMPACT = 50
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Seen(StatefulProcessor):
    """Of a path's rows in a batch, passes on the last if it differs from what was seen last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, at double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        before = (held[1], held[0] or "") if held else (float("-inf"), "")
        newest = max(rows, key=lambda r: (r["_at"], r["hash"] or ""))
        if held and newest["_at"] < before[0]:
            return  # came late: a later content was seen
        if newest["hash"] != (held[0] if held else None):
            yield Row(path=key[0], ext=newest["ext"], content=newest["content"])
        if newest["hash"] is None and newest["_at"] == float("-inf"):
            self.last.clear()  # gone, and without times nothing can come late
        else:
            self.last.update((newest["hash"], newest["_at"]))

    def close(self) -> None:
        pass


def changed(files: DataFrame, modified: str | None = None) -> DataFrame:
    """(path, ext, content) of the rows of a stream of path, ext, content whose content is not what its path had before; a
    null content says that the file is gone, and is passed on once.

    modified: a number or time that says when a content was written. Of several contents of a path in a batch the last by
    it counts (without it, or at the same time, the one with the largest hash: the same each time), and one older than what
    was seen before is late and counts for nothing. Then paths that are gone keep their time in the state; without
    `modified` nothing of them stays."""
    at = F.coalesce(F.col(modified).cast("double"), F.lit(float("-inf"))) if modified else F.lit(float("-inf"))
    rows = files.select("path", "ext", "content", X.content_hash(F.col("content")).alias("hash"), at.alias("_at"))
    return rows.groupBy("path").transformWithState(Seen(), "path string, ext string, content string", "update", "none")


class Lines(StatefulProcessor):
    """Puts together the lines of a run from chunks of bytes; what follows the last line end is kept for the next batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "bytes binary, number bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.left.get() if self.left.exists() else (b"", 0)
        parts, number, ended = [bytes(held[0])], held[1], False
        for r in sorted(rows, key=lambda r: r["seq"]):
            whole, end, rest = bytes(r["chunk"] or b"").rpartition(b"\n")
            if end:
                for line in b"".join([*parts, whole]).split(b"\n"):
                    yield Row(run=key[0], seq=number, line=line.decode("utf-8", "replace"))
                    number += 1
                parts = []
            parts.append(rest)
            ended = ended or bool(r["last"])
        left = b"".join(parts)
        if not ended:
            self.left.update((left, number))
            return
        if left:
            yield Row(run=key[0], seq=number, line=left.decode("utf-8", "replace"))
        self.left.clear()

    def close(self) -> None:
        pass


def lines_of(chunks: DataFrame) -> DataFrame:
    """(run, seq, line) of a stream of chunks (run, seq, chunk, last): bytes cut anywhere, within a line or a character.

    A run's chunks come in order of seq from batch to batch. last: the run ends with this chunk; then what follows its last
    line end is a line too, unless it is empty. seq of a line: from 0 in its run. Bytes that are no UTF-8 are replaced."""
    return chunks.select("run", "seq", "chunk", "last").groupBy("run").transformWithState(Lines(), "run int, seq bigint, line string", "update", "none")


def _started(stream: DataFrame, one: Callable[[DataFrame, int], None], root: str) -> StreamingQuery:
    """A query over keyed state in RocksDB that ends when the stream's present input is done."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)  # a query keeps the settings that it starts with
    try:
        return stream.writeStream.foreachBatch(one).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier batches wrote; empty before the first."""
    system, place = _folder(spark, path)
    return spark.read.schema(schema).parquet(path) if system.exists(place) else spark.createDataFrame([], schema)


def _numbers(spark: SparkSession, root: str, name: str, key: str) -> list[int]:
    """The numbers of the folders root/name/key=number that are complete."""
    system, place = _folder(spark, f"{root}/{name}")
    if not system.exists(place):
        return []
    names = [x.getPath().getName() for x in system.listStatus(place) if system.exists(x.getPath().suffix("/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key}="))


def _compact(spark: SparkSession, root: str, number: int, schema: str, path: str) -> None:
    """Write the findings that count after a batch. What the state before the last holds is deleted: readers may still have
    begun with the last one."""
    earlier = _numbers(spark, root, "whole", "upto")
    current(spark, root, schema, path, number).write.mode("overwrite").parquet(f"{root}/whole/upto={number}")
    if earlier:
        for name, key in (("changes", "batch"), ("found", "batch"), ("whole", "upto")):
            for n in _numbers(spark, root, name, key):
                if n < earlier[-1] or (n == earlier[-1] and name != "whole"):
                    system, place = _folder(spark, f"{root}/{name}/{key}={n}")
                    system.delete(place, True)


def incremental_scan(files: DataFrame, scan: Callable[[DataFrame], DataFrame], root: str, modified: str | None = None, path: str = "path") -> StreamingQuery:
    """Start a query that keeps the findings of each batch's changed files under root/found, and their paths under
    root/changes. See `changed` for what counts as changed; path: the column of the findings that names the file.

    A batch that is run again meets the state as it was before it, and writes the same folders again, so its findings are
    there once."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.persist()
        fresh.select("path").write.mode("overwrite").parquet(f"{root}/changes/batch={number}")
        found = scan(fresh.where(F.col("content").isNotNull()))
        found.write.mode("overwrite").parquet(f"{root}/found/batch={number}")
        fresh.unpersist()
        if number % COMPACT == COMPACT - 1:
            _compact(spark, root, number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), path)

    return _started(changed(files, modified), one, root)


def current(spark: SparkSession, root: str, schema: str, path: str = "path", upto: int | None = None) -> DataFrame:
    """The findings of the last scan of each path: the last whole table's, but for paths that changed later, and those of
    later batches in which their path changed last. upto: only batches up to this one count."""
    whole = [n for n in _numbers(spark, root, "whole", "upto") if upto is None or n < upto]
    since = whole[-1] if whole else -1
    counts = (F.col("batch") > since) & (F.col("batch") <= upto if upto is not None else F.lit(True))
    last = _table(spark, f"{root}/changes", CHANGES).where(counts).groupBy(F.col("path").alias(path)).agg(F.max("batch").alias("batch"))
    later = _table(spark, f"{root}/found", f"batch long, {schema}").where(counts).join(last, [path, "batch"], "left_semi").drop("batch")
    if not whole:
        return later
    return _table(spark, f"{root}/whole/upto={since}", schema).join(last, path, "left_anti").unionByName(later)


def agent_lines(chunks: DataFrame, root: str) -> StreamingQuery:
    """Start a query that keeps the whole lines of agents' chunks under root/lines, a folder per batch; see `lines_of`."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/lines/batch={number}")

    return _started(lines_of(chunks), one, root)


def agent_stream(lines: DataFrame) -> DataFrame:
    """The final output of each run from a stream of its lines (run, seq, line), kept up to date: for complete mode."""
    return findings.agent_output(lines)
