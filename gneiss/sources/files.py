"""File trees and stored state as DataFrames, and the sinks that go with them."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X
from gneiss.sources.scratch import settled


def is_source(path: Column) -> Column:
    """Whether a path (relative to its root) belongs to a scan: no ignored or hidden directory, a known extension or name."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: (p.startswith(".") & (p != ".github")) | p.isin(*R.IGNORED_DIRS))
    return ~hidden & (X.extension(path).isin(*R.CODE_EXTENSIONS) | X.basename(path).isin(*R.CODE_NAMES))


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the root's place in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds, links left out; none if it cannot be read."""
    try:
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(folder) as found:
                yield from ((e.name, e.is_dir(follow_symlinks=False)) for e in found if not e.is_symlink())
        else:
            yield from ((i.base_name, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(folder)))
    except OSError:
        return


#: Bytes of contents that go to Spark in one batch, unless a single file has more.
BATCH_BYTES = 16 << 20


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, relative to root, of all files that a scan could want, by name alone: see is_source.

    Folders are listed in tasks, level by level, and those that a scan never enters are not listed at all. The driver
    learns how many folders the next level has. Links are not followed; a folder that cannot be read holds nothing."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = store_of(root)
        for b in batches:
            rows = []
            for folder in b["path"]:
                for name, inner in _entries(store, f"{top}/{folder}" if folder else top):
                    if not inner or (name not in R.IGNORED_DIRS and (name == ".github" or not name.startswith("."))):
                        rows.append((f"{folder}/{name}" if folder else name, inner))
            yield pd.DataFrame(rows, columns=["path", "inner"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = settled(level.mapInPandas(listed, "path string, inner boolean"), "tree")
        own = found.where("not inner").select("path").where(is_source(F.col("path")))
        files = own if files is None else files.unionByName(own)
        level = found.where("inner").select("path")
        folders = level.count()
        if not folders:
            return files
        level = level.repartition(max(1, min(folders, 4 * spark.sparkContext.defaultParallelism)), "path")


def read_tree(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """(path, ext, content) of the source files under root; paths are relative to it. wanted: a condition on path and ext;
    only files that meet it are opened.

    Executors list and read, whatever the names: those in .github, and those that begin with an underscore, which Spark's
    own readers leave out. A file that cannot be read has no content; bytes that are no UTF-8 are replaced. Spark's own
    reader takes its place for stores that only Spark can open, and leaves out what it does not list."""
    try:
        store_of(root)
    except (OSError, ValueError, ImportError):
        return _read_listed(spark, root, wanted)
    paths = list_tree(spark, root).withColumn("ext", X.extension(F.col("path")))
    paths = (paths if wanted is None else paths.where(wanted)).repartition(4 * spark.sparkContext.defaultParallelism, "path")

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = store_of(root)
        for b in batches:
            rows, held = [], 0
            for path, ext in zip(b["path"], b["ext"]):
                try:
                    with store.open_input_stream(f"{top}/{path}") as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    text = None
                rows.append((path, ext, text))
                held += len(text or "")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "ext", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    return paths.mapInPandas(contents, "path string, ext string, content string")


def _read_listed(spark: SparkSession, root: str, wanted: Column | None) -> DataFrame:
    """read_tree by Spark's own reader: the filter is on the path, so the contents of other files are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.substring(F.regexp_replace("path", r"^[a-z0-9]+:(?://[^/]*)?", ""), F.lit(len(prefix) + 1), F.length("path"))
    rows = raw.select(path.alias("path"), "content").where(is_source(F.col("path"))).withColumn("ext", X.extension(F.col("path")))
    return (rows if wanted is None else rows.where(wanted)).select("path", "ext", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def changed_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files that a change list names, unless removed, by extension alone. changes: path, status."""
    live = changes.where("status <> 'removed'").select("path")
    return files.join(live, "path", "left_semi").where(X.extension(F.col("path")).isin(*R.CODE_EXTENSIONS))


def scope(files: DataFrame, changes: DataFrame | None, wanted: str = "auto") -> DataFrame:
    """The files that a run looks at: the changed ones, or all where there are none or the scope is full."""
    if wanted == "full" or changes is None:
        return files
    some = changed_files(files, changes)
    return some if some.limit(1).count() else files


def with_derived(files: DataFrame) -> DataFrame:
    """files with directory, tokens, loc, hash: what the later stages need of a file."""
    c = F.col("content")
    return files.withColumns({"directory": X.dirname(F.col("path")), "tokens": X.token_estimate(c), "loc": X.loc(c), "hash": X.content_hash(c)})


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").json(path)


def read_issues(spark: SparkSession, path: str, only_found: bool = False) -> DataFrame:
    """Issues of an earlier run: JSON lines, or one document with an `issues` array."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.inline("issues")) if "issues" in raw.columns else spark.read.json(path)
    return rows.where("status = 'found'") if only_found else rows


def append_history(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries that can be read; a line that is no entry is left out, and without any file there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.dropna("all")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole, in any file system that Spark reaches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, indent=2))


def load_json(spark: SparkSession, path: str) -> dict | None:
    """A saved object; None if there is none, or it cannot be read as one."""
    try:
        found = json.loads(read_text(spark, path) or "null")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


#: Snapshots of a state that stay beside the one that counts, for readers that began before.
KEPT = 1


def save_state(state: DataFrame, path: str) -> None:
    """Keep a table as a new snapshot under path. The pointer to it is renamed into place when all of it is written, so a run
    that dies leaves the last one, and a reader sees one or the other whole. state may be made from the last one."""
    spark = state.sparkSession
    name = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    state.write.parquet(f"{path}/{name}")
    save_json(spark, f"{path}/pointer-{name}", {"snapshot": name})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = system.makeQualified(place)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf)
    at = lambda n: jvm.org.apache.hadoop.fs.Path(whole, n)
    context.rename(at(f"pointer-{name}"), at("current"), options)
    names = sorted(x.getPath().getName() for x in system.listStatus(place))
    for old in [n for n in names if n < name and n[:1].isdigit()][: -KEPT or None]:
        system.delete(at(old), True)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last snapshot of a table; an empty one if there is none that can be read. Of a snapshot whose files are damaged
    or gone, the rows of the others are there: to a cache, a row less is a file that is scanned again."""
    name = (load_json(spark, f"{path}/current") or {}).get("snapshot")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not name or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{path}/{name}")
