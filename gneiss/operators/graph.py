"""Import resolution, the file graph, token-budgeted chunks, and what else a chunk's readers should know of."""

from __future__ import annotations

import bisect
import itertools
import math
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import compress
from gneiss.sources import scratch

# What a relative specifier may stand for, in order, and a dotted one.
RELATIVE = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
DOTTED = (".py", "/__init__.py")


def joined_path(directory: Column, relative: Column) -> Column:
    """directory/relative with . and .. worked out; a .. above the root stays."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(directory, F.lit(".")), relative), "/"), lambda p: (p != "") & (p != "."))
    up = F.lit("..")

    def step(acc: Column, p: Column) -> Column:
        climbs = (p == up) & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != up)
        return F.when(climbs, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    safe = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(F.size(acc) == 0, F.array(p)).otherwise(step(acc, p)))
    return F.array_join(safe, "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, pos, spec, target): the first candidate of each import that is a file. imports: path, pos, spec."""
    relative = F.array(*[F.struct(F.lit(i).alias("ord"), joined_path(X.dirname(F.col("path")), F.concat(F.col("spec"), F.lit(s))).alias("candidate")) for i, s in enumerate(RELATIVE)])
    dotted = F.array(*[F.struct(F.lit(i).alias("ord"), F.concat(F.regexp_replace("spec", r"\.", "/"), F.lit(s)).alias("candidate")) for i, s in enumerate(DOTTED)])
    each = imports.select("path", "pos", "spec", F.explode(F.when(F.col("spec").startswith("."), relative).otherwise(dotted)).alias("c"))
    met = each.select("path", "pos", "spec", "c.ord", "c.candidate").join(files.select(F.col("path").alias("candidate")), "candidate")
    return met.groupBy("path", "pos", "spec").agg(F.min_by("candidate", "ord").alias("target"))


def file_graph(resolved: DataFrame) -> DataFrame:
    """(src, dst) in both directions, once each, without loops."""
    edges = resolved.where("path <> target").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("degree"))
    return files.select("path").join(counts, "path", "left").select("path", F.coalesce("degree", F.lit(0)).alias("degree"))


class _Walk:
    """Next-fit along sorted items: chunk and place of each item of the group that the walk is in."""

    def __init__(self, budget: int, key=None, used: int = 0, chunk: int = 0, pos: int = -1):
        self.budget, self.key, self.used, self.chunk, self.pos = budget, key, used, chunk, pos

    def step(self, key, tokens: int) -> tuple[int, int]:
        if self.pos < 0 or key != self.key:
            self.key, self.used, self.chunk, self.pos = key, 0, 0, -1
        self.pos += 1
        if self.pos and self.used + tokens > self.budget:
            self.chunk, self.used = self.chunk + 1, 0
        self.used += tokens
        return self.chunk, self.pos


def _outcomes(tokens: list[int], budget: int) -> tuple[list[int], list[int], list[int]]:
    """What a stretch of one group does to a chunk that is open before it.

    sums: tokens up to and with each item, as far as the budget goes: the open chunk is closed at the first item whose sum
    overruns what it has left. used, closed: what is in the open chunk after the stretch, and how many chunks have been
    closed since, if one begins at the item. From the last item back: a chunk that begins at an item ends where the sums
    overrun the budget, and goes on as the one that begins there."""
    ends = list(itertools.accumulate(tokens, initial=0))
    used, closed = [0] * len(tokens), [0] * len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        at = max(i + 1, bisect.bisect_right(ends, ends[i] + budget) - 1)
        used[i], closed[i] = (used[at], closed[at] + 1) if at < len(tokens) else (ends[-1] - ends[i], 0)
    near = bisect.bisect_right(ends, budget)  # an open chunk cannot reach further
    return ends[1 : near + 1], used[:near], closed[:near]


def pack_next_fit(items: DataFrame, budget: int, group: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(group..., path, tokens, hotspots, chunk, pos): next-fit in order of hotspots (most first), then ord, then path.

    items: path, tokens (null: 0), hotspots, ord and the group columns. A chunk is closed when the next item would overrun
    the budget and it holds something; an item over the budget has a chunk to itself. The sum starts anew at each overrun,
    which no window frame expresses. So the items are cut into ranges of the whole order, of groups and within them, and
    each range works out what it does to a chunk that is open before it, for all places where that may be closed. The
    driver goes from range to range with one open chunk, a few numbers and the items of one budget each; then all ranges
    are walked at once from what they begin with. No task holds more than a range, however large a group is. parts: how
    many ranges; otherwise Spark's own number."""
    by = group or []
    keys = [f"_g{i}" for i in range(len(by))]
    rows = items.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "path", F.coalesce("tokens", F.lit(0)).alias("tokens"), "hotspots", "ord")
    order = [*map(F.col, keys), F.desc("hotspots"), F.col("ord"), F.col("path")]
    cut = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    cut = scratch.settled(cut.withColumn("_part", F.spark_partition_id()), "packed")
    dealt = cut.repartition("_part").sortWithinPartitions("_part", *order).drop("ord")
    names = dealt.columns
    part_at, tokens_at = names.index("_part"), names.index("tokens")

    def rows_of(b: pa.RecordBatch):
        groups = zip(*(b.column(i).to_pylist() for i in range(len(by)))) if by else itertools.repeat(())
        return zip(b.column(part_at).to_pylist(), groups, b.column(tokens_at).to_pylist())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range: its first group, whether that is all of it, what its items do, and where the last group ends."""
        every = itertools.chain.from_iterable(map(rows_of, batches))
        for part, own in itertools.groupby(every, key=lambda r: r[0]):
            first, tokens, walk = None, [], _Walk(budget)
            for _, key, n in own:
                first = key if first is None else first
                if key == first:
                    tokens.append(n)
                walk.step(key, n)
            fact = (part, first, walk.key == first, len(tokens), *_outcomes(tokens, budget), (walk.key, walk.used, walk.chunk, walk.pos))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fact)], pa.binary())], ["fact"])

    open_chunk, begins = _Walk(budget), {}
    for part, first, alone, n, sums, used, closed, last in sorted(map(pickle.loads, (r[0] for r in dealt.mapInArrow(told, "fact binary").collect())), key=lambda f: f[0]):
        if open_chunk.pos < 0 or first != open_chunk.key:
            open_chunk = _Walk(budget, *last)
            continue
        begins[part] = (open_chunk.key, open_chunk.used, open_chunk.chunk, open_chunk.pos)
        if not alone:
            open_chunk = _Walk(budget, *last)
            continue
        at = bisect.bisect_right(sums, budget - open_chunk.used)
        stays = at == n
        open_chunk = _Walk(budget, first, open_chunk.used + (sums[-1] if n else 0) if stays else used[at], open_chunk.chunk + (0 if stays else closed[at] + 1), open_chunk.pos + n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk = None, _Walk(budget)
        for b in batches:
            out = []
            for part, key, n in rows_of(b):
                if part != now:
                    now, walk = part, _Walk(budget, *begins.get(part, ()))
                out.append(walk.step(key, n))
            kept = [c for i, c in enumerate(b.columns) if i != part_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c for c, _ in out], pa.int32()), pa.array([p for _, p in out], pa.int64())], [*[c for c in names if c != "_part"], "chunk", "pos"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "_part")
    return dealt.mapInArrow(placed, f"{schema}, chunk int, pos long").withColumnsRenamed(dict(zip(keys, by)))


class FreeList:
    """Items in an order, some taken: the first free one from a place on that has at most some size, in log n steps."""

    def __init__(self, items: list[str], sizes: list[int]):
        self.items, self.place = items, {x: i for i, x in enumerate(items)}
        self.width = 1 << max(0, len(items) - 1).bit_length()
        self.least = [math.inf] * (2 * self.width)  # a tree of minima; the leaves are the sizes
        self.least[self.width : self.width + len(items)] = sizes
        for i in range(self.width - 1, 0, -1):
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def take(self, item: str) -> None:
        i = self.place[item] + self.width
        self.least[i] = math.inf
        while i > 1:
            i //= 2
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def first(self, start: int, room: int) -> int | None:
        """The place of the first free item from `start` on with a size of at most `room`."""
        i = start + self.width
        if start >= self.width:
            return None
        while self.least[i] > room:
            while i & 1:  # up, until there is something to the right
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.width:
            i = 2 * i if self.least[2 * i] <= room else 2 * i + 1
        return i - self.width


def smart_groups(files: list[dict], neighbours: dict[str, set[str]], budget: int) -> list[list[str]]:
    """Paths by chunk: seeds by degree, then directory, then length; each takes neighbours, then siblings, then any
    others, the smallest first, while they fit. files: path, directory, length.

    Siblings and others come from free lists, so n files cost n log n steps and not n for every chunk."""
    size = {f["path"]: f["length"] + len(f["path"]) + 10 for f in files}
    length = {f["path"]: f["length"] for f in files}
    order = {f["path"]: i for i, f in enumerate(files)}
    small = sorted(size, key=lambda p: (length[p], order[p]))
    directory = {f["path"]: f["directory"] for f in files}
    by_directory: dict[str, list[str]] = {}
    for p in small:
        by_directory.setdefault(directory[p], []).append(p)
    free = {d: FreeList(ps, [size[p] for p in ps]) for d, ps in by_directory.items()}
    everywhere = FreeList(small, [size[p] for p in small])
    taken: set[str] = set()

    def take(p: str) -> int:
        taken.add(p)
        free[directory[p]].take(p)
        everywhere.take(p)
        return size[p]

    chunks = []
    for f in sorted(files, key=lambda f: (-len(neighbours.get(f["path"], ())), f["directory"], f["length"], order[f["path"]])):
        if f["path"] in taken:
            continue
        chunk, used = [f["path"]], take(f["path"])
        for p in sorted((n for n in neighbours.get(f["path"], ()) if n in size and n not in taken), key=lambda p: (length[p], order[p])):
            if used + size[p] <= budget:
                chunk.append(p)
                used += take(p)
        for pool in (free[f["directory"]], everywhere):
            at = pool.first(0, budget - used)
            while at is not None:
                chunk.append(pool.items[at])
                used += take(pool.items[at])
                at = pool.first(at + 1, budget - used)
        chunks.append(chunk)
    return chunks


#: Characters of the budget that a compressed file leaves.
SPARE = 200


def smart_group(files: DataFrame, edges: DataFrame, budget: int, group: str = "repo") -> DataFrame:
    """(repo, path, chunk, pos) by smart_groups. files: repo, path and content_len, or ext and content: then a file that is
    over the budget by itself counts as long as it is when compressed to the budget less SPARE. edges: repo, src, dst, all
    of a repository, across directories too.

    Each choice depends on all before it, so a repository is one task, of n log n steps on paths and lengths; repositories
    go in parallel."""
    if "content" in files.columns:
        long = F.length("content") > budget
        whole = files.where(~long | F.col("content").isNull()).select(group, "path", F.coalesce(F.length("content"), F.lit(0)).alias("content_len"))
        cut = compress.fitted(files.where(long), F.lit(budget - SPARE)).select(group, "path", F.length("fit").alias("content_len"))
        files = whole.unionByName(cut)
    near = edges.groupBy(group, F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("near"))
    rows = files.select(group, "path", "content_len").join(near, [group, "path"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        items = [{"path": p, "directory": p.rpartition("/")[0] or ".", "length": int(n)} for p, n in zip(pdf["path"], pdf["content_len"])]
        neighbours = {p: set(n) for p, n in zip(pdf["path"], pdf["near"]) if n is not None}
        out = [(pdf[group].iloc[0], p, c, i) for c, chunk in enumerate(smart_groups(items, neighbours, budget)) for i, p in enumerate(chunk)]
        return pd.DataFrame(out, columns=[group, "path", "chunk", "pos"])

    return rows.groupBy(group).applyInPandas(run, f"{group} string, path string, chunk int, pos int")


def directory_manifest(files: DataFrame) -> DataFrame:
    """(directory, line): names up to three, else numbers by extension in order of first appearance (by path)."""
    rows = files.select(X.dirname(F.col("path")).alias("directory"), X.basename(F.col("path")).alias("name"), "path")
    rows = rows.withColumn("kind", F.coalesce(F.nullif(F.regexp_extract("name", r"^.+?(\.[^.]*)\z", 1), F.lit("")), F.lit("other")))
    kinds = rows.groupBy("directory", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    counted = kinds.groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("first", F.concat(F.col("n").cast("string"), "kind").alias("text")))).alias("k"), F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("directory").orderBy("path"))
    few = rows.withColumn("_n", place).where("_n <= 3").groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("path", "name"))).alias("names"))
    met = counted.join(few, "directory")
    text = F.when(F.col("n") <= 3, F.array_join(F.transform("names", lambda x: x["name"]), ", ")).otherwise(F.array_join(F.transform("k", lambda x: x["text"]), " "))
    return met.select("directory", F.concat(F.lit("  "), F.col("directory"), F.lit("/ "), text).alias("line"))


#: Related files that a manifest names, and its characters at most.
RELATED, MANIFEST = 6, 600


def manifest_text(head: Column, lines: Column, related: Column, most: int = MANIFEST, count: Column | None = None) -> Column:
    """The text of a manifest from its parts (lines, related: arrays), cut to `most` characters with a note at the end.
    count: how many related files there are, where `related` has only the first of them."""
    n = F.size(related) if count is None else count
    told = F.concat(F.lit("Related files in other chunks:\n"), F.array_join(F.slice(related, 1, RELATED), "\n"), F.lit("\n"))
    rest = F.when(n > RELATED, F.concat(F.lit("  ... +"), (n - RELATED).cast("string"), F.lit(" more\n"))).otherwise("")
    text = F.concat(head, F.lit("\nStructure:\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.when(F.size(related) > 0, F.concat(told, rest)).otherwise(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 20), F.lit("\n  ... (trimmed)\n")))


def _firsts(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Of rows (by, chunk, pos, path), those that may be among some chunk's first `most` of other chunks: `most` of each
    chunk, and of those twice as many, since a chunk leaves out its own. Both are cut before they move."""
    own = F.row_number().over(Window.partitionBy(*by, "chunk").orderBy("pos", "path"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("chunk", "pos", "path"))
    some = rows.withColumn("_n", own).where(F.col("_n") <= most)
    return some.withColumn("_n", place).where(F.col("_n") <= 2 * most).select(*by, "chunk", "pos", "path")


def related_files(placed: DataFrame, imports: DataFrame, most: int = RELATED, group: str | None = None) -> DataFrame:
    """(chunk, other_chunk, path, n): files of other chunks that a chunk imports, or that import it, by suffix; the first
    `most` by chunk, position and path. placed: path, chunk, pos; imports: path, spec. group: a column of both that says
    which repository a file is of; files of different ones are never related, and it is in the result.

    Suffixes are compared by equality: each path gives its suffixes at each place a specifier could begin, and only those
    that some specifier has stay. Importers and files of one suffix never meet each other: chunks that want a suffix, or
    hold a file with it, meet twice `most` rows at most."""
    by = [group] if group else []
    key = [*by, "tail"]
    of_files, where_ends, whole = F.col("path"), F.lit("~"), F.lit("=")  # a suffix, or all of a path
    spec = imports.select(*by, "path", "spec").distinct().join(placed.select(*by, "path", "chunk", "pos"), [*by, "path"])
    target = F.array(
        F.struct(F.concat(where_ends, "spec", F.lit(".ts")).alias("tail"), F.lit(True).alias("back")), F.struct(F.concat(where_ends, "spec", F.lit(".py")).alias("tail"), F.lit(True).alias("back")),
        F.struct(F.concat(where_ends, F.regexp_replace("spec", r"\.", "/"), F.lit(".py")).alias("tail"), F.lit(False).alias("back")), F.struct(F.concat(whole, "spec").alias("tail"), F.lit(True).alias("back")),
    )
    wants = spec.select(*by, "chunk", "pos", "path", F.explode(target).alias("t")).select(*by, "chunk", "pos", "path", "t.tail", "t.back")
    suffixes = F.concat(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.concat(where_ends, of_files.substr(i, F.length("path")))), F.array(F.concat(whole, "path")))
    held = placed.select(*by, "chunk", "pos", "path", F.explode(suffixes).alias("tail")).join(wants.select(*key).distinct(), key, "left_semi")
    own = [*key, F.col("chunk").alias("for_chunk")]
    out = wants.select(*own).distinct().join(_firsts(held, key, most), key)
    importers = wants.where("back").select(*key, "chunk", "pos", "path").distinct()
    back = held.select(*own).distinct().join(_firsts(importers, key, most), key)
    rows = out.unionByName(back).where("chunk <> for_chunk").select(*by, "for_chunk", F.col("chunk").alias("other_chunk"), "path", "pos").distinct()
    place = F.row_number().over(Window.partitionBy(*by, "for_chunk").orderBy("other_chunk", "pos", "path"))
    return rows.withColumn("n", place).where(F.col("n") <= most).select(*by, F.col("for_chunk").alias("chunk"), "other_chunk", "path", "n")


def halves(pos: Column, count: Column) -> Column:
    """Which half of a chunk of `count` files one falls into when the chunk is too large for a request."""
    return F.when(pos < F.ceil(count / 2), F.lit(0)).otherwise(F.lit(1))


#: The halves of a chunk that was too large get this share of the budget, and parts are halved so often at most.
HALF_SHARE, HALF_DEPTH = 0.45, 2


def split_chunks(placed: DataFrame, refused: DataFrame, budget: int, depth: int = HALF_DEPTH) -> DataFrame:
    """placed (chunk, pos, ...) with part and file_budget: chunks that a model refused as too large, in halves.

    refused: chunk, part (empty for the whole chunk) of each refusal so far. A refused part becomes its two halves, up to
    `depth` times; what is refused beyond that stays, for the caller to leave out. file_budget: the characters that each
    file of a half may have, an even share of HALF_SHARE of the budget (see compress.fitted); null where nothing was cut."""
    rows = placed.withColumns({"part": F.lit(""), "file_budget": F.lit(None).cast("long")})
    for _ in range(depth):
        hit = refused.select("chunk", "part", F.lit(True).alias("_hit")).distinct()
        own = Window.partitionBy("chunk", "part")
        met = rows.join(hit, ["chunk", "part"], "left").withColumns({"_count": F.count(F.lit(1)).over(own), "_at": F.row_number().over(own.orderBy("pos")) - 1})
        half = halves(F.col("_at"), F.col("_count"))
        first = F.ceil(F.col("_count") / 2)
        files = F.when(half == 0, first).otherwise(F.col("_count") - first)
        cut = F.col("_hit").isNotNull()
        share = F.floor(F.lit(int(budget * HALF_SHARE)) / files).cast("long")
        rows = met.withColumns({"file_budget": F.when(cut, share).otherwise(F.col("file_budget")), "part": F.when(cut, F.concat("part", half.cast("string"))).otherwise(F.col("part"))}).drop("_hit", "_count", "_at")
    return rows
