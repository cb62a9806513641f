"""N-gram Jaccard join by chosen paths: split sets recursively on sampled shared tokens, compare within small buckets by
brute force, in as many independent runs as the target recall asks for."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_batch, join_on_hot, settle, utf8
from gneiss.llm.components import components
from gneiss.llm.shingles import WORDS, mix, shingle_set

SIMILARITY = 0.8
RECALL = 0.9999
#: Levels of splitting, and sets that a bucket may have to be compared as it is.
DEPTH, SMALL = 3, 2_000
#: Places of the sketch that filters pairs in a bucket, and how many standard errors below the threshold a pair still passes.
SKETCH, ERRORS = 128, 6.0
#: Sets and shingles of a block of a group that is compared exactly.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Bits of the filter that says which documents are in a group: so many times the members, up to 2**30.
FILTER_BITS, FILTER_MOST = 32, 1 << 30


def runs_for(recall: float, depth: int = DEPTH, similarity: float = SIMILARITY) -> int:
    """Independent runs after which a pair at the threshold has met with probability `recall`, even if its buckets are
    split down to the last level. A set samples each token with probability 1/(threshold * size) at each level, so a pair
    shares Poisson(>= 1) choices on average and meets at a level with chance 1 - exp(-chance at the next)."""
    shared = min(1.0, 2 * similarity / (1 + similarity) / similarity)
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-shared * meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


#: Tokens that are drawn for together.
_COLUMNS = 1 << 15


def _draw(tokens: np.ndarray, names: np.ndarray) -> np.ndarray:
    """A number per path and token, even and independent for tokens that are hashes."""
    x = (tokens[None, :] ^ names[:, None]) * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def longer_paths(tokens: np.ndarray, paths: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The names of the paths that go one token further than `paths`, sorted and each once.

    Whether a token extends a path depends on the path and the token alone, against 1/(similarity * size)."""
    limit = np.uint64(min(2.0**64 - 2**12, 2.0**64 / (similarity * len(tokens))))
    longer = []
    for at in range(0, len(tokens), _COLUMNS):
        x = _draw(tokens[at : at + _COLUMNS], paths)
        i, j = np.nonzero(x < limit)
        longer.append(mix(x[i, j] + paths[i]))
    return np.unique(np.concatenate(longer))


def first_paths(tokens: np.ndarray, runs: int, similarity: float = SIMILARITY) -> np.ndarray:
    """The paths of one token, of all runs."""
    return longer_paths(tokens, mix(np.arange(1, runs + 1, dtype=np.uint64)), similarity)


def sketch(tokens: np.ndarray) -> bytes:
    """One byte per range of the tokens' hashes: of the least token in it, 0 for none. tokens: sorted."""
    bins = np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - SKETCH.bit_length() + 1)
    first = np.searchsorted(tokens, bins)
    present = np.append(tokens, np.uint64(0))[first]
    inside = (first < len(tokens)) & (present - bins < np.uint64(1 << (64 - SKETCH.bit_length() + 1)))
    return np.where(inside, mix(present) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _set_name(tokens: np.ndarray) -> int:
    return int(_signed(mix((mix(tokens).cumsum(dtype=np.uint64)[-1:] + np.uint64(len(tokens)))))[0]) if len(tokens) else 0


def _prepared(docs: DataFrame, doc_id: str, text: str, words: int, runs: int, similarity: float) -> DataFrame:
    """A row per document: doc_id, name of its shingle set, size, sketch, paths of one token."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, sketches, paths = [], [], [], []
        for data in utf8(batch.column(1)):
            s = shingle_set(data, words)
            names.append(_set_name(s))
            sizes.append(len(s))
            sketches.append(sketch(s) if len(s) else b"")
            paths.append(first_paths(s, runs, similarity).tobytes() if len(s) else b"")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(paths, pa.binary())], ["doc_id", "name", "size", "sketch", "paths"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return by_batch(docs.select(doc_id, text), run, f"doc_id {kind}, name long, size long, sketch binary, paths binary")


def _keys_of(rows: DataFrame) -> DataFrame:
    """(name, key): the paths of one token. rows: (name, paths)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(0).to_numpy(zero_copy_only=False)
        keys = [np.frombuffer(x, np.int64) for x in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(k) for k in keys]), pa.int64()), pa.array(np.concatenate(keys))], ["name", "key"])

    return by_batch(rows.select("name", "paths"), run, "name long, key long")


def _longer_keys(rows: DataFrame, similarity: float) -> DataFrame:
    """(name, key): the paths one token longer than those in above. rows: (name, tokens, above)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(0).to_numpy(zero_copy_only=False)
        keys = [longer_paths(np.frombuffer(t, np.uint64), np.array(above.as_py(), np.int64).view(np.uint64), similarity).view(np.int64) for t, above in zip(utf8(batch.column(1)), batch.column(2))]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(k) for k in keys]), pa.int64()), pa.array(np.concatenate(keys))], ["name", "key"])

    return by_batch(rows.select("name", "tokens", "above"), run, "name long, key long")


def _forest(names: np.ndarray, sketches: np.ndarray, blocks: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges that tie together the sets whose sketches may mean the wanted similarity; fewer than the sets. Sets with equal
    labels are tied already."""
    filled = sketches > 0
    edges = []
    for i in range(len(names) - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if blocks[i] >= 0:  # blocks of a large bucket: only pairs across them, the pairs inside are another task's
            others = others[blocks[others] != blocks[i]]
        if not len(others):
            continue
        same = ((sketches[others] == sketches[i]) & filled[i]).sum(1)
        either = (filled[others] | filled[i]).sum(1)
        near = others[same >= either * (SIMILARITY - ERRORS * 0.4 / np.sqrt(np.maximum(either, 1)))]
        if len(near):
            met, first = np.unique(label[near], return_index=True)
            edges += [(int(names[i]), int(names[j])) for j in near[first]]
            label[np.isin(label, met)] = label[i]
    return edges


def _ties(buckets: DataFrame) -> DataFrame:
    """(a, b) from rows (members array of struct(name, sketch, block)): see _forest.

    Buckets with the same least set go to one task, which remembers what it has tied: the runs gather the same sets again
    and again, and each tie is written once per task."""

    def run(batches):
        above: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                rows = sorted(members.as_py(), key=lambda r: r["name"])
                names = np.array([r["name"] for r in rows])
                label = np.unique(np.array([find(n) for n in names.tolist()]), return_inverse=True)[1]
                sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(-1, SKETCH)
                for x, y in _forest(names, sketches, np.array([r["block"] for r in rows]), label):
                    above[find(y)] = find(x)
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.repartition("lead").select("members").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, group: str, parts: str, block: str) -> DataFrame:
    """rows dealt to the pairs of blocks of their group: (group, lo, hi, ...). A group of p parts has p*(p+1)/2 pairs."""
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return dealt.withColumns({"lo": F.least(block, "_other"), "hi": F.greatest(block, "_other")}).drop("_other")


def _candidate_edges(rows: DataFrame, facts: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges between sets that met in a bucket and whose sketches pass. rows: (name, sketch, paths), a set once or more often;
    facts: (name, rep); docs: (doc_id, text), from which the sets in large buckets are made again to be split."""
    found = []
    sketches = rows.select("name", "sketch")
    keys = _keys_of(rows)
    for level in range(DEPTH):
        # Copies of a set meet by key and set, counts are summed before they meet by key, and keys that a large part of all
        # sets chose meet by broadcast.
        keys = settle(keys.distinct(), f"paths{level}")
        counts = settle(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"counts{level}")
        met = settle(join_on_hot(keys, counts, "key", "n", keys.count()), f"met{level}")
        last = level == DEPTH - 1
        members = met.where(F.col("n") <= SMALL).select("key", "name", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(-1).alias("block"))
        if last:
            many = met.where(F.col("n") > SMALL).withColumn("parts", F.ceil(F.col("n") / (SMALL // 2)).cast("int"))
            many = many.withColumn("block", F.pmod(F.xxhash64("name", "key"), F.col("parts")).cast("int"))
            pairs = _blocks(many, "key", "parts", "block")
            # Pairs within a block belong to the task (block, block), where every row has block -1: all pairs count.
            pairs = pairs.withColumn("block", F.when(F.col("lo") == F.col("hi"), -1).otherwise(F.col("block")))
            members = members.unionByName(pairs.select(*members.columns))
        small = members.join(_once(sketches, members.select("name").distinct()), "name")
        small = small.groupBy("key", "lo", "hi").agg(F.collect_list(F.struct("name", "sketch", "block")).alias("members"), F.min("name").alias("lead"))
        found.append(settle(_ties(small).distinct(), f"ties{level}"))
        if not last:
            large = settle(met.where(F.col("n") > SMALL).groupBy("name").agg(F.collect_list("key").alias("above")), f"large{level}")
            if not large.limit(1).count():
                break
            keys = _longer_keys(_with_tokens(docs, words, large.join(facts.select("name", "rep"), "name")), similarity)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def _once(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """facts (name, ...) of the wanted names, each once. A bitmap of bounded size lets few others through to the join."""
    passed = Bitmap.of(wanted, "name").let_through(facts, "name")
    return passed.join(wanted, "name", "left_semi").dropDuplicates(["name"])


def _exact(names: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, blocks: np.ndarray, similarity: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many documents each set is linked to within this pair of blocks, and edges that tie the linked sets.

    Intersections are counted by products of token columns, some thousand tokens at a time; only tokens of two sets or more count."""
    n = len(names)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    tokens, index, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = freq > 1
    column = np.cumsum(shared) - 1
    keep = shared[index]
    owner, index = owner[keep], column[index[keep]]
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    common = np.zeros((n, n), np.float32)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(index, [start, start + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], index[a:b] - start] = 1
        common += m @ m.T
    linked = common * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-4
    np.fill_diagonal(linked, False)
    if (blocks >= 0).all() and len(set(blocks.tolist())) > 1:  # two blocks: pairs inside one are another task's
        linked &= blocks[:, None] != blocks[None, :]
    links = linked @ copies
    edges, reached = [], np.zeros(n, bool)
    for i in range(n):  # a walk from each set not reached yet ties a component to its first set
        if reached[i]:
            continue
        reached[i] = True
        front = [i]
        while front:
            near = np.flatnonzero(linked[front].any(0) & ~reached)
            reached[near] = True
            edges += [(int(names[i]), int(names[j])) for j in near]
            front = near.tolist()
    return links, edges


def _group_links(groups: DataFrame, similarity: float) -> DataFrame:
    """From rows (members array of struct(name, tokens, copies, block)): (name, links) and, with links null, edges (name, other)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out_name, out_links, out_other = [], [], []
        for members in batch.column(0):
            rows = sorted(members.as_py(), key=lambda r: r["name"])
            names = np.array([r["name"] for r in rows])
            links, edges = _exact(names, [np.frombuffer(r["tokens"], np.uint64) for r in rows], np.array([r["copies"] for r in rows]), np.array([r["block"] for r in rows]), similarity)
            out_name += names.tolist() + [a for a, _ in edges]
            out_links += links.tolist() + [None] * len(edges)
            out_other += [None] * len(names) + [b for _, b in edges]
        return pa.RecordBatch.from_arrays([pa.array(out_name, pa.int64()), pa.array(out_links, pa.int64()), pa.array(out_other, pa.int64())], ["name", "links", "other"])

    return by_batch(groups, run, "name long, links long, other long", rows=4)


class Bitmap:
    """A set of numbers, by bits at their hashes: some others pass too. It has FILTER_BITS bits a member, FILTER_MOST at
    most, so its size is bounded; beyond that more pass and the joins behind it do more."""

    def __init__(self, bits: int, flat: np.ndarray) -> None:
        self.bits, self.flat = bits, flat

    @classmethod
    def of(cls, members: DataFrame, column: str) -> Bitmap:
        count = members.count()
        bits = min(FILTER_MOST, max(1 << 16, 1 << (FILTER_BITS * max(1, count)).bit_length()))
        slot = (F.pmod(F.xxhash64(column), F.lit(bits)) + 1).alias("slot")
        parts = members.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map")).collect()
        flat = np.zeros(bits // 8, np.uint8)
        for r in parts:  # part 1 has the slots from 1 on
            own = np.frombuffer(bytes(r["map"]), np.uint8)
            flat[(r["part"] - 1) * len(own) : r["part"] * len(own)] = own
        return cls(bits, flat)

    def slot(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def passes(self, slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((self.flat[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool))

    def let_through(self, rows: DataFrame, column: str) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(self)
        kept = rows.columns

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.select(list(range(len(kept)))).filter(held.value.passes(batch.column(len(kept))))

        return by_batch(rows.select(*kept, self.slot(column).alias("_slot")), run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def _tokens_of(docs: DataFrame, words: int, bitmap: Bitmap) -> DataFrame:
    """(doc_id, name, tokens) of those docs (doc_id, text) that the bitmap lets through. One step of Python does both: two in
    a row would take two workers for each task, which live on beside the executor."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(held.value.passes(batch.column(2)))
        sets = [shingle_set(d, words) for d in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "name", "tokens"])

    rows = docs.select("doc_id", "text", bitmap.slot("doc_id").alias("_slot"))
    return by_batch(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name long, tokens binary")


def _with_tokens(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """wanted (name, rep, ...) with the set's tokens, without rep. docs: (doc_id, text). rep is a document with the set; the
    bitmap may let others through, and one of those with the set is enough."""
    met = _tokens_of(docs, words, Bitmap.of(wanted.select("rep"), "rep")).join(wanted, "name")
    return met.where(F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep").dropDuplicates(["name"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """A row per row of docs: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least `similarity`. A
    class is a connected component of the links; class_id is its least doc_id, n_links the number of other rows that a row
    is linked to, copies included. Words are runs without ASCII white space, as they stand; a text of one to four words
    has one shingle, of all of them; a null text or one without words is linked to nothing. Rows with the same doc_id
    count as documents of their own. Empty table: no rows; other columns are not read.

    Equal sets are one from the start. Chosen paths bring sets together in buckets; a bucket of up to SMALL sets is
    compared by brute force on sketches, a larger one is split on a further token, and one still large at the last level
    is compared in pairs of blocks. The sets that pass form groups, and each group is compared exactly, all its pairs, in
    pairs of blocks where it is large. So the links found are exact, and missing one takes every run missing it, or sketches,
    the same in every run, that differ by ERRORS standard errors (1e-6 at most; runs_for leaves room for it). No step
    writes out pairs: buckets and groups give spanning edges and counts. Nothing but a bitmap of bounded size and counts
    reaches the driver."""
    runs = runs_for(recall, similarity=similarity)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = settle(_prepared(named, "doc_id", "text", words, runs, similarity), "sets")
    facts = settle(rows.where("size > 0").groupBy("name").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")), "distinct")
    groups = components(_candidate_edges(rows.where("size > 0").select("name", "sketch", "paths"), facts, named, words, similarity))
    members = settle(groups.withColumnRenamed("node", "name").join(facts, "name"), "members")
    count = members.count()
    own = rows.select("doc_id", "name", "size")
    facts = facts.select("name", "copies", "rep")
    if not count:
        met = own.join(facts, "name", "left")
        return met.select("doc_id", F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("size") > 0, F.col("copies") - 1).otherwise(0).alias("n_links"))
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.least(F.col("n"), F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int").alias("parts")
    placed = members.join(sizes.select("label", parts), "label").withColumn("block", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    met = _with_tokens(named, words, placed.select("name", "rep", "label", "copies", "parts", "block"))
    dealt = _blocks(settle(met, "tokens"), "label", "parts", "block")
    tasks = dealt.groupBy("label", "lo", "hi").agg(F.collect_list(F.struct("name", "tokens", "copies", "block")).alias("members"))
    found = settle(_group_links(tasks.select("members"), similarity), "links")
    links = found.where(F.col("links").isNotNull()).groupBy("name").agg(F.sum("links").alias("links"))
    classes = components(found.where(F.col("other").isNotNull()).select(F.col("name").alias("a"), F.col("other").alias("b")))
    labelled = facts.join(classes.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    result = labelled.join(least, "label").join(links, "name", "left").select("name", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    met = own.join(result, "name", "left")
    return met.select("doc_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("size") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without those that are in the class of a row with a smaller doc_id (null: the largest) or the same
    and a smaller digest of the text. Of rows with the same doc_id and text one stays. A document without words stays."""
    names = docs.columns  # of any kind: the columns are numbered meanwhile
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"))
    classes = near_duplicates(docs.select(key.alias("_key"), text), "_key", text, **options)
    kept = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, key == F.col("_kept"), "left_semi")
    # Repeated rows are few or none: only theirs are shuffled with their texts.
    digests = rows.select(F.col(doc_id).alias("_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_digest"))
    again = settle(digests.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_id").alias("_again")).distinct(), "again")
    if not again.limit(1).count():
        return rows.toDF(*names)
    once = rows.join(again, rows[doc_id].eqNullSafe(again["_again"]), "left_anti")
    return once.unionByName(rows.join(again, rows[doc_id].eqNullSafe(again["_again"]), "left_semi").dropDuplicates([doc_id, text])).toDF(*names)
