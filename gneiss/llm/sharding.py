"""K-d tree partitioning: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import buckets_for, join_on_hot, order_numbers, running_total, settle

#: Histogram rows that one round brings to the driver at most, over all nodes of a level.
ROUND_ROWS = 32_768
#: A split point is final once the bin that holds it weighs this part of a leaf at most.
TOLERANCE = 5e-4
COORDINATE_BITS, TIE_BITS = 31, 31


#: Different strings of a dimension up to which their ranks are broadcast; more of them meet the rows by a shuffle.
BROADCAST_VALUES = 50_000


def _ranked(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with out: the rank of a string among the different ones of its column, by code point; null: null."""
    counts = settle(df.groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_n")), "values")
    ranks = order_numbers(counts, "_value").withColumnRenamed("_rank", out)
    if counts.count() <= BROADCAST_VALUES:
        return df.join(F.broadcast(ranks), df[name] == ranks["_value"], "left").drop("_value")
    rows = settle(df.withColumn("_value", F.col(name)), "named")
    total = counts.agg(F.sum("_n")).first()[0]
    met = join_on_hot(rows.where(F.col(name).isNotNull()), ranks.join(counts, "_value"), "_value", "_n", total)
    return met.drop("_value", "_n").unionByName(rows.where(F.col(name).isNull()).withColumn(out, F.lit(None).cast("long")).drop("_value"))


def coordinates(df: DataFrame, dims: list[str]) -> DataFrame:
    """df with _c0, _c1, ...: each dimension scaled to whole numbers from 0 below 2**31; null lowest. Strings count by rank."""
    for i, d in enumerate(dims):
        df = _ranked(df, d, f"_n{i}") if isinstance(df.schema[d].dataType, T.StringType) else df.withColumn(f"_n{i}", F.col(d).cast("double"))
    ends = df.agg(*[f(f"_n{i}").alias(f"{k}{i}") for i in range(len(dims)) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    top = float((1 << COORDINATE_BITS) - 2)
    for i in range(len(dims)):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        scaled = F.lit(0.0) if lo is None or hi <= lo else (F.col(f"_n{i}") - F.lit(lo)) / F.lit(float(hi) - float(lo)) * F.lit(top)
        df = df.withColumn(f"_c{i}", F.coalesce(F.floor(scaled).cast("long") + 1, F.lit(0).cast("long")) if lo is not None else F.lit(0).cast("long")).drop(f"_n{i}")
    return df


def _numbers(values: list[int]) -> Column:
    """A constant array: a few numbers per node, following the shards and not the rows."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _of(values: dict[int, int]) -> Column:
    """The value for _node; 0 where none is given."""
    return F.get(_numbers([values.get(i, 0) for i in range(max(values) + 1)]), F.col("_node"))


class _Tree:
    """Nodes by number: dimension (-1: a leaf), the first key that goes right, the left child (the right one is next)."""

    def __init__(self) -> None:
        self.dim, self.at, self.left, self.depth = [-1], [0], [0], 0

    def split(self, node: int, dim: int, at: int) -> tuple[int, int]:
        self.dim[node], self.at[node], self.left[node] = dim, at, len(self.dim)
        for column, value in ((self.dim, -1), (self.at, 0), (self.left, 0)):
            column += [value, value]
        return self.left[node], self.left[node] + 1

    def leaf(self, dims: list[str]) -> Column:
        """The number of the leaf that a row comes to, walking down from the root."""
        dim, at, left = _numbers(self.dim), _numbers(self.at), _numbers(self.left)
        coordinates_ = F.array(*[F.col(c) for c in dims])

        def step(node: Column, _: Column) -> Column:
            key = F.shiftleft(F.get(coordinates_, F.get(dim, node).cast("int")), TIE_BITS) + F.col("_tie")
            return F.when(F.get(dim, node) < 0, node).otherwise((F.get(left, node) + (key >= F.get(at, node)).cast("int")).cast("int"))

        if not self.depth:
            return F.lit(0)
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step)


def _split_points(rows: DataFrame, dims: list[str], nodes: dict[int, tuple[int, int, int, float]], slack: float) -> dict[int, int]:
    """node: the key up to which (exclusive) the left part goes. nodes: node: (dimension, lowest key, end key, weight wanted left).

    Each round sums weights in equal bins of each node's open interval and goes on in the bin that the wanted weight
    falls into, until that bin is light or holds one key."""
    state = {k: (d, lo, hi, want) for k, (d, lo, hi, want) in nodes.items()}
    found: dict[int, int] = {}
    bins = max(2, min(1024, ROUND_ROWS // max(1, len(nodes))))
    while state:
        table = [(k, hi) for k, (_, _, hi, _) in state.items()]
        width = {k: -(-(hi - lo) // bins) for k, (_, lo, hi, _) in state.items()}
        met = rows.withColumn("_dim", _of({k: v[0] for k, v in state.items()}).cast("int")).withColumn("_key", _key(dims))
        met = met.withColumns({"_lo": _of({k: v[1] for k, v in state.items()}), "_hi": _of({k: v[2] for k, v in state.items()}), "_width": _of(width)})
        inside = met.where((F.col("_key") >= F.col("_lo")) & (F.col("_key") < F.col("_hi")))
        sums = inside.groupBy("_node", F.expr("(_key - _lo) div _width").alias("_bin")).agg(F.sum("_weight").alias("_sum"), F.min("_key").alias("_first"), F.max("_key").alias("_last")).collect()
        per: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for r in sums:
            per[r["_node"]].append((r["_bin"], r["_sum"], r["_first"], r["_last"]))
        for k, hi in table:
            d = state[k][0]
            want, run = state[k][3], 0.0
            for _, weight, first, last in sorted(per[k]):
                if run + weight >= want:
                    if weight <= slack or first == last:
                        found[k] = first if want - run < run + weight - want else last + 1
                    else:
                        state[k] = (d, first, last + 1, want - run)
                    break
                run += weight
            else:
                found[k] = hi
            if k in found:
                del state[k]
    return found


def _key(dims: list[str]) -> Column:
    chosen = F.element_at(F.array(*[F.col(c) for c in dims]), F.col("_dim") + 1)
    return F.shiftleft(chosen, TIE_BITS) + F.col("_tie")


def kd_partition(df: DataFrame, dims: list[str], weight: str, ties: list[str], shards: int | None = None, target: int | None = None) -> DataFrame:
    """df with _shard, leaves of a k-d tree numbered from 0 in tree order.

    weight: a column of whole numbers. Give the number of shards, or the target weight of a leaf. A node of n leaves is
    split along the dimension that is widest in it (range in the node over range in the table; ties: the first named),
    at the weighted n//2 : n-n//2 quantile; equal coordinates are told apart by a hash of `ties`, so a hot value is
    split too and leaves come out near equal by weight. Rows equal in every dimension and tie stay together. Only
    histograms of a bounded number of rows reach the driver. Null in a dimension: lowest. Fewer rows than shards: some
    shards stay empty. Empty table: no rows. Extra columns are kept; names starting with _ are this operator's."""
    tie = F.xxhash64(*[F.col(c) for c in ties]).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    rows = coordinates(df.withColumn("_weight", F.col(weight).cast("long")).withColumn("_tie", tie), dims)
    rows = settle(rows, "kd")
    total = rows.agg(F.sum("_weight")).first()[0] or 0
    n = shards if shards is not None else max(1, round(total / max(1, target or 1)))
    slack = TOLERANCE * total / max(1, n)
    names = [f"_c{i}" for i in range(len(dims))]
    tree, leaves = _Tree(), {0: (0, n)}  # leaf of the tree: its first shard, its number of shards
    while open_nodes := {k: v for k, v in leaves.items() if v[1] > 1}:
        placed = rows.withColumn("_node", tree.leaf(names))
        ends = placed.groupBy("_node").agg(F.sum("_weight").alias("w"), *[f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        wanted = {}
        for r in ends:
            if r["_node"] in open_nodes:
                d = max(range(len(names)), key=lambda i: (r[f"hi{names[i]}"] - r[f"lo{names[i]}"], -i))
                count = open_nodes[r["_node"]][1]
                wanted[r["_node"]] = (d, r[f"lo{names[d]}"] << TIE_BITS, (r[f"hi{names[d]}"] + 1) << TIE_BITS, r["w"] * (count // 2) / count)
        points = _split_points(placed, names, wanted, slack)
        for k, (first, count) in open_nodes.items():
            del leaves[k]
            if k in points:
                low, high = tree.split(k, wanted[k][0], points[k])
                leaves[low], leaves[high] = (first, count // 2), (first + count // 2, count - count // 2)
            else:  # no row comes here
                leaves[k] = (first, 1)
        tree.depth += 1
    shard = F.get(_numbers([leaves.get(i, (0, 1))[0] for i in range(len(tree.dim))]), F.col("_node")).cast("int")
    return rows.withColumn("_node", tree.leaf(names)).withColumn("_shard", shard).drop("_node", "_tie", "_weight", *names)


def slots(df: DataFrame, shard: str, ties: list[str], rows: int) -> DataFrame:
    """df with _slot: a gapless number from 0 within its shard; a large shard is numbered in buckets, not in one task."""
    keyed = df.withColumn("_key", F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ties]))).withColumn("_one", F.lit(1).cast("long"))
    return running_total(keyed, [shard], "_key", ties, "_one", "_slot", buckets_for(rows)).drop("_key", "_one")
