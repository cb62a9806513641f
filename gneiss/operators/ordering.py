"""Numbers of rows in one order over a whole table, without a window that is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is dealt to, at most; a bounded number of counts reaches the driver's plan by broadcast.
RANGES = 1_000
#: Rows of a range at least, so that small tables are one.
RANGE_ROWS = 10_000


def _place(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most value, by bisection. The bounds stand in the plan once: a step that named
    the step before in an expression of its own would write out four to the power of the steps. The value goes from step to
    step beside the place: with it named within the step, Spark has filtered the other side of a join by a column it lacks."""
    if not bounds:
        return F.lit(0)
    sizes = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(so_far: Column, size: Column) -> Column:
        place, v = so_far["place"], so_far["value"]
        further = (place + size <= len(bounds)) & (F.get(F.lit(bounds), place + size - 1) <= v)
        return F.struct((place + F.when(further, size).otherwise(0)).alias("place"), v.alias("value"))

    return F.aggregate(F.lit(sizes), F.struct(F.lit(0).alias("place"), value.alias("value")), step, lambda so_far: so_far["place"])


def row_numbers(rows: DataFrame, lead: str, then: list[str], out: str, descending: bool = False, group: list[str] | None = None) -> DataFrame:
    """rows with `out`, a long from 1 on in order of lead (a number), then `then` (ascending), within each group or over all.
    Null leads come first (last if descending), and with one and the same lead rows stay in one range. Null groups are one.

    Ranges are cut at approximate quantiles of lead; each numbers its own rows of each group, and what comes before it in
    the group is added from a table of one row per range and group. So a group that has most rows is dealt over the ranges."""
    count = rows.count()
    ranges = max(1, min(RANGES, count // RANGE_ROWS))
    bounds = rows.agg(F.percentile_approx(F.col(lead).cast("double"), [i / ranges for i in range(1, ranges)], 10 * RANGES)).first()[0] if ranges > 1 else None
    bounds = sorted(set(bounds or []))
    place = _place(F.col(lead).cast("double"), bounds)
    # Groups by columns that are never null, so that windows and join share one partitioning.
    keys = {f"_v{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(group or [])} | {f"_z{i}": F.col(c).isNull() for i, c in enumerate(group or [])}
    dealt = rows.withColumns({**keys, "_range": F.when(F.col(lead).isNull(), F.lit(-1)).otherwise(place)})
    by = [*keys, "_range"]
    order = [F.desc_nulls_last(lead) if descending else F.asc_nulls_first(lead), *then]
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    turn = F.desc("_range") if descending else F.asc("_range")
    sums = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*by, before.alias("_start"))
    # Without groups, starts has RANGES + 1 rows at most; with them it may be as long as rows, whatever Spark guesses.
    met = dealt.withColumn("_in", inside).join(starts.hint("merge") if keys else F.broadcast(starts), by)
    return met.withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).drop(*by, "_in", "_start")
