"""Scores, roll-ups, first-wins duplicates, ordering and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X
from gneiss.operators.ordering import row_numbers
from gneiss.sources import scratch


def penalty(severity: Column) -> Column:
    return X.lookup(R.PENALTY, severity, F.lit(1))


def score_of(total_penalty: Column, loc: Column | None = None) -> Column:
    """100 less the penalty per thousand lines (a thousand at least), as a whole number from 0 to 100."""
    per = total_penalty / F.greatest(F.lit(1.0), loc / F.lit(1000.0)) if loc is not None else total_penalty * F.lit(1.0)
    return F.least(F.lit(100), F.greatest(F.lit(0), X.rounded(F.lit(100.0) - per))).cast("int")


def lines_of_code(files: DataFrame) -> DataFrame:
    return files.agg(F.greatest(F.coalesce(F.sum(X.loc(F.col("content"))), F.lit(0)), F.lit(1)).alias("loc"))


def scores_by(issues: DataFrame, files: DataFrame, key) -> DataFrame:
    """(dir, n_issues, penalty, loc, score, letter) for each value of key (a column of a path)."""
    sums = issues.groupBy(key(F.col("file")).alias("dir")).agg(F.count(F.lit(1)).alias("n_issues"), F.sum(penalty(F.col("severity"))).alias("penalty"))
    sizes = files.groupBy(key(F.col("path")).alias("dir")).agg(F.greatest(F.sum(X.loc(F.col("content"))), F.lit(1)).alias("loc"))
    met = sizes.join(sums, "dir", "left").na.fill({"n_issues": 0, "penalty": 0})
    scored = met.withColumn("score", score_of(F.col("penalty"), F.col("loc")))
    return scored.withColumn("letter", X.graded(F.col("score"), 1))


def first_wins(issues: DataFrame, order: list[str]) -> DataFrame:
    """One row per (file, line, type), the first in order; a missing line is a line of its own."""
    place = Window.partitionBy("file", "line", "type").orderBy(*order)
    return issues.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def count_by(issues: DataFrame, *columns: str) -> DataFrame:
    return issues.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def type_rollup(issues: DataFrame, width: int = 10) -> DataFrame:
    """(type, n, worst, worst_label, bar): the worst severity of each type; the bar is scaled to the largest type."""
    place = {s: i for i, s in enumerate(R.SEVERITIES)}
    per = issues.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.least(F.min(X.severity_rank(F.col("severity"), place, 999)), F.lit(3)).alias("rank"))
    worst = F.element_at(F.array(*[F.lit(s) for s in R.SEVERITIES]), F.col("rank") + 1)
    scaled = per.withColumn("most", F.max("n").over(Window.partitionBy()))
    return scaled.select("type", "n", "rank", worst.alias("worst"), F.initcap(worst).alias("worst_label"), X.mini_bar(F.col("n"), F.col("most"), width).alias("bar"))


def severity_share(issues: DataFrame) -> DataFrame:
    per = count_by(issues, "severity")
    return per.select("severity", "n", X.rounded(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


def source_totals(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count_if(F.col("source") == "local").alias("local"), F.count_if(F.col("source") == "ai").alias("ai"), F.count_if(~F.col("source").eqNullSafe("local") & ~F.col("source").eqNullSafe("ai")).alias("other"))


def extension_top(files: DataFrame, most: int = 5) -> DataFrame:
    return files.groupBy(F.coalesce(F.nullif("ext", F.lit("")), F.lit("other")).alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(most)


def score_change(issues: DataFrame) -> DataFrame:
    """(score_before, score_after): over all issues, and over those not fixed."""
    p = penalty(F.col("severity"))
    return issues.agg(score_of(F.coalesce(F.sum(p), F.lit(0))).alias("score_before"), score_of(F.coalesce(F.sum(F.when(~F.col("status").eqNullSafe("fixed"), p)), F.lit(0))).alias("score_after"))


def pass_totals(passes: DataFrame) -> DataFrame:
    sums = passes.agg(F.sum("found").alias("found"), F.max("found").alias("most_found"), F.sum("fixed").alias("fixed"), F.max("fixed").alias("most_fixed"), F.sum("skipped").alias("skipped"), F.sum("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("passes"))
    return sums.withColumn("duration", X.duration(F.col("duration_ms")))


def by_type_fixed(issues: DataFrame) -> DataFrame:
    """by_type: a map of the numbers of fixed issues."""
    per = count_by(issues.where("status = 'fixed'"), "type")
    return per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"))


def dashboard_facts(history: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("run", "score", "passes", "agent", "date"), "run")
    facts = history.agg(F.count(F.lit(1)).alias("runs"), F.sum("fixed").alias("total_fixed"), last.alias("last"))
    return facts.select("runs", "total_fixed", "last.*").withColumn("grade", X.dashboard_grade(F.col("score")))


def by_severity(issues: DataFrame, seq: str = "seq") -> DataFrame:
    """Worst first; equals stay in order."""
    return issues.orderBy(X.severity_rank(F.col("severity"), R.RANK_DOWN, 9), seq)


def top_issues(issues: DataFrame, most: int, seq: str = "seq") -> DataFrame:
    """The worst `most` issues; 0: all."""
    return by_severity(issues, seq).limit(most) if most else issues


def last_fixed(issues: DataFrame, most: int = 20, seq: str = "seq") -> DataFrame:
    return issues.where("status = 'fixed'").orderBy(F.desc(seq)).limit(most)


def batches(rows: DataFrame, order: list[str], size: int = 8, group: list[str] | None = None) -> DataFrame:
    """rows with batch and index, in batches of `size` within each group, or over all rows. order begins with a number, by
    which large groups are dealt to many tasks."""
    n = row_numbers(rows, order[0], order[1:], "_n", group=group).withColumn("_n", F.col("_n") - 1)
    return n.withColumns({"batch": F.floor(F.col("_n") / size).cast("int"), "index": (F.col("_n") % size).cast("int")}).drop("_n")


def clusters(issues: DataFrame, size: int = 10, seq: str = "seq") -> DataFrame:
    """(cluster_rank, directory, batch, n, n_files, worst): top directories' issues, worst first, in batches of `size`;
    clusters by their worst severity, then by the first appearance of their directory, then batch. seq: from 0 to 2**48.

    A directory with nearly all issues is dealt to many tasks: severity and seq are one number, whose ranges are numbered
    apart, and a directory's first appearance is summed before it moves."""
    as_one = lambda rank, n: F.shiftleft(rank.cast("long"), 48) + n
    rows = issues.select("file", F.col(seq).alias("_seq"), X.top_dir(F.col("file")).alias("directory"), X.severity_rank(F.col("severity"), R.RANK_DOWN, 9).alias("_rank"))
    rows = batches(rows.withColumn("_order", as_one(F.col("_rank"), F.col("_seq"))), ["_order"], size, ["directory"])
    per = rows.groupBy("directory", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"), F.min("_rank").alias("worst"), F.min("_seq").alias("_seq"))
    first = per.groupBy("directory").agg(F.min("_seq").alias("_first"))
    per = scratch.settled(per.drop("_seq").join(first, "directory"), "clusters")  # read three times to be numbered
    ranked = row_numbers(per.withColumn("_lead", as_one(F.col("worst"), F.col("_first"))), "_lead", ["batch"], "cluster_rank")
    return ranked.drop("_first", "_lead")


def split_status(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    return issues.where("status = 'fixed'"), issues.where("status = 'skipped'")


def newest_first(history: DataFrame, order: str = "run") -> DataFrame:
    """history with place: 1 for the last run."""
    return row_numbers(history, order, [], "place", descending=True)
