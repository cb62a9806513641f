"""What became of issues that agents worked on: reported results, changed files, picked commits; request budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X


# The reasons for a skip in the functions below.
def match_results(issues: DataFrame, results: DataFrame) -> DataFrame:
    """issues with status and skip_reason: the first result (by ord) for the file that names the line, or none, decides.

    issues: cluster_id, seq, file, line; results: cluster_id, ord, file, line, status, reason.

    Results become one row for each line that they name and one for those that name none, before they meet the issues: so a
    file with n issues and n results costs 2n rows, not their pairs."""
    r = results.select("cluster_id", "file", F.nullif("line", F.lit(0)).alias("line"), F.struct("ord", "status", "reason").alias("_r"))
    named, unnamed = r.where(F.col("line").isNotNull()), r.where(F.col("line").isNull())
    for_file = unnamed.groupBy("cluster_id", "file").agg(F.min_by("_r", "_r.ord").alias("_any"))
    for_line = named.groupBy("cluster_id", "file", "line").agg(F.min_by("_r", "_r.ord").alias("_own"))
    own = issues.select("cluster_id", "seq", "file", "line")
    met = own.join(for_file.hint("merge"), ["cluster_id", "file"], "left").join(for_line.hint("merge"), ["cluster_id", "file", "line"], "left")
    first = met.withColumn("r", F.when(F.col("_own.ord") < F.col("_any.ord"), F.col("_own")).otherwise(F.coalesce("_any", "_own")))
    status = F.when(F.col("r.status") == "fixed", "fixed").otherwise("skipped")
    reason = F.when(F.col("r.status") == "fixed", F.lit(None)).when(F.col("r.status") == "skipped", F.coalesce(F.nullif(F.col("r.reason"), F.lit("")), F.lit("Agent could not fix"))).otherwise("No result reported by agent")
    return first.select("cluster_id", "seq", "file", "line", status.alias("status"), reason.alias("skip_reason")).distinct()


def infer_from_changes(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """issues with status: fixed if the cluster changed their file, else skipped; clusters that fixed none have no rows."""
    met = issues.join(changed.select("cluster_id", "file").distinct().withColumn("_c", F.lit(True)), ["cluster_id", "file"], "left")
    any_fixed = met.where("_c").select("cluster_id").distinct()
    rows = met.join(any_fixed, "cluster_id", "left_semi")
    return rows.select("cluster_id", "seq", "file", F.when(F.col("_c"), "fixed").otherwise("skipped").alias("status"), F.when(F.col("_c"), F.lit(None)).otherwise("Agent did not modify this file").alias("skip_reason"))


def attach_commits(fixed: DataFrame, commits: DataFrame) -> DataFrame:
    """fixed issues with commit_sha of the first picked commit that touches their file; without one: skipped."""
    first = commits.groupBy("file").agg(F.min_by("sha", "ord").alias("commit_sha"))
    met = fixed.join(first, "file", "left")
    lost = F.col("commit_sha").isNull()
    return met.select("seq", "file", F.when(lost, "skipped").otherwise("fixed").alias("status"), F.when(lost, "Cherry-pick conflict — fix lost").alias("skip_reason"), "commit_sha")


def tiers(spark) -> DataFrame:
    return spark.createDataFrame([m[:2] + m[6:] for m in R.MODELS], "model string, per_day int, tier string")


def remaining_requests(usage: DataFrame, today: Column) -> DataFrame:
    """(model, tier, used, remaining) of every known model today. usage: model, date, requests_used."""
    used = usage.where(F.col("date") == today).groupBy("model").agg(F.sum("requests_used").alias("used"))
    met = tiers(usage.sparkSession).join(used, "model", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return met.select("model", "tier", "used", F.greatest(F.lit(0), F.col("per_day") - F.col("used")).alias("remaining"))


def record_requests(usage: DataFrame, today: Column, model: str, requests: int = 1) -> DataFrame:
    """usage to be kept: today's rows, one per model, with the requests just made; other days are done with."""
    made = usage.sparkSession.createDataFrame([(model, requests)], "model string, requests_used int").select("model", today.alias("date"), "requests_used")
    rows = usage.where(F.col("date") == today).select("model", "date", "requests_used").unionByName(made)
    return rows.groupBy("model", "date").agg(F.sum("requests_used").alias("requests_used"))


def budget_level(remaining: DataFrame, primary: str) -> DataFrame:
    """(total, own, level): critical under 15 in all; flush from 20 of the primary model or 40 in all; else normal."""
    sums = remaining.agg(F.sum("remaining").alias("total"), F.coalesce(F.max(F.when(F.col("model") == primary, F.col("remaining"))), F.lit(0)).alias("own"))
    level = F.when(F.col("total") < 15, "critical").when((F.col("own") >= 20) | (F.col("total") >= 40), "flush").otherwise("normal")
    return sums.withColumn("level", level)


def choose_model(remaining: DataFrame, tier: str | None = None) -> DataFrame:
    """The model of a tier with most requests left (ties: the first by name), if any has one left."""
    rows = remaining.where("remaining > 0")
    rows = rows.where(F.col("tier") == tier) if tier else rows
    return rows.orderBy(F.desc("remaining"), "model").limit(1).select("model")


def commit_messages(issues: DataFrame) -> DataFrame:
    return issues.select("seq", X.commit_message(F.col("type"), F.col("description")).alias("message"))


# What tells how a repository is tested, in order: files at its root (any of them), a folder that must be
# there too, the command. A package.json counts if it names a test script.
TEST_COMMANDS = (
    (("package.json",), None, "npm test"), (("Cargo.toml",), None, "cargo test"), (("go.mod",), None, "go test ./..."), (("pytest.ini", "pyproject.toml"), None, "python -m pytest"),
    (("build.gradle", "build.gradle.kts"), None, "./gradlew test"), (("pom.xml",), None, "mvn test"), (("Gemfile",), "spec", "bundle exec rspec"), (("Gemfile",), "test", "bundle exec rake test"),
    (("phpunit.xml", "phpunit.xml.dist"), None, "vendor/bin/phpunit"), (("mix.exs",), None, "mix test"), (("Makefile",), None, "make test"),
)


def commands_for_tests(files: DataFrame) -> DataFrame:
    """(repo, command): the first way of testing that a repository's files show; empty if none. files: repo, path, content."""
    script = F.get_json_object("content", "$.scripts.test")
    scripted = F.coalesce(script.isNotNull() & (script != "") & ~script.contains("no test specified"), F.lit(False))
    facts = []
    for i, (names, folder, _) in enumerate(TEST_COMMANDS):
        there = F.col("path").isin(*names) & (scripted if "package.json" in names else F.lit(True))
        facts.append(F.bool_or(there).alias(f"_file{i}"))
        if folder:
            facts.append(F.bool_or(F.col("path").startswith(f"{folder}/") | (F.col("path") == folder)).alias(f"_folder{i}"))
    rows = files.groupBy("repo").agg(*facts)
    command: Column | None = None
    for i, (_, folder, text) in enumerate(TEST_COMMANDS):
        test = F.col(f"_file{i}") & F.col(f"_folder{i}") if folder else F.col(f"_file{i}")
        command = F.when(test, text) if command is None else command.when(test, text)
    return rows.select("repo", command.otherwise("").alias("command"))
