"""Whole runs: a scan as one lazy plan, and the loop of passes that fixes what a scan finds."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.operators import detect, incremental, policy, score, verify
from gneiss.sources.files import load_json, save_json
from gneiss.sources.findings import union_findings

FIELDS = ["file", "line", "type", "severity", "description", "status", "source"]


@dataclass
class Settings:
    rules: tuple[R.Rule, ...] = ()
    filters: policy.Filters = policy.Filters()
    min_severity: str = "low"
    allow: list[str] = field(default_factory=list)
    fail_below: int = 0


@dataclass
class Scan:
    """The results of a scan, lazy: issues after policy and duplicates, what to put in the cache, the cache partition."""

    issues: DataFrame
    found: DataFrame
    partitioned: DataFrame

    def result(self, files: DataFrame) -> dict:
        """Collected: the score over all files and the number of issues."""
        row = self.issues.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(score.penalty(F.col("severity"))), F.lit(0)).alias("p")).crossJoin(score.lines_of_code(files)).select("n", "loc", score.score_of(F.col("p"), F.col("loc")).alias("score")).first()
        return row.asDict()


def scan(files: DataFrame, settings: Settings = Settings(), reported: DataFrame | None = None, cache: DataFrame | None = None, strategy: str = "fingerprint") -> Scan:
    """files: path, ext, content. reported: what a model said (the columns of findings.parse_issues). cache: path, hash,
    strategy, issues.

    Cached issues come first, then local ones, then reported ones; the first of a place and type stays. Reported
    ones are in order of their seq if they have one, else of severity and description. Filters go before
    duplicates, and do not commute with them."""
    cached, part, todo = None, files.withColumn("hit", F.lit(False)), files
    if cache is not None:
        part = incremental.partition(files, cache, strategy)
        cached = incremental.cached_issues(part, cache)
        todo = part.where("not hit")
    local = detect.scan_local(todo, R.RULES + settings.rules).withColumns({"status": F.lit("found"), "source": F.lit("local"), "line": F.col("line").cast("double")})
    parts = [local.withColumn("ord", F.shiftleft(F.col("rule_ord").cast("long"), 32) + F.col("match_ord"))]
    if reported is not None:
        kept = verify.verify(reported.withColumn("line", F.col("line").cast("double")), local, todo)
        parts.append(kept.withColumn("ord", F.col("seq") if "seq" in kept.columns else F.lit(0)))
    found = union_findings(*[p.select(*FIELDS, F.col("ord").cast("long").alias("ord")) for p in parts])
    whole = found
    if cached is not None:
        old = cached.select(*[F.col(c) if c in cached.columns else F.lit(None).alias(c) for c in FIELDS]).withColumns({"line": F.col("line").cast("double"), "ord": F.lit(0).cast("long"), "src_rank": F.lit(-1)})
        whole = old.unionByName(found)
    whole = policy.min_severity(policy.apply_filters(whole, settings.filters), settings.min_severity)
    whole = policy.apply_allow_rules(whole, settings.allow)
    return Scan(score.first_wins(whole, ["src_rank", "ord", "severity", "description"]), found, part)


@dataclass
class Pass:
    number: int
    found: int
    fixed: int
    skipped: int
    duration_ms: int


def save_loop(spark: SparkSession, path: str, passes: list[Pass], facts: dict | None = None) -> None:
    """Keep the state of a loop (its passes, and whatever else the next run in a chain should know) in a small file."""
    save_json(spark, path, {"passes": [asdict(p) for p in passes], **(facts or {})})


def load_loop(spark: SparkSession, path: str, chain: int) -> dict | None:
    """The state that an earlier run of a chain kept, with its passes as Pass and the number in the chain; None for the first
    run of a chain, and if there is no state that can be read."""
    state = load_json(spark, path) if chain else None
    try:
        return state and {**state, "passes": [Pass(**p) for p in state["passes"]], "chain": chain}
    except (KeyError, TypeError):
        return None


def issue_facts(issue: dict) -> dict[str, str]:
    """What a hook after a fix is told of the issue, as text; missing fields are empty."""
    return {f"issue_{k}": "" if issue.get(k) is None else str(issue[k]) for k in ("file", "line", "type", "severity", "description", "status")}


def run_hooks(hooks: list[Callable[[dict], None]], facts: dict) -> list[str]:
    """Call each hook in turn; what one raises is a warning and stops nothing."""
    warnings = []
    for hook in hooks:
        try:
            hook(facts)
        except Exception as e:  # noqa: BLE001  a hook is the user's code
            warnings.append(f"{getattr(hook, '__name__', 'hook')}: {e}")
    return warnings


#: Time that is left unused before the deadline, so that a run can end in order.
MARGIN_S = 120


def fix_loop(
    look: Callable[[int], int], fix: Callable[[int], tuple[int, int]], most: int, least: int, deadline: float,
    done: list[Pass] | None = None, save: Callable[[list[Pass]], None] = lambda passes: None, now: Callable[[], float] = time.time,
) -> tuple[list[Pass], bool]:
    """Passes of finding and fixing until one from the `least`th on finds nothing, `most` are done, or time is up.

    look(n): the number of issues of pass n; fix(n): how many were fixed and skipped. done: passes of an earlier run, to go
    on from; save is called after each pass. Returns the passes, and whether the work is complete."""
    passes = list(done or [])
    while len(passes) < most and now() < deadline - MARGIN_S:
        number, began = len(passes) + 1, now()
        found = look(number)
        if not found and number >= least:
            passes.append(Pass(number, 0, 0, 0, int(1000 * (now() - began))))
            save(passes)
            return passes, True
        fixed, skipped = fix(number) if found else (0, 0)
        passes.append(Pass(number, found, fixed, skipped, int(1000 * (now() - began))))
        save(passes)
    return passes, False
