"""Path, type and severity filters, allow lists, and how the filters of several sources become one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X

#: A plug-in pattern may have this many characters.
LONGEST_PATTERN = 500


@dataclass(frozen=True)
class Filters:
    exclude_paths: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    min_severity: str | None = None


def glob_regex(glob: str) -> str:
    """** is anything, * anything but a slash, all else stands for itself; the whole path must match."""
    parts = re.split(r"(\*\*|\*)", glob)
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.sub(r"([.+^${}()|\[\]\\?])", r"\\\1", p)) for p in parts) + r"\z"


def _never(test: Column) -> Column:
    """Rows for which the test does not hold; a test on a null field does not hold."""
    return ~F.coalesce(test, F.lit(False))


def apply_filters(issues: DataFrame, filters: Filters) -> DataFrame:
    """issues without excluded types, severities below the least, and files that a glob matches. A null field is excluded by
    nothing; a null severity ranks lowest."""
    keep: Column = F.lit(True)
    if filters.exclude_types:
        keep = keep & _never(F.col("type").isin(*filters.exclude_types))
    if filters.min_severity:
        keep = keep & at_least(F.col("severity"), filters.min_severity)
    for glob in filters.exclude_paths:
        keep = keep & _never(F.col("file").rlike(glob_regex(glob)))
    return issues.where(keep)


def at_least(severity: Column, least: str) -> Column:
    return X.severity_rank(severity, R.RANK_UP, 0) >= R.RANK_UP.get(least, 0)


def min_severity(issues: DataFrame, least: str) -> DataFrame:
    return issues if least == "low" else issues.where(at_least(F.col("severity"), least))


def valid_regex(pattern: str) -> bool:
    """Whether the engine that runs it takes a pattern: Java's, where a session is there to ask."""
    session = SparkSession.getActiveSession()
    try:
        if session:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except (re.error, Py4JJavaError, IllegalArgumentException):
        return False
    return True


def _told() -> Column:
    return F.concat(F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce("description", F.lit("")))


def apply_allow_rules(issues: DataFrame, patterns: list[str]) -> DataFrame:
    """issues without those whose `file:description` a pattern matches, whatever its case; broken patterns count for nothing.
    A null field is empty."""
    allowed: Column = F.lit(False)
    for p in filter(valid_regex, patterns):
        allowed = allowed | _told().rlike(f"(?i){p}")
    return issues.where(~allowed)


#: Patterns without an index that one join broadcasts.
ALLOW_PART = 10_000
#: Signs of a text that are a key of the index.
GRAM = 3


def needed_literal(pattern: str) -> str | None:
    """The longest text of ASCII signs that every match of a pattern holds, in lower case, if it is GRAM signs at least.

    Only what stands by itself counts: nothing in groups or classes, nothing that a quantifier may leave out. Patterns with
    an alternation at the top, flags, quotations or rare escapes have none: they take the way without an index."""
    if re.search(r"\(\?[^:=!<]|\\[^\WdDsSwWbBAzZ]|&&", pattern):
        return None
    runs, now, depth, i = [], "", 0, 0
    while i < len(pattern):
        c, plain = pattern[i], False
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c, plain = pattern[i], not pattern[i].isalnum()
        elif c == "[":
            end = i + 1 + pattern.startswith("^", i + 1)
            end += pattern.startswith("]", end)
            while end < len(pattern) and pattern[end] != "]":
                if pattern[end] == "[":
                    return None
                end += 1 + (pattern[end] == "\\")
            i = end
        elif c == "|" and not depth:
            return None
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c in "*?{":
            now = now[:-1]  # the sign before may be missing
            i = max(i, pattern.find("}", i)) if c == "{" else i
        else:
            plain = c not in "|.^$+"
        if plain and c.isascii() and not depth:
            now += c
        else:
            runs, now = [*runs, now], ""
        i += 1
    best = max([*runs, now], key=len)
    return best.lower() if len(best) >= GRAM else None


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: text.substr(i, F.lit(GRAM))))


def apply_allow_table(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """apply_allow_rules with the patterns in a table (pattern), by an index: a pattern is tried only on texts that hold what
    each of its matches must hold.

    Different texts are looked at once. Of a pattern's needed literal the three signs that the fewest texts have are its
    key; texts meet patterns by these keys in a hash join. Patterns without a literal are broadcast, about ALLOW_PART for
    each join, and compared with every text."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("pattern"))
    usable = rules.where(F.col("pattern").isNotNull()).where(compiled.isNotNull()).select("pattern").distinct()

    def literals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(literal=[needed_literal(p) for p in b["pattern"]])

    known = usable.mapInPandas(literals, "pattern string, literal string").select(F.concat(F.lit("(?i)"), "pattern").alias("_p"), "literal")
    told = issues.select(_told().alias("_told")).distinct()
    texts = told.withColumn("_low", F.lower("_told")).where(F.length("_low") >= GRAM)
    postings = texts.select("_told", "_low", F.explode(_grams(F.col("_low"))).alias("_gram"))
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keys = known.where(F.col("literal").isNotNull()).select("_p", "literal", F.explode(_grams(F.col("literal"))).alias("_gram"))
    keys = keys.join(counts, "_gram").groupBy("_p", "literal").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count(F.lit(1)).alias("_there"))
    keys = keys.where(F.col("_there") == F.size(_grams(F.col("literal"))))  # else no text holds the literal
    hits = postings.join(keys, "_gram").where(F.contains("_low", F.col("literal"))).where(F.call_function("rlike", F.col("_told"), F.col("_p"))).select("_told").distinct()
    issues = issues.withColumn("_told", _told()).join(hits, "_told", "left_anti").drop("_told")
    bare = known.where(F.col("literal").isNull()).select("_p")
    parts = -(-bare.count() // ALLOW_PART)
    for n in range(parts):
        own = bare.where(F.pmod(F.xxhash64("_p"), F.lit(parts)) == n)
        issues = issues.join(F.broadcast(own), F.call_function("rlike", _told(), F.col("_p")), "left_anti")
    return issues


def merge_filters(filters: list[Filters]) -> Filters:
    """All paths and types, each once in order of appearance; the highest least severity."""
    ranks = [f.min_severity for f in filters if f.min_severity]
    return Filters(
        tuple(dict.fromkeys(p for f in filters for p in f.exclude_paths)), tuple(dict.fromkeys(t for f in filters for t in f.exclude_types)),
        max(ranks, key=lambda s: R.RANK_UP.get(s, 0)) if ranks else None,
    )


def with_config(filters: Filters, ignore: list[str], rules: dict[str, str]) -> Filters:
    """filters with a repository's ignored globs, and types that are off; a severity given to a type has no effect."""
    off = [t for t, v in rules.items() if v == "off"]
    return merge_filters([filters, Filters(tuple(ignore), tuple(off))])


def usable_rules(rules: list[R.Rule]) -> tuple[R.Rule, ...]:
    """Plug-in rules that may run: no quantifier over a quantified group, not overlong, compilable."""
    nested = re.compile(r"([+*?]|\{\d+,?\d*\})\s*\)\s*([+*?]|\{\d+,?\d*\})")
    return tuple(r for r in rules if not nested.search(r.pattern) and len(r.pattern) <= LONGEST_PATTERN and valid_regex(r.pattern))


def gate(score: int, fail_below: int) -> bool:
    """Whether a run fails."""
    return fail_below > 0 and score < fail_below
