"""Scalars: the input and output facts that the engine must keep."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "tokens"), [("a" * 320, 100), ("", 0), ("abc", 1), ("\U0001f534" * 16, 10)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, X.token_estimate(F.lit(text))) == tokens


def test_limits_and_budgets(spark):
    assert one(spark, X.model_limit(F.lit("openai/gpt-4o-mini"))) == 8000
    assert one(spark, X.model_limit(F.lit("unknown-model"))) == 8000
    assert one(spark, X.code_budget(F.lit(8000))) == 24000
    assert one(spark, X.code_budget(F.lit(100))) == 3200


@pytest.mark.parametrize(("ms", "shown"), [(0, "0s"), (45_000, "45s"), (300_000, "5m"), (330_000, "5m30s"), (7_200_000, "2h"), (8_100_000, "2h15m"), (7_201_000, "2h")])
def test_duration(spark, ms, shown):
    assert one(spark, X.duration(F.lit(ms))) == shown


@pytest.mark.parametrize(("text", "ms"), [("30m", 1_800_000), ("45s", 45_000), ("2h", 7_200_000), ("7", 420_000), ("5h50m", 1_800_000), ("", 1_800_000)])
def test_timeout(spark, text, ms):
    assert one(spark, X.timeout_ms(F.lit(text))) == ms


@pytest.mark.parametrize(("text", "owner", "repo"), [("octocat/hello-world", "octocat", "hello-world"), ("", None, None), ("just-a-name", None, None), ("owner/", None, None), ("/repo", None, None)])
def test_owner_repo(spark, text, owner, repo):
    a, b = X.owner_repo(F.lit(text))
    assert (one(spark, a), one(spark, b)) == (owner, repo)


@pytest.mark.parametrize(("score", "letter", "word", "board"), [(29, "F", "Critical", "d"), (30, "D", "Poor", "d"), (49, "D", "Poor", "d"), (50, "C", "Fair", "c"), (69, "C", "Fair", "c"), (70, "B", "Good", "b"), (89, "B", "Good", "b"), (90, "A", "Excellent", "a")])
def test_grades(spark, score, letter, word, board):
    s = F.lit(score)
    assert (one(spark, X.graded(s, 1)), one(spark, X.graded(s, 2)), one(spark, X.dashboard_grade(s))) == (letter, word, board)


def test_bars(spark):
    assert one(spark, X.progress_bar(F.lit(50))) == "█" * 10 + "░" * 10
    assert one(spark, X.mini_bar(F.lit(1), F.lit(100))) == "█" + "░" * 9
    assert one(spark, X.mini_bar(F.lit(0), F.lit(0))) == "░" * 10


def test_paths(spark):
    p = F.lit("a/b.c/D.TSX")
    assert (one(spark, X.extension(p)), one(spark, X.dirname(p)), one(spark, X.basename(p)), one(spark, X.top_dir(p))) == (".tsx", "a/b.c", "D.TSX", "a")
    assert one(spark, X.extension(F.lit("x/.hidden"))) == ""
    assert one(spark, X.dirname(F.lit("root.py"))) == "."


def test_commit_message(spark):
    assert one(spark, X.commit_message(F.lit("lint"), F.lit("short"))) == "style: short"
    assert one(spark, X.commit_message(F.lit("odd"), F.lit("x" * 61))) == "fix: " + "x" * 57 + "..."


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["TODO", "FIXME:", "\n", " ", "x", "äTODO", "HACK", "é", "\n\n"]), max_size=12).map("".join))
def test_places_of_matches(spark, text):
    pattern = r"\b(?:TODO|FIXME|HACK|XXX)\b[:\s]*.{0,80}"
    rows = one(spark, F.expr(X.regex_lines(X.quoted(text), pattern.replace(r"\b", R.B))))
    assert [(r["line"], r["col"], r["text"]) for r in rows] == [(text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start()) - 1, m[0]) for m in re.finditer(pattern.replace("[:\\s]", "[:\\t\\n\\x0b\\f\\r ]"), text, re.A)]
