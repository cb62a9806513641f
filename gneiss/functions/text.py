"""Scalar derivations over text, paths, scores and durations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions import rules as R


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def trimmed(text: Column) -> Column:
    """Without white space at either end (Spark's trim takes spaces alone)."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def normalized(text: Column) -> Column:
    """Trimmed, runs of white space as one space, lower case."""
    return F.lower(F.regexp_replace(trimmed(text), r"\s+", " "))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: astral characters count twice."""
    return F.length(F.encode(text, "UTF-16BE")) / 2


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(text) / F.lit(R.CHARS_PER_TOKEN)).cast("long")


def tokens_to_chars(tokens: Column) -> Column:
    return F.floor(tokens * F.lit(R.CHARS_PER_TOKEN)).cast("long")


def code_budget(limit: Column) -> Column:
    """Characters of code that fit a model's limit."""
    return tokens_to_chars(F.greatest(limit - R.OVERHEAD_TOKENS, F.lit(R.LEAST_CODE_TOKENS)))


def lookup(table: dict, key: Column, default: Column) -> Column:
    """The value for key in a small constant table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def model_limit(model: Column, others: dict[str, int] | None = None) -> Column:
    """Input tokens of a model: of the known ones, or of `others`, which may also set a known one anew."""
    return lookup({m[0]: m[3] for m in R.MODELS} | (others or {}), model, F.lit(R.DEFAULT_LIMIT))


def loc(content: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(lines(content), lambda line: line.rlike(r"\S"))).cast("long")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(F.encode(content, "UTF-8"), 256), 1, 16)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; none for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]*)\z", 1))


def top_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def duration(ms: Column) -> Column:
    """45s, 5m30s, 5m, 2h15m, 2h; seconds go from an hour on."""
    s = F.floor(ms / 1000).cast("long")
    m, h = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    minutes = F.floor((s % 3600) / 60).cast("long")

    def pair(a: Column, x: str, b: Column, y: str) -> Column:
        return F.concat(a.cast("string"), F.lit(x), F.when(b > 0, F.concat(b.cast("string"), F.lit(y))).otherwise(""))

    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, pair(m, "m", s % 60, "s")).otherwise(pair(h, "h", minutes, "m"))


def timeout_ms(text: Column) -> Column:
    """A number with s, m or h (m if none); anything else is 30 minutes."""
    n = F.regexp_extract(text, r"^(\d+)(s|m|h)?\z", 1)
    unit = F.regexp_extract(text, r"^(\d+)(s|m|h)?\z", 2)
    factor = F.when(unit == "s", 1_000).when(unit == "h", 3_600_000).otherwise(60_000)
    return F.when(n == "", F.lit(1_800_000)).otherwise(n.cast("long") * factor).cast("long")


def owner_repo(text: Column) -> tuple[Column, Column]:
    """(owner, repo); null if the first slash is missing, first or last."""
    at = F.instr(text, "/")
    fine = (at > 1) & (at < F.length(text))
    return F.when(fine, F.substring_index(text, "/", 1)), F.when(fine, text.substr(at + 1, F.length(text)))


def graded(score: Column, part: int) -> Column:
    """A part of GRADES for a score: 1 letter, 2 word, 3 sign, 4 badge colour."""
    out = None
    for g in R.GRADES[:-1]:
        out = F.when(score >= g[0], g[part]) if out is None else out.when(score >= g[0], g[part])
    return out.otherwise(R.GRADES[-1][part])


def dashboard_grade(score: Column) -> Column:
    return F.when(score >= 90, "a").when(score >= 70, "b").when(score >= 50, "c").otherwise("d")


def score_color(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "yellow").otherwise("red")


def rounded(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + F.lit(0.5)).cast("long")


def _bar(filled: Column, width: int) -> Column:
    full = filled.cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def progress_bar(score: Column, width: int = 20) -> Column:
    return _bar(rounded(score / F.lit(100.0) * width), width)


def mini_bar(count: Column, most: Column, width: int = 10) -> Column:
    return F.when(most == 0, F.lit("░" * width)).otherwise(_bar(F.greatest(F.lit(1), rounded(count / most * width)), width))


def severity_rank(severity: Column, table: dict[str, int], default: int) -> Column:
    return lookup(table, severity, F.lit(default))


def commit_message(kind: Column, description: Column) -> Column:
    short = F.when(F.length(description) > 60, F.concat(F.substring(description, 1, 57), F.lit("..."))).otherwise(description)
    return F.concat(lookup(R.COMMIT_PREFIX, kind, F.lit("fix")), F.lit(": "), short)


def quoted(text: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _stretch(text: str, ends: str, rest: str) -> str:
    return rf"length({text}) - length(replace({text}, '\n', '')) AS {ends}, length(substring_index({text}, '\n', -1)) AS {rest}"


def regex_lines(content: str, pattern: str) -> str:
    """SQL, since lambdas this deep are slow to build call by call: all matches in `content`, an expression, in order as
    structs (line from 1, col: characters before it on its line, text). For patterns that never match emptily.

    What lies between matches is what split leaves. A stretch of text has a number of line ends (ends) and a length of what
    is behind the last of them (rest); stretches that touch join to the same two numbers of both. line and col are those of
    all before a match, ends and rest of all up to its end. Rounds of joins double their reach: after k of them a place has
    joined the 2**k pieces that end there. No round copies more than the array, so n matches cost n log n steps, where a
    fold that appends to its result costs their square. What is named more than once is bound by a lambda, as an expression
    inside one is worked out for every element."""
    pieces = f"""filter(zip_with(regexp_extract_all({content}, {quoted(f'({pattern})')}, 1), split({content}, {quoted(pattern)}, -1),
      (m, gap) -> struct({_stretch('concat(gap, m)', 'ends', 'rest')}, {_stretch('gap', 'line', 'col')}, m AS text)), p -> p.text IS NOT NULL)"""
    joined = """transform(array(get(acc, i - reach)), a -> struct(a.ends + x.ends AS ends, if(x.ends > 0, x.rest, a.rest + x.rest) AS rest,
      a.ends + x.line AS line, if(x.line > 0, x.col, a.rest + x.col) AS col, x.text AS text))[0]"""
    rounds = "if(size(v) > 1, sequence(0, int(ceil(log2(size(v)))) - 1), CAST(array() AS array<int>))"
    double = f"transform(array(shiftleft(1, k)), reach -> transform(acc, (x, i) -> if(i >= reach, {joined}, x)))[0]"
    return f"transform(transform(array({pieces}), v -> aggregate({rounds}, v, (acc, k) -> {double}))[0], p -> struct(p.line + 1 AS line, p.col AS col, p.text AS text))"
