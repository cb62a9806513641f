"""Detectors: rules over contents and lines, signatures, imports, unused imports, missing return types."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X

ISSUE_COLUMNS = ["file", "line", "type", "severity", "description", "rule_ord", "match_ord"]


def gated(ext: Column, extensions: tuple[str, ...]) -> Column:
    return ext.isin(*extensions) if extensions else F.lit(True)


def may_match(text: Column, low: Column, pattern: str, needs: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words that a match of the pattern must hold. low: the text in lower case."""
    out: Column | None = None
    for word in needs:
        there = low.contains(word.lower()) if pattern.startswith("(?i)") else text.contains(word)
        out = there if out is None else out | there
    return F.lit(True) if out is None else out


def scan_rules(files: DataFrame, rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """Issues of the regex rules. files: path, ext, content.

    One pass over the files: each rule's matches are an array (empty where the extension gate is shut or no word that a
    match needs is there, before any regex), with their lines worked out, and the arrays are exploded together; the
    contents go no further. Matches on a line that begins as a comment are dropped. Rows are ordered by (rule_ord,
    match_ord) within a file."""
    def of_rule(i: int, r: R.Rule) -> str:
        # A match's line up to the end of what the match has of it; only its first signs count.
        begins = r"substring(get(_lines, m.line - 1), 1, m.col + length(substring_index(m.text, '\n', 1)))"
        matches = f"transform({X.regex_lines('content', r.java)}, m -> struct(m.line, m.text, {begins} rlike {X.quoted(r'^\s*(?://|#|\*)')} AS comment))"
        text = "_low" if r.pattern.startswith("(?i)") else "content"
        tests = [f"ext IN ({', '.join(map(X.quoted, r.extensions))})"] if r.extensions else []
        if r.needs:
            tests.append("(" + " OR ".join(f"contains({text}, {X.quoted(w.lower() if text == '_low' else w)})" for w in r.needs) + ")")
        facts = f"{i} AS rule_ord, {X.quoted(r.type)} AS type, {X.quoted(r.severity)} AS severity, {X.quoted(r.description)} AS description"
        return f"struct({facts}, CASE WHEN {' AND '.join(tests or ['true'])} THEN {matches} ELSE array() END AS matches)"

    found = F.expr(f"array({', '.join(of_rule(i, r) for i, r in enumerate(rules))})")
    given = files.select("path", "ext", "content", F.lower("content").alias("_low"), X.lines(F.col("content")).alias("_lines"))
    hits = given.select("path", F.explode(F.filter(found, lambda r: F.size(r["matches"]) > 0)).alias("r"))
    out = hits.select("path", "r.rule_ord", "r.type", "r.severity", "r.description", F.posexplode("r.matches").alias("match_ord", "m")).where(~F.col("m.comment"))
    description = F.when(F.col("type") == "stubs", F.substring(X.trimmed(F.col("m.text")), 1, 100)).otherwise(F.col("description"))
    return out.select(F.col("path").alias("file"), F.col("m.line").alias("line"), "type", "severity", description.alias("description"), "rule_ord", "match_ord")


def flagged_files(issues: DataFrame) -> DataFrame:
    return issues.groupBy("file").agg(F.count(F.lit(1)).alias("n_issues"))


def _any_word(ext: Column, text: Column, low: Column) -> Column:
    """Whether a text holds a word of any hotspot of its kind of file."""
    out = F.lit(False)
    for h in R.HOTSPOTS:
        out = out | (gated(ext, h.extensions) & may_match(text, low, h.pattern, h.needs))
    return out


def hotspots_of(ext: Column, content: Column) -> Column:
    """An array of structs (line, ord, label, snippet) in that order: the first pattern of each label that a line matches.
    Texts that hold no word of any pattern are not taken apart, and a line is matched only against patterns that it holds
    a word of."""
    by_label: dict[str, list[tuple[int, R.Hotspot]]] = {}
    for i, h in enumerate(R.HOTSPOTS):
        by_label.setdefault(h.label, []).append((i, h))

    def of_line(x: Column) -> Column:
        text, low = x["text"], x["low"]

        def one(label: str) -> Column:
            out = None
            for i, h in by_label[label]:
                hit = gated(ext, h.extensions) & may_match(text, low, h.pattern, h.needs) & text.rlike(h.java)
                out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
            return F.struct(x["line"].alias("line"), out.alias("ord"), F.lit(label).alias("label"), F.substring(X.trimmed(text), 1, 80).alias("snippet"))

        return F.when(_any_word(ext, text, low), F.array_sort(F.filter(F.array(*map(one, by_label)), lambda h: h["ord"].isNotNull()))).otherwise(none)

    none = F.array().cast("array<struct<line:int,ord:int,label:string,snippet:string>>")
    rows = F.transform(X.lines(content), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), F.lower(t).alias("low")))
    return F.when(_any_word(ext, content, F.lower(content)), F.flatten(F.transform(rows, of_line))).otherwise(none)


def hotspots(files: DataFrame) -> DataFrame:
    """(path, line, label, snippet, ord) by hotspots_of."""
    return files.select("path", F.explode(hotspots_of(F.col("ext"), F.col("content"))).alias("h")).select("path", "h.line", "h.label", "h.snippet", "h.ord")


def signatures_of(ext: Column, content: Column) -> Column:
    """An array of structs (line, kind, name, params, returns): one at most per line, of the first pattern for its kind of file."""
    kinds: dict[tuple[str, ...], list[tuple]] = {}
    for row in R.SIGNATURES:
        kinds.setdefault(row[1], []).append(row)
    none = F.array().cast("array<struct<line:int,kind:string,name:string,params:string,returns:string>>")

    def of_line(rows: list[tuple]):
        def one(text: Column, i: Column) -> Column:
            chosen: Column | None = None
            for kind, _, pattern, name, params, returns in rows:
                java = pattern.replace("|$)", r"|\z)")
                groups = [F.nullif(X.trimmed(F.regexp_extract(text, java, g)), F.lit("")) for g in returns]
                # A group that took no part is null; an empty list of parameters is an empty string.
                given = F.lit(None).cast("string")
                if params and kind == "class":
                    given = F.when(text.rlike(r"^class\s+\w+\("), X.trimmed(F.regexp_extract(text, java, params)))
                elif params:
                    given = X.trimmed(F.regexp_extract(text, java, params))
                got = (F.coalesce(*groups) if groups else F.lit(None)).cast("string")
                made = F.struct((i + 1).alias("line"), F.lit(kind).alias("kind"), F.regexp_extract(text, java, name).alias("name"), given.alias("params"), got.alias("returns"))
                chosen = F.when(text.rlike(java), made) if chosen is None else chosen.when(text.rlike(java), made)
            return chosen

        return one

    bare = F.transform(X.lines(content), lambda t: F.regexp_replace(t, r"^\s+", ""))
    out: Column | None = None
    for exts, rows in kinds.items():
        own = F.filter(F.transform(bare, of_line(rows)), lambda s: s.isNotNull())
        out = F.when(ext.isin(*exts), own) if out is None else out.when(ext.isin(*exts), own)
    return out.otherwise(none)


def signatures(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, params, returns) by signatures_of."""
    return files.select("path", F.explode(signatures_of(F.col("ext"), F.col("content"))).alias("s")).select("path", "s.line", "s.kind", "s.name", "s.params", "s.returns")


def _all(pattern: str, group: int = 1, content: str = "content") -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


# The patterns of imports in the functions below, by kind of file.
def light_imports_of(ext: Column) -> Column:
    """An array of the imports in `content` that a fingerprint shows."""
    py = F.transform(_all(r"(?m)^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", 0), lambda m: F.regexp_extract(m, r"^(?:from|import)\s+([\w.]+)", 1))
    go = F.filter(_all(r'"([^"]+)"'), lambda s: s.contains(".") | s.contains("/"))
    return F.when(ext.isin(*R.SCRIPT), _all(r"(?m)^import\s+.*?from\s+['\"]([^'\"]+)['\"]")).when(ext == ".py", py).when(ext == ".go", go).otherwise(F.array().cast("array<string>"))


def light_imports(files: DataFrame) -> DataFrame:
    """(path, pos, spec) by light_imports_of."""
    return files.select("path", F.posexplode(light_imports_of(F.col("ext"))).alias("pos", "spec"))


def full_imports(files: DataFrame) -> DataFrame:
    """(path, pos, spec): the imports that the dependency graph uses."""
    none = F.array().cast("array<string>")
    block = F.regexp_extract("content", r"import\s*\(([\s\S]*?)\)", 1)
    script = F.concat(_all(r"(?:import|export)\s.*?from\s+['\"]([^'\"]+)['\"]"), _all(r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"))
    py = F.concat(_all(r"(?m)^from\s+([\w.]+)\s+import"), _all(r"(?m)^import\s+([\w.]+)"))
    go = F.concat(F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1)), _all(r'import\s+"([^"]+)"'))
    ext = F.col("ext")
    found = (
        F.when(ext.isin(*R.SCRIPT, ".vue", ".svelte"), script).when(ext == ".py", py).when(ext == ".go", go)
        .when(ext.isin(".java", ".kt", ".scala"), _all(r"(?m)^import\s+([\w.]+)"))
        .when(ext == ".rb", _all(r"require(?:_relative)?\s+['\"]([^'\"]+)['\"]")).otherwise(none)
    )
    return files.select("path", F.posexplode(found).alias("pos", "spec"))


# How imports of names, and of a default, look.
_NAMED = r"(?m)^import\s+(?:type\s+)?\{[^}]+\}\s+from\s+['\"][^'\"]+['\"]"
_DEFAULT = r"(?m)^import\s+[A-Za-z0-9_]+\s+from\s+['\"][^'\"]+['\"]"


def unused_imports(files: DataFrame) -> DataFrame:
    """Named and default imports whose name occurs once at most, as an ASCII word, in their file.

    A file's words are sorted once; those that have an equal neighbour occur more than once, and no name that is a word is
    looked for in the content. Names with other signs than a word's are counted by a pattern of their own."""
    script = files.where(F.col("ext").isin(*R.SCRIPT) & F.contains("content", F.lit("import")))

    def imports(kind: int, pattern: str, names) -> Column:
        return F.transform(F.expr(X.regex_lines("content", pattern)), lambda m: F.struct(F.lit(kind).alias("kind"), m["line"].alias("line"), m["col"].alias("col"), names(m["text"]).alias("names")))

    def named(raw: Column) -> Column:
        parts = F.split(X.trimmed(raw), r"\s+as\s+")
        return X.trimmed(F.coalesce(F.nullif(F.get(parts, F.lit(1)), F.lit("")), F.get(parts, F.lit(0))))

    listed = imports(0, _NAMED, lambda t: F.transform(F.split(F.regexp_extract(t, r"\{([^}]+)\}", 1), ","), named))
    single = imports(1, _DEFAULT, lambda t: F.array(F.regexp_extract(t, r"^import\s+([A-Za-z0-9_]+)", 1)))
    met = script.select("path", "content", F.concat(listed, single).alias("_imports")).where(F.size("_imports") > 0)
    met = met.withColumn("_words", F.array_sort(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0))))
    often = F.array_distinct(F.filter("_words", lambda w, i: (i > 0) & (w == F.get(F.col("_words"), i - 1))))
    imported = F.array_distinct(F.flatten(F.transform("_imports", lambda i: i["names"])))
    met = met.select("path", "content", "_imports", F.array_except(imported, often).alias("_once"))
    each = met.select("path", "content", "_once", F.explode("_imports").alias("i"))
    each = each.select("path", "content", "i.kind", "i.line", "i.col", F.posexplode(F.filter("i.names", lambda n: F.array_contains(F.col("_once"), n))).alias("pos", "name"))
    each = each.where(F.when(F.col("kind") == 0, F.length("name") >= 2).otherwise(F.col("name") != "React"))
    pattern = F.concat(F.lit(R.B), F.regexp_replace("name", r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(R.B))
    unused = each.where(F.col("name").rlike(r"^[A-Za-z0-9_]+\z") | (F.regexp_count("content", pattern) <= 1))
    order = Window.partitionBy("path").orderBy("kind", "line", "col", "pos")
    return unused.select(
        F.col("path").alias("file"), "line", F.lit("lint").alias("type"), F.lit("low").alias("severity"),
        F.concat(F.lit("Unused import: '"), F.col("name"), F.lit("'")).alias("description"), F.lit(len(R.RULES) + 1).alias("rule_ord"), (F.row_number().over(order) - 1).alias("match_ord"),
    )


# How functions, and constants that are arrow functions, begin.
_FUNCTION = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(", re.A)
_ARROW = re.compile(r"^(?:export\s+)?const\s+(\w+)\s*(:\s*[^=]+?)?\s*=\s*(?:async\s*)?\(", re.A)
#: Lines that a parameter list may span, and lines after it that may hold its return type.
_SPAN, _AFTER = 30, 2


def _closing(rows: list[str], start: int) -> tuple[int, int] | None:
    """Where the first bracket that opens from the start of a line on is closed."""
    depth = 0
    for j in range(start, min(start + _SPAN, len(rows))):
        for m in re.finditer(r"[()]", rows[j]):
            depth += 1 if m[0] == "(" else -1
            if depth == 0 and m[0] == ")":
                return j, m.start()
    return None


def functions_without_return(content: str) -> Iterator[tuple[int, str]]:
    """(line, name) of functions, and constants that are arrow functions, without a declared return type."""
    rows = content.split("\n")
    for i, row in enumerate(rows):
        head = row.lstrip()
        if head.startswith(("//", "*", "/*")):
            continue
        function, arrow = _FUNCTION.match(head), None
        if not function:
            arrow = _ARROW.match(head)
            if not arrow or (arrow[2] and len(arrow[2].strip()) > 1):
                continue
        name = (function or arrow)[1]
        end = None if name == "constructor" else _closing(rows, i)
        if end is None:
            continue
        rest = " ".join([rows[end[0]][end[1] + 1 :], *[r.strip() for r in rows[end[0] + 1 : end[0] + 1 + _AFTER]]])
        typed = bool(re.match(r"\s*:", rest))
        if arrow:
            before, found, _ = rest.partition("=>")
            if not found or re.search(r"[?;{}]", before):
                continue
            typed = bool(re.match(r"\s*:\s*\S", rest)) and ":" in before
        if not typed:
            yield i + 1, name


def missing_return_types(files: DataFrame) -> DataFrame:
    """Issues for functions of .ts and .tsx files, not .d.ts, without a return type.

    Matching brackets over lines has no built-in, so this runs in Arrow-backed pandas, file by file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, line, f"Function '{name}' is missing an explicit return type annotation", n) for p, c in zip(b["path"], b["content"]) for n, (line, name) in enumerate(functions_without_return(c or ""))]
            yield pd.DataFrame(rows, columns=["file", "line", "description", "match_ord"])

    script = files.where(F.col("ext").isin(*R.TS) & ~F.col("path").endswith(".d.ts") & F.col("content").rlike(r"function|const"))
    found = script.select("path", "content").mapInPandas(run, "file string, line int, description string, match_ord int")
    return found.select("file", "line", F.lit("types").alias("type"), F.lit("medium").alias("severity"), "description", F.lit(len(R.RULES)).alias("rule_ord"), "match_ord")


def scan_local(files: DataFrame, rules: tuple[R.Rule, ...] = R.RULES) -> DataFrame:
    """All issues that need no model."""
    return scan_rules(files, rules).unionByName(missing_return_types(files)).unionByName(unused_imports(files))
