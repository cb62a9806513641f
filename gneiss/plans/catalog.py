"""Every operator as a query over the views of fixtures.py, with the SQL that an oracle answers it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.functions import text as X
from gneiss.operators import compress, detect, graph, incremental, outcomes, policy, score, verify
from gneiss.plans import scan as scans
from gneiss.plans.fixtures import oracle_with, view
from gneiss.sources import files as sources
from gneiss.sources import scratch
from gneiss.sources import findings
from gneiss.streaming import incremental as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ext_in(extensions: tuple[str, ...]) -> str:
    return f"ext IN ({', '.join(map(_q, extensions))})" if extensions else "true"


_WS = r"^\s+|\s+$"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}', '', 'g')"


def _ranked(column: str, table: dict[str, int], default: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


_PENALTY = _ranked("severity", R.PENALTY, 1)
_LOC = "len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '\\S')))"

# ---- detectors -------------------------------------------------------------------------------------------------------


def _rules_cte(rules: tuple[R.Rule, ...] = R.RULES) -> str:
    """found(file, line, type, severity, description, rule_ord, match_ord) over code_files: each rule's matches are placed by
    the lengths of what lies between them."""
    parts = []
    for i, r in enumerate(rules):
        description = f"substr({_trim('m')}, 1, 100)" if r.type == "stubs" else _q(r.description)
        parts.append(f"""SELECT path, content, place, {_q(r.type)} AS type, {_q(r.severity)} AS severity, {description} AS description, {i} AS rule_ord, n - 1 AS match_ord FROM (
          SELECT path, content, n, ms[n] AS m, coalesce(list_sum(list_transform(gs[1:n], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:n - 1], lambda x: len(x))), 0) AS place FROM (
            SELECT path, content, ms, gs, unnest(range(1, len(ms) + 1)) AS n FROM (
              SELECT path, content, regexp_extract_all(content, {_q(r.sql)}) AS ms, string_split_regex(content, {_q(r.sql)}) AS gs FROM code_files WHERE {_ext_in(r.extensions)})))""")
    return (
        "placed AS (" + "\nUNION ALL ".join(parts) + "), lined AS (SELECT *, len(string_split(content[1:CAST(place AS BIGINT)], chr(10))) AS line FROM placed), "
        "found AS (SELECT path AS file, line, type, severity, description, rule_ord, match_ord FROM lined "
        "WHERE NOT regexp_matches(string_split(content, chr(10))[line], '^\\s*(//|#|\\*)'))"
    )


_RULES = oracle_with("code_files") + ", " + _rules_cte()


@query(_RULES + " SELECT file, line, type, severity, description, rule_ord, match_ord FROM found")
def rule_findings(spark, d):
    return detect.scan_rules(view(spark, d, "code_files"))


@query(_RULES + " SELECT file, count(*) AS n_issues FROM found GROUP BY file")
def flagged_files(spark, d):
    return detect.flagged_files(detect.scan_rules(view(spark, d, "code_files")))


_DEDUPED = _RULES + ", once AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY file, line, type ORDER BY rule_ord, match_ord) = 1)"


@query(
    _DEDUPED
    + f""", s AS (SELECT split_part(file, '/', 1) AS dir, count(*) AS n_issues, sum({_PENALTY}) AS penalty FROM once GROUP BY 1),
    f AS (SELECT split_part(path, '/', 1) AS dir, greatest(sum({_LOC}), 1) AS loc FROM code_files GROUP BY 1),
    m AS (SELECT f.dir, coalesce(n_issues, 0) AS n_issues, coalesce(penalty, 0) AS penalty, loc FROM f LEFT JOIN s ON f.dir = s.dir),
    c AS (SELECT *, least(100, greatest(0, floor(100.0::DOUBLE - penalty / greatest(1.0::DOUBLE, loc / 1000.0::DOUBLE) + 0.5::DOUBLE))) AS score FROM m)
    SELECT dir, CAST(n_issues AS BIGINT) AS n_issues, CAST(penalty AS BIGINT) AS penalty, CAST(loc AS BIGINT) AS loc, CAST(score AS INT) AS score,
      CASE WHEN score >= 90 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS letter FROM c"""
)
def quality_score_by_dir(spark, d):
    files = view(spark, d, "code_files")
    once = score.first_wins(detect.scan_rules(files), ["rule_ord", "match_ord"])
    return score.scores_by(once, files, X.top_dir)


def _hotspot_sql() -> str:
    parts = []
    for i, h in enumerate(R.HOTSPOTS):
        test = f"regexp_matches(t, {_q(h.sql)})"
        if h.label == "PRINT":  # no lookahead: what comes after the last print( of the line has no file=
            test = r"regexp_matches(t, '\bprint\s*\(') AND NOT regexp_matches(regexp_extract(t, '^.*\bprint\s*\((.*)$', 1), 'file\s*=')"
        parts.append(f"SELECT path, n, t, '{h.label}' AS label, {i} AS ord FROM l WHERE {_ext_in(h.extensions)} AND {test}")
    return "l AS (SELECT path, ext, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS t FROM (SELECT path, ext, string_split(content, chr(10)) AS ls FROM code_files)), h AS (" + " UNION ALL ".join(parts) + ")"


@query(oracle_with("code_files") + ", " + _hotspot_sql() + f" SELECT path, n AS line, label, substr({_trim('min(t)')}, 1, 80) AS snippet, min(ord) AS ord FROM h GROUP BY path, n, label")
def hotspots(spark, d):
    return detect.hotspots(view(spark, d, "code_files"))


@query(
    oracle_with("doc_files").replace("doc_files AS", "code_files AS", 1)
    + ", "
    + _hotspot_sql()
    + f" SELECT path, n AS line, label, substr({_trim('min(t)')}, 1, 80) AS snippet, min(ord) AS ord FROM h GROUP BY path, n, label"
)
def hotspots_in_documents(spark, d):
    return detect.hotspots(view(spark, d, "doc_files"))


def _signature_sql() -> str:
    branches = []
    for kind, exts, pattern, name, params, returns in R.SIGNATURES:
        plain = pattern.replace(r"(?!(?:if|for|while|switch|catch)\s*\()", "")
        test = f"regexp_matches(t, {_q(plain)})"
        if plain != pattern:
            test += f" AND regexp_extract(t, {_q(plain)}, {name}) NOT IN ('if', 'for', 'while', 'switch', 'catch')"
        group = lambda g, p=plain: _trim(f"regexp_extract(t, {_q(p)}, {g})")
        given = "NULL"
        if params:
            given = group(params)
            if kind == "class":
                given = f"CASE WHEN regexp_matches(t, '^class\\s+\\w+\\(') THEN {given} END"
        got = f"coalesce({', '.join(f'nullif({group(g)}, {_q('')})' for g in returns)})" if returns else "NULL"
        branches.append(f"WHEN {_ext_in(exts)} AND {test} THEN {{'kind': '{kind}', 'name': regexp_extract(t, {_q(plain)}, {name}), 'params': CAST({given} AS VARCHAR), 'returns': CAST({got} AS VARCHAR)}}")
    return (
        "sl AS (SELECT path, ext, unnest(range(1, len(ls) + 1)) AS n, regexp_replace(unnest(ls), '^\\s+', '') AS t FROM (SELECT path, ext, string_split(content, chr(10)) AS ls FROM code_files)), "
        "sr AS (SELECT path, n, CASE " + "\n".join(branches) + " END AS s FROM sl), "
        "signed AS (SELECT path, n AS line, s.kind AS kind, s.name AS name, s.params AS params, s.returns AS returns FROM sr WHERE s IS NOT NULL)"
    )


@query(oracle_with("code_files") + ", " + _signature_sql() + " SELECT * FROM signed")
def signatures(spark, d):
    return detect.signatures(view(spark, d, "code_files"))


_LIGHT = r"""CASE WHEN ext IN ('.ts', '.tsx', '.js', '.jsx') THEN regexp_extract_all(content, '(?m)^import\s+.*?from\s+[''"]([^''"]+)[''"]', 1)
  WHEN ext = '.py' THEN list_transform(regexp_extract_all(content, '(?m)^(?:from\s+[\w.]+\s+import|import\s+[\w.]+)'), lambda m: regexp_extract(m, '^(?:from|import)\s+([\w.]+)', 1))
  WHEN ext = '.go' THEN list_filter(regexp_extract_all(content, '"([^"]+)"', 1), lambda s: contains(s, '.') OR contains(s, '/')) ELSE [] END"""


@query(oracle_with("code_files") + f"SELECT path, unnest(range(0, len(i))) AS pos, unnest(i) AS spec FROM (SELECT path, {_LIGHT} AS i FROM code_files)")
def imports_light(spark, d):
    return detect.light_imports(view(spark, d, "code_files"))


_FULL = r"""CASE WHEN ext IN ('.ts', '.tsx', '.js', '.jsx', '.vue', '.svelte') THEN list_concat(regexp_extract_all(content, '(?:import|export)\s.*?from\s+[''"]([^''"]+)[''"]', 1), regexp_extract_all(content, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1))
  WHEN ext = '.py' THEN list_concat(regexp_extract_all(content, '(?m)^from\s+([\w.]+)\s+import', 1), regexp_extract_all(content, '(?m)^import\s+([\w.]+)', 1))
  WHEN ext = '.go' THEN list_concat(regexp_extract_all(regexp_extract(content, 'import\s*\(([\s\S]*?)\)', 1), '"([^"]+)"', 1), regexp_extract_all(content, 'import\s+"([^"]+)"', 1))
  WHEN ext IN ('.java', '.kt', '.scala') THEN regexp_extract_all(content, '(?m)^import\s+([\w.]+)', 1)
  WHEN ext = '.rb' THEN regexp_extract_all(content, 'require(?:_relative)?\s+[''"]([^''"]+)[''"]', 1) ELSE [] END"""
_IMPORTS = f"imports AS (SELECT path, unnest(range(0, len(i))) AS pos, unnest(i) AS spec FROM (SELECT path, {_FULL} AS i FROM code_files))"


@query(oracle_with("code_files") + f", {_IMPORTS} SELECT path, pos, spec FROM imports")
def imports_full(spark, d):
    return detect.full_imports(view(spark, d, "code_files"))


_NAMED = r"""(?m)^import\s+(?:type\s+)?\{[^}]+\}\s+from\s+['"][^'"]+['"]"""
_PLAIN = r"""(?m)^import\s+[A-Za-z0-9_]+\s+from\s+['"][^'"]+['"]"""


def _unused_sql() -> str:
    def one(kind: int, pattern: str, names: str) -> str:
        return f"""SELECT path, content, {kind} AS kind, n, {names} AS names, coalesce(list_sum(list_transform(gs[1:n], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:n - 1], lambda x: len(x))), 0) AS place
          FROM (SELECT path, content, ms, gs, unnest(range(1, len(ms) + 1)) AS n FROM (SELECT path, content, regexp_extract_all(content, {_q(pattern)}) AS ms, string_split_regex(content, {_q(pattern)}) AS gs
          FROM code_files WHERE ext IN ('.ts', '.tsx', '.js', '.jsx')))"""

    return f"""i AS ({one(0, _NAMED, r"string_split(regexp_extract(ms[n], '\{([^}]+)\}', 1), ',')")} UNION ALL {one(1, _PLAIN, r"[regexp_extract(ms[n], '^import\s+([A-Za-z0-9_]+)', 1)]")}),
      e AS (SELECT path, content, kind, place, unnest(range(0, len(names))) AS pos, {_trim('unnest(names)')} AS raw FROM i),
      w AS (SELECT *, coalesce(nullif({_trim(r"string_split_regex(raw, '\s+as\s+')[2]")}, ''), string_split_regex(raw, '\\s+as\\s+')[1]) AS name FROM e),
      u AS (SELECT *, len(string_split(content[1:CAST(place AS BIGINT)], chr(10))) AS line FROM w WHERE (CASE WHEN kind = 0 THEN len(name) >= 2 ELSE name <> 'React' END)
        AND len(regexp_extract_all(content, '\\b' || regexp_escape(name) || '\\b')) <= 1),
      unused AS (SELECT path AS file, line, 'lint' AS type, 'low' AS severity, 'Unused import: ''' || name || '''' AS description, {len(R.RULES) + 1} AS rule_ord,
        CAST(row_number() OVER (PARTITION BY path ORDER BY kind, place, pos) - 1 AS INT) AS match_ord FROM u)"""


@query(oracle_with("code_files") + ", " + _unused_sql() + " SELECT * FROM unused")
def unused_imports(spark, d):
    return detect.unused_imports(view(spark, d, "code_files"))


#: A function's line, the 30 lines from it on, the first bracket closed in them, and what follows that on its and two more lines.
_MISSING = rf"""fl AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i, {_trim('unnest(ls)')} AS h, unnest(ls) AS raw FROM (SELECT path, string_split(content, chr(10)) AS ls FROM code_files WHERE ext IN ('.ts', '.tsx'))),
  fh AS (SELECT path, ls, i, array_to_string(ls[i:i + 29], chr(10)) AS block, regexp_extract(h, '^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(', 1) AS f,
      regexp_extract(h, '^(?:export\s+)?const\s+(\w+)\s*(?::\s*[^=]+?)?\s*=\s*(?:async\s*)?\(', 1) AS c, {_trim(r"regexp_extract(h, '^(?:export\s+)?const\s+(?:\w+)\s*(:\s*[^=]+?)?\s*=\s*(?:async\s*)?\(', 1)")} AS given
    FROM fl WHERE NOT regexp_matches(h, '^(//|\*|/\*)')),
  fb AS (SELECT path, i, p, ch, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY path, i ORDER BY p) AS depth FROM (
    SELECT path, i, unnest(range(1, len(block) + 1)) AS p, unnest(string_split(block, '')) AS ch FROM fh WHERE (f <> '' AND f <> 'constructor') OR (f = '' AND c NOT IN ('', 'constructor') AND len(given) <= 1))),
  fc AS (SELECT path, i, min(p) AS p FROM fb WHERE ch = ')' AND depth = 0 GROUP BY path, i),
  fr AS (SELECT path, i, f, c, split_part(block[p + 1:], chr(10), 1) || array_to_string(list_transform(list_prepend('', ls[e + 1:e + 2]), lambda x: {_trim('x')}), ' ') AS rest
    FROM (SELECT *, i + len(string_split(block[1:p], chr(10))) - 1 AS e FROM fh JOIN fc USING (path, i))),
  missing AS (SELECT path AS file, CAST(i AS INT) AS line, 'types' AS type, 'medium' AS severity, 'Function ''' || coalesce(nullif(f, ''), c) || ''' is missing an explicit return type annotation' AS description, {len(R.RULES)} AS rule_ord,
      CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INT) AS match_ord
    FROM fr WHERE CASE WHEN f <> '' THEN NOT regexp_matches(rest, '^\s*:') ELSE contains(rest, '=>') AND NOT regexp_matches(split_part(rest, '=>', 1), '[?;{{}}]') AND NOT (regexp_matches(rest, '^\s*:\s*\S') AND contains(split_part(rest, '=>', 1), ':')) END)"""


@query(oracle_with("code_files") + ", " + _MISSING + " SELECT * FROM missing")
def missing_return_types(spark, d):
    return detect.missing_return_types(view(spark, d, "code_files"))


_ALLS = _MISSING + ", " + _unused_sql() + ", alls AS (SELECT * FROM found UNION ALL SELECT * FROM missing UNION ALL SELECT * FROM unused)"
_ALL = _RULES + ", " + _ALLS


@query(
    _ALL
    + f""", once AS (SELECT * FROM alls QUALIFY row_number() OVER (PARTITION BY file, line, type ORDER BY rule_ord, match_ord) = 1), s AS (SELECT count(*) AS n_issues, CAST(sum({_PENALTY}) AS BIGINT) AS penalty FROM once),
    f AS (SELECT CAST(greatest(sum({_LOC}), 1) AS BIGINT) AS loc FROM code_files) SELECT n_issues, penalty, loc, CAST(least(100, greatest(0, floor(100.0::DOUBLE - penalty / greatest(1.0::DOUBLE, loc / 1000.0::DOUBLE) + 0.5::DOUBLE))) AS INT) AS score FROM s, f"""
)
def local_scan_score(spark, d):
    """All detectors, first-wins, score of the whole."""
    files = view(spark, d, "code_files")
    once = score.first_wins(detect.scan_local(files), ["rule_ord", "match_ord"])
    per = once.agg(F.count(F.lit(1)).alias("n_issues"), F.sum(score.penalty(F.col("severity"))).alias("penalty"))
    return per.crossJoin(score.lines_of_code(files)).select("n_issues", "penalty", "loc", score.score_of(F.col("penalty"), F.col("loc")).alias("score"))


# ---- scalars ---------------------------------------------------------------------------------------------------------


@query(
    oracle_with("doc_files")
    + f"""SELECT path, CAST(ceil(len(content) / 3.2::DOUBLE) AS BIGINT) AS tokens, CAST({_LOC} AS BIGINT) AS loc, substr(sha256(content), 1, 16) AS hash,
    CASE WHEN regexp_matches(path, '^.*/[^/.]+\\.[^/.]*$') THEN lower(regexp_extract(path, '\\.[^./]*$')) ELSE '' END AS extension, split_part(path, '/', 1) AS directory, split_part(path, '/', 2) AS base, split_part(path, '/', 1) AS top FROM doc_files"""
)
def file_facts(spark, d):
    files = sources.with_derived(view(spark, d, "doc_files"))
    return files.select("path", "tokens", "loc", "hash", X.extension(F.col("path")).alias("extension"), "directory", X.basename(F.col("path")).alias("base"), X.top_dir(F.col("path")).alias("top"))


@query("""SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || CASE WHEN s % 60 > 0 THEN s % 60 || 's' ELSE '' END
  ELSE s // 3600 || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN s % 3600 // 60 || 'm' ELSE '' END END AS shown,
  CAST(CASE o_orderkey % 6 WHEN 0 THEN o_orderkey * 60000 WHEN 1 THEN o_orderkey * 1000 WHEN 2 THEN o_orderkey * 60000 WHEN 3 THEN o_orderkey * 3600000 ELSE 1800000 END AS BIGINT) AS timeout
  FROM (SELECT o_orderkey, o_orderkey * 997 // 1000 AS s FROM orders)""")
def durations(spark, d):
    n = F.col("o_orderkey")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    text = F.concat(n.cast("string"), F.element_at(F.array(*map(F.lit, ("", "s", "m", "h", "h50m", "x"))), (n % 6 + 1).cast("int")))
    return orders.select(n.alias("id"), X.duration(n * 997).alias("shown"), X.timeout_ms(text).alias("timeout"))


_BAR = "repeat('█', CAST(f AS INT)) || repeat('░', w - CAST(f AS INT))"


@query(
    oracle_with("history")
    + """SELECT run, CASE WHEN score >= 90 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 30 THEN 'D' ELSE 'F' END AS letter,
    CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair' WHEN score >= 30 THEN 'Poor' ELSE 'Critical' END AS word,
    CASE WHEN score >= 90 THEN 'brightgreen' WHEN score >= 70 THEN 'green' WHEN score >= 50 THEN 'yellow' WHEN score >= 30 THEN 'orange' ELSE 'red' END AS badge,
    CASE WHEN score >= 90 THEN 'a' WHEN score >= 70 THEN 'b' WHEN score >= 50 THEN 'c' ELSE 'd' END AS dashboard,
    CASE WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS color,
    repeat('█', CAST(floor(score / 100.0::DOUBLE * 20 + 0.5::DOUBLE) AS INT)) || repeat('░', 20 - CAST(floor(score / 100.0::DOUBLE * 20 + 0.5::DOUBLE) AS INT)) AS bar,
    score - score_before AS delta FROM history"""
)
def grades(spark, d):
    s = F.col("score")
    return view(spark, d, "history").select("run", X.graded(s, 1).alias("letter"), X.graded(s, 2).alias("word"), X.graded(s, 4).alias("badge"), X.dashboard_grade(s).alias("dashboard"), X.score_color(s).alias("color"), X.progress_bar(s).alias("bar"), (s - F.col("score_before")).alias("delta"))


@query("""SELECT c_custkey AS id, CASE WHEN p > 1 AND p < len(t) THEN split_part(t, '/', 1) END AS owner, CASE WHEN p > 1 AND p < len(t) THEN substr(t, p + 1) END AS repo FROM (
  SELECT c_custkey, t, instr(t, '/') AS p FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || '/' || c_mktsegment WHEN 1 THEN c_name WHEN 2 THEN '/' || c_name WHEN 3 THEN c_name || '/' ELSE c_name || '/a/b' END AS t FROM customer))""")
def owner_and_repo(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    n, seg, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat(n, F.lit("/"), seg)).when(k == 1, n).when(k == 2, F.concat(F.lit("/"), n)).when(k == 3, F.concat(n, F.lit("/"))).otherwise(F.concat(n, F.lit("/a/b")))
    owner, repo = X.owner_repo(text)
    return c.select(F.col("c_custkey").alias("id"), owner.alias("owner"), repo.alias("repo"))


_PREFIX = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.COMMIT_PREFIX.items()) + " ELSE 'fix' END"


@query(oracle_with("issues") + f"SELECT seq, {_PREFIX} || ': ' || CASE WHEN len(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS message FROM (SELECT seq, type, description || repeat('!', CAST(seq % 60 AS INT)) AS t FROM issues)")
def commit_messages(spark, d):
    rows = view(spark, d, "issues")
    return outcomes.commit_messages(rows.withColumn("description", F.concat("description", F.repeat(F.lit("!"), (F.col("seq") % 60).cast("int")))))


@query("SELECT p_partkey AS id, CAST(floor(greatest(p_size * 300 - 500, 1000) * 3.2::DOUBLE) AS BIGINT) AS budget, CASE p_partkey % 3 WHEN 0 THEN 8000 WHEN 1 THEN 16000 ELSE 8000 END AS model_limit FROM part")
def model_budgets(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    model = F.when(F.col("p_partkey") % 3 == 0, "openai/gpt-4o").when(F.col("p_partkey") % 3 == 1, "own/model").otherwise("unknown-model")
    return p.select(F.col("p_partkey").alias("id"), X.code_budget(F.col("p_size") * 300).alias("budget"), X.model_limit(model, {"own/model": 16000}).alias("model_limit"))


_Q, _A = '"' * 3, "''" * 3  # three double quotes; three single ones inside a literal


_BARE = (
    "bare AS (SELECT path, ext, content, regexp_replace(CASE WHEN ext = '.py' "
    + rf"THEN regexp_replace(regexp_replace(regexp_replace(content, '(?s){_Q}.*?{_Q}', '{_Q}{_Q}', 'g'), '(?s){_A}.*?{_A}', '{_A}{_A}', 'g'), '(?m)^(\s*)#([^!\n].*)?$', '', 'g') "
    + r"ELSE regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*$', '', 'g') END, '\n{3,}', chr(10) || chr(10), 'g') AS t FROM code_files)"
)


@query(oracle_with("code_files") + f", {_BARE} SELECT path, len(t) AS n_chars, substr(sha256(t), 1, 16) AS hash FROM bare")
def comments_stripped(spark, d):
    rows = view(spark, d, "code_files").select("path", compress.without_comments(F.col("content"), F.col("ext")).alias("t"))
    return rows.select("path", F.length("t").alias("n_chars"), X.content_hash(F.col("t")).alias("hash"))


#: Line by line: whether a body is open (the indent of its declaration) and the number of the line in it; four lines on, all
#: but the last are gone, and that one is the mark.
_FITTED = rf""", sk AS (SELECT path, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS t, ext FROM (SELECT path, ext, string_split(t, chr(10)) AS ls FROM bare WHERE len(content) > 140 AND len(t) > 140)),
  si AS (SELECT path, i, t, CASE WHEN regexp_matches(t, '\S') THEN len(regexp_extract(t, '^\s*')) END AS indent, len(regexp_extract(t, '^\s*')) AS lead,
    CASE WHEN ext = '.py' THEN regexp_matches(t, '^(\s*)(def |class |async def )') ELSE regexp_matches(t, '^(\s*)(function |class |const \w+\s*=\s*(?:async\s*)?\(|export (?:default )?(?:function|class|const|async)|interface |type \w+\s*=)') END AS head FROM sk),
  sw AS (SELECT path, i, t, CASE WHEN head THEN lead END AS base, 0 AS nth FROM si WHERE i = 1 UNION ALL
    SELECT n.path, n.i, n.t, CASE WHEN w.base IS NULL THEN CASE WHEN n.head THEN n.lead END WHEN n.indent <= w.base THEN NULL ELSE w.base END,
      CASE WHEN w.base IS NULL OR n.indent <= w.base THEN 0 ELSE w.nth + 1 END FROM sw w JOIN si n ON n.path = w.path AND n.i = w.i + 1),
  so AS (SELECT path, i, CASE WHEN nth <= 3 THEN t WHEN coalesce(lead(nth) OVER (PARTITION BY path ORDER BY i), 0) = 0 THEN repeat(' ', CAST(base + 2 AS INT)) || '// ... ' || (nth - 3) || ' lines collapsed' END AS line FROM sw),
  sd AS (SELECT path, string_agg(line, chr(10) ORDER BY i) AS skeleton FROM so GROUP BY path),
  fit AS (SELECT path, len(content) > 140 AS compressed, CASE WHEN len(content) <= 140 THEN content WHEN len(t) <= 140 THEN t WHEN len(skeleton) <= 140 THEN skeleton
    ELSE substr(skeleton, 1, CAST(140 - len(note) AS BIGINT)) || note END AS fit FROM (SELECT *, chr(10) || '// ... truncated (' || CAST(floor(len(content) / 1024.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) || 'KB original)' || chr(10) AS note FROM bare LEFT JOIN sd USING (path)))"""


@query((oracle_with("code_files") + ", " + _BARE + _FITTED + " SELECT path, CAST(len(fit) AS INT) AS n_chars, compressed, substr(sha256(fit), 1, 16) AS hash FROM fit").replace("WITH ", "WITH RECURSIVE ", 1))
def compressed_files(spark, d):
    done = compress.fitted(view(spark, d, "code_files"), F.lit(140))
    return done.select("path", F.length("fit").alias("n_chars"), "compressed", X.content_hash(F.col("fit")).alias("hash"))


def _prints_sql(local: str | None) -> str:
    """prints(path, line_count, n_imports, ..., text, tokens) over code_files; local: a table of issues."""
    nl = "chr(10)"
    caught = f"pc AS (SELECT file AS path, list('  L' || coalesce(CAST(nullif(line, 0) AS VARCHAR), '?') || ':' || type || ': ' || substr(description, 1, 60) || {nl} ORDER BY rule_ord, match_ord) AS c FROM {local} GROUP BY file)" if local else "pc AS (SELECT '' AS path, [''] AS c WHERE false)"
    more = lambda x, n, before, after: f"CASE WHEN len({x}) > {n} THEN '{before}' || (len({x}) - {n}) || '{after}' ELSE '' END"
    return (
        f"{_hotspot_sql()}, {_signature_sql()}, pi AS (SELECT path, {_LIGHT} AS i, len(string_split(content, {nl})) AS line_count FROM code_files), "
        "ps AS (SELECT path, list('L' || line || ':' || name || CASE WHEN params IS NOT NULL THEN '(' || substr(params, 1, 60) || ')' ELSE '' END || CASE WHEN \"returns\" IS NOT NULL THEN '->' || substr(\"returns\", 1, 40) ELSE ' [NO_RETURN_TYPE]' END ORDER BY line) AS s FROM signed GROUP BY path), "
        f"ph AS (SELECT path, list('  L' || n || ' [' || label || ']: ' || snippet || {nl} ORDER BY n, ord) AS h FROM (SELECT path, n, label, substr({_trim('min(t)')}, 1, 80) AS snippet, min(ord) AS ord FROM h GROUP BY path, n, label) GROUP BY path), {caught}, "
        "pm AS (SELECT pi.path, line_count, i, coalesce(s, []) AS s, coalesce(h, []) AS h, coalesce(c, []) AS c FROM pi LEFT JOIN ps USING (path) LEFT JOIN ph USING (path) LEFT JOIN pc USING (path)), "
        f"pt AS (SELECT *, '=== ' || path || ' (' || line_count || ' lines) ===' || {nl} || CASE WHEN len(i) > 0 THEN 'IMPORTS: ' || array_to_string(i[1:10], ', ') || {more('i', 10, ' +', ' more')} || {nl} ELSE '' END "
        f"|| CASE WHEN len(s) > 0 THEN 'DEFS: ' || array_to_string(s, ', ') || {nl} ELSE '' END || CASE WHEN len(h) > 0 THEN 'FLAGS:' || {nl} || array_to_string(h[1:8], '') || {more('h', 8, '  +', ' more hotspots')} || CASE WHEN len(h) > 8 THEN {nl} ELSE '' END ELSE '' END "
        f"|| CASE WHEN len(c) > 0 THEN 'ALREADY_CAUGHT_LOCALLY:' || {nl} || array_to_string(c[1:6], '') || {more('c', 6, '  +', ' more local issues')} || CASE WHEN len(c) > 6 THEN {nl} ELSE '' END ELSE '' END AS text FROM pm), "
        "prints AS (SELECT path, CAST(line_count AS INT) AS line_count, CAST(len(i) AS INT) AS n_imports, CAST(len(s) AS INT) AS n_signatures, CAST(len(h) AS INT) AS n_hotspots, CAST(len(c) AS INT) AS n_local, text, CAST(ceil(len(text) / 3.2::DOUBLE) AS BIGINT) AS tokens FROM pt)"
    )


@query(_RULES + ", " + _prints_sql("found") + " SELECT * FROM prints")
def fingerprint_texts(spark, d):
    files = view(spark, d, "code_files")
    return compress.fingerprints(files, detect.scan_rules(files))


@query(oracle_with("code_files") + ", " + _prints_sql(None) + " SELECT count(*) AS files, CAST(sum(n_hotspots) AS BIGINT) AS hotspots, CAST(floor(avg(tokens) + 0.5::DOUBLE) AS BIGINT) AS avg_tokens FROM prints")
def hotspot_totals(spark, d):
    return compress.hotspot_totals(compress.fingerprints(view(spark, d, "code_files")))


@query(
    oracle_with("code_files", "issues")
    + """SELECT seq, array_to_string(list_transform(range(greatest(1, line - 15), least(len(ls), line + 15) + 1), lambda i: i || ': ' || ls[i]), chr(10)) AS context
    FROM (SELECT seq, line, string_split(content, chr(10)) AS ls FROM issues JOIN code_files ON file = path WHERE line IS NOT NULL)"""
)
def context_windows(spark, d):
    met = view(spark, d, "issues").where("line is not null").join(view(spark, d, "code_files"), F.col("file") == F.col("path"))
    return met.select("seq", verify.context_window(F.col("content"), F.col("line")).alias("context"))


# ---- filters ---------------------------------------------------------------------------------------------------------

_UP = _ranked("severity", R.RANK_UP, 0)


@query(oracle_with("issues") + f"SELECT seq, file, type, severity FROM issues WHERE type NOT IN ('lint', 'bugs') AND {_UP} >= 1 AND NOT regexp_matches(file, '^d1/.*$') AND NOT regexp_matches(file, '^root[^/]*\\.py$')")
def filtered_issues(spark, d):
    wanted = policy.merge_filters([policy.Filters(("d1/**",), ("lint",), "low"), policy.Filters(("root*.py",), ("lint", "bugs"), "medium")])
    return policy.apply_filters(view(spark, d, "issues"), wanted).select("seq", "file", "type", "severity")


@query(oracle_with("issues") + f"SELECT seq, severity FROM issues WHERE {_UP} >= 2")
def severe_issues(spark, d):
    return policy.min_severity(view(spark, d, "issues"), "high").select("seq", "severity")


@query(oracle_with("issues") + "SELECT seq, file FROM issues WHERE NOT regexp_matches(file || ':' || description, '(?i)ROOT[12]') AND NOT regexp_matches(file || ':' || description, '(?i)block 4.$')")
def allowed_out(spark, d):
    return policy.apply_allow_rules(view(spark, d, "issues"), ["ROOT[12]", "(unclosed", "block 4.$"]).select("seq", "file")


@query(oracle_with("issues") + "SELECT seq FROM issues WHERE NOT regexp_matches(file || ':' || description, '(?i)block [12]') AND NOT regexp_matches(file || ':' || description, '(?i)m3')")
def allow_table(spark, d):
    rules = spark.createDataFrame([("block [12]",), ("M3",)], "pattern string")
    return policy.apply_allow_table(view(spark, d, "issues"), rules).select("seq")


@query(oracle_with("issues") + "SELECT DISTINCT x AS name FROM (SELECT type AS x FROM issues UNION ALL SELECT severity FROM issues WHERE severity <> 'odd' UNION ALL SELECT 'lint')")
def union_distinct(spark, d):
    i = view(spark, d, "issues")
    return i.select(F.col("type").alias("name")).union(i.where("severity <> 'odd'").select("severity")).union(spark.createDataFrame([("lint",)], "name string")).distinct()


@query("SELECT path FROM (SELECT CASE p_partkey % 9 WHEN 0 THEN 'src/a' || p_partkey || '.ts' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN '.github/w.yml' WHEN 3 THEN '.hidden/y.py' WHEN 4 THEN 'a/Dockerfile' WHEN 5 THEN 'b/readme.md' WHEN 6 THEN 'c/' || p_partkey || '.PY' WHEN 7 THEN 'dist/z.ts' ELSE 'Makefile' END AS path, p_partkey FROM part) WHERE p_partkey % 9 IN (0, 2, 4, 6, 8)")
def source_paths(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    n = F.col("p_partkey").cast("string")
    options = (F.concat(F.lit("src/a"), n, F.lit(".ts")), F.lit("node_modules/x.js"), F.lit(".github/w.yml"), F.lit(".hidden/y.py"), F.lit("a/Dockerfile"), F.lit("b/readme.md"), F.concat(F.lit("c/"), n, F.lit(".PY")), F.lit("dist/z.ts"), F.lit("Makefile"))
    path = F.element_at(F.array(*options), (F.col("p_partkey") % 9 + 1).cast("int"))
    return p.select(path.alias("path")).where(sources.is_source(F.col("path")))


@query(oracle_with("code_files") + "SELECT path FROM code_files WHERE id % 3 = 0 AND id % 2 = 0")
def changed_scope(spark, d):
    files = view(spark, d, "code_files")
    path = F.when(F.col("id") % 3 == 0, F.col("path")).otherwise(F.concat(F.lit("gone/"), "path"))
    changes = files.select(path.alias("path"), F.when(F.col("id") % 2 == 0, "modified").otherwise("removed").alias("status"))
    return sources.scope(files, changes).select("path")


# ---- roll-ups --------------------------------------------------------------------------------------------------------


@query(oracle_with("issues") + "SELECT seq, file, line, type, severity FROM issues QUALIFY row_number() OVER (PARTITION BY file, line, type ORDER BY seq) = 1")
def first_wins(spark, d):
    return score.first_wins(view(spark, d, "issues"), ["seq"]).select("seq", "file", "line", "type", "severity")


@query(oracle_with("issues") + "SELECT type, severity, count(*) AS n FROM issues GROUP BY ALL")
def counts_by_type_and_severity(spark, d):
    return score.count_by(view(spark, d, "issues"), "type", "severity")


_PLACE = _ranked("severity", {s: i for i, s in enumerate(R.SEVERITIES)}, 999)


@query(
    oracle_with("issues")
    + f""", t AS (SELECT type, count(*) AS n, least(min({_PLACE}), 3) AS rank FROM issues GROUP BY type), b AS (SELECT *, greatest(1, floor(n / (max(n) OVER ())::DOUBLE * 10 + 0.5::DOUBLE)) AS f FROM t)
    SELECT type, n, rank, ['critical', 'high', 'medium', 'low'][rank + 1] AS worst, ['Critical', 'High', 'Medium', 'Low'][rank + 1] AS worst_label,
      repeat('█', CAST(f AS INT)) || repeat('░', 10 - CAST(f AS INT)) AS bar FROM b"""
)
def type_rollup(spark, d):
    return score.type_rollup(view(spark, d, "issues"))


@query(oracle_with("issues") + "SELECT severity, n, CAST(floor(100.0::DOUBLE * n / sum(n) OVER () + 0.5::DOUBLE) AS BIGINT) AS pct FROM (SELECT severity, count(*) AS n FROM issues GROUP BY 1)")
def severity_share(spark, d):
    return score.severity_share(view(spark, d, "issues"))


@query(oracle_with("issues") + "SELECT count(*) FILTER (source = 'local') AS local, count(*) FILTER (source = 'ai') AS ai, count(*) FILTER (source IS NULL) AS other FROM issues")
def source_totals(spark, d):
    return score.source_totals(view(spark, d, "issues"))


@query(oracle_with("doc_files") + "SELECT coalesce(nullif(ext, ''), 'other') AS ext, count(*) AS n FROM doc_files GROUP BY 1 ORDER BY n DESC, ext LIMIT 5")
def extension_top(spark, d):
    return score.extension_top(view(spark, d, "doc_files"))


def _score_sql(total: str) -> str:
    return f"CAST(least(100, greatest(0, floor(100.0::DOUBLE - {total} + 0.5::DOUBLE))) AS INT)"


@query(oracle_with("issues") + f"SELECT dir, {_score_sql('sum(p)')} AS score_before, {_score_sql('coalesce(sum(p) FILTER (status <> ' + _q('fixed') + '), 0)')} AS score_after FROM (SELECT file AS dir, {_PENALTY} AS p, status FROM issues) GROUP BY dir")
def score_changes(spark, d):
    p = score.penalty(F.col("severity"))
    return view(spark, d, "issues").groupBy(F.col("file").alias("dir")).agg(score.score_of(F.sum(p)).alias("score_before"), score.score_of(F.coalesce(F.sum(F.when(F.col("status") != "fixed", p)), F.lit(0))).alias("score_after"))


@query(oracle_with("issues") + f"SELECT {_score_sql(f'sum({_PENALTY})')} AS score_before, {_score_sql(f'coalesce(sum({_PENALTY}) FILTER (status <> {_q("fixed")}), 0)')} AS score_after FROM issues")
def score_change_total(spark, d):
    return score.score_change(view(spark, d, "issues"))


@query(oracle_with("issues") + "SELECT type, count(*) AS n FROM issues WHERE status = 'fixed' GROUP BY type")
def fixed_by_type(spark, d):
    return score.by_type_fixed(view(spark, d, "issues")).select(F.explode("by_type").alias("type", "n"))


@query(
    oracle_with("passes")
    + """SELECT CAST(sum(found) AS BIGINT) AS found, max(found) AS most_found, CAST(sum(fixed) AS BIGINT) AS fixed, max(fixed) AS most_fixed, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) AS passes,
    (CAST(sum(duration_ms) AS BIGINT) // 3600000) || 'h' || CASE WHEN CAST(sum(duration_ms) AS BIGINT) // 60000 % 60 > 0 THEN (CAST(sum(duration_ms) AS BIGINT) // 60000 % 60) || 'm' ELSE '' END AS duration FROM passes"""
)
def pass_totals(spark, d):
    return score.pass_totals(view(spark, d, "passes"))


@query(oracle_with("history") + "SELECT n AS runs, total_fixed, run, score, passes, agent, date, CASE WHEN score >= 90 THEN 'a' WHEN score >= 70 THEN 'b' WHEN score >= 50 THEN 'c' ELSE 'd' END AS grade FROM (SELECT *, count(*) OVER () AS n, CAST(sum(fixed) OVER () AS BIGINT) AS total_fixed FROM history) ORDER BY run DESC LIMIT 1")
def dashboard_facts(spark, d):
    return score.dashboard_facts(view(spark, d, "history"))


@query(oracle_with("history") + "SELECT run, score, row_number() OVER (ORDER BY run DESC) AS place FROM history")
def history_newest_first(spark, d):
    return score.newest_first(view(spark, d, "history")).select("run", "score", "place")


_TIERS = "tiers(model, per_day, tier) AS (VALUES " + ", ".join(f"('{m[0]}', {m[1]}, '{m[6]}')" for m in R.MODELS) + ")"
_REMAINING = oracle_with("usage") + f", {_TIERS}, r AS (SELECT t.model, tier, CAST(coalesce(sum(requests_used), 0) AS BIGINT) AS used, CAST(greatest(0, any_value(per_day) - coalesce(sum(requests_used), 0)) AS BIGINT) AS remaining FROM tiers t LEFT JOIN (SELECT * FROM usage WHERE date = DATE '1997-05-28') u ON t.model = u.model GROUP BY t.model, tier)"


@query(_REMAINING + " SELECT model, tier, used, remaining FROM r")
def remaining_requests(spark, d):
    return outcomes.remaining_requests(view(spark, d, "usage"), F.to_date(F.lit("1997-05-28")))


@query(_REMAINING + ", s AS (SELECT CAST(sum(remaining) AS BIGINT) AS total, max(remaining) FILTER (model = 'openai/gpt-4o-mini') AS own FROM r) SELECT total, own, CASE WHEN total < 15 THEN 'critical' WHEN own >= 20 OR total >= 40 THEN 'flush' ELSE 'normal' END AS level FROM s")
def budget_level(spark, d):
    return outcomes.budget_level(outcomes.remaining_requests(view(spark, d, "usage"), F.to_date(F.lit("1997-05-28"))), "openai/gpt-4o-mini")


@query(_REMAINING + " SELECT model FROM r WHERE remaining > 0 AND tier = 'low' ORDER BY remaining DESC, model LIMIT 1")
def chosen_model(spark, d):
    return outcomes.choose_model(outcomes.remaining_requests(view(spark, d, "usage"), F.to_date(F.lit("1997-05-28"))), "low")


_DOWN = _ranked("severity", R.RANK_DOWN, 9)


@query(oracle_with("issues") + f"SELECT seq, severity FROM issues ORDER BY {_DOWN}, seq LIMIT 25")
def top_issues(spark, d):
    return score.top_issues(view(spark, d, "issues"), 25).select("seq", "severity")


@query(oracle_with("issues") + "SELECT seq, file FROM issues WHERE status = 'fixed' ORDER BY seq DESC LIMIT 20")
def last_fixes(spark, d):
    return score.last_fixed(view(spark, d, "issues")).select("seq", "file")


@query(
    oracle_with("issues")
    + f""", r AS (SELECT *, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) ELSE '.' END AS directory, {_DOWN} AS rank FROM issues),
    b AS (SELECT *, CAST((row_number() OVER (PARTITION BY directory ORDER BY rank, seq) - 1) // 10 AS INT) AS batch, min(seq) OVER (PARTITION BY directory) AS first FROM r)
    SELECT row_number() OVER (ORDER BY worst, first, batch) AS cluster_rank, directory, batch, n, n_files, worst FROM
      (SELECT directory, batch, any_value(first) AS first, count(*) AS n, count(DISTINCT file) AS n_files, min(rank) AS worst FROM b GROUP BY directory, batch)"""
)
def clusters(spark, d):
    return score.clusters(view(spark, d, "issues"))


@query(oracle_with("issues") + "SELECT seq, CAST((row_number() OVER (PARTITION BY file ORDER BY seq) - 1) // 8 AS INT) AS batch, CAST((row_number() OVER (PARTITION BY file ORDER BY seq) - 1) % 8 AS INT) AS \"index\" FROM issues")
def verification_batches(spark, d):
    return score.batches(view(spark, d, "issues"), ["seq"], 8, ["file"]).select("seq", "batch", "index")


@query(oracle_with("issues") + "SELECT status, count(*) AS n FROM issues WHERE status IN ('fixed', 'skipped') GROUP BY status")
def split_by_status(spark, d):
    fixed, skipped = score.split_status(view(spark, d, "issues"))
    return fixed.unionByName(skipped).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- joins -----------------------------------------------------------------------------------------------------------

_HIT = "f.hash = c.hash AND (c.strategy = 'deep' OR c.strategy = 'fingerprint')"
_HASHED = "hashed AS (SELECT path, substr(sha256(content), 1, 16) AS hash FROM doc_files)"


@query(oracle_with("doc_files", "cache") + f", {_HASHED} SELECT f.path, f.hash, coalesce({_HIT}, false) AS hit FROM hashed f LEFT JOIN cache c ON f.path = c.path")
def cache_partition(spark, d):
    return incremental.partition(view(spark, d, "doc_files"), view(spark, d, "cache"), "fingerprint").select("path", "hash", "hit")


@query(oracle_with("doc_files", "cache") + f", {_HASHED}, m AS (SELECT coalesce({_HIT}, false) AS hit FROM hashed f LEFT JOIN cache c ON f.path = c.path) SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM m")
def cache_hits(spark, d):
    rows = incremental.partition(view(spark, d, "doc_files"), view(spark, d, "cache"), "fingerprint")
    return rows.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(
    oracle_with("doc_files", "cache")
    + f""", {_HASHED}, s AS (SELECT f.path, f.hash FROM hashed f LEFT JOIN cache c ON f.path = c.path WHERE NOT coalesce({_HIT}, false)),
    n AS (SELECT path, CAST(CASE WHEN substr(hash, 1, 1) IN ('0', '1', '2', '3') THEN 1 ELSE 0 END AS INT) AS n_issues, hash, 'fingerprint' AS strategy FROM s)
    SELECT path, hash, strategy, n_issues FROM n UNION ALL SELECT path, hash, strategy, n_issues FROM cache WHERE path IN (SELECT path FROM hashed) AND path NOT IN (SELECT path FROM s)"""
)
def cache_upsert(spark, d):
    old = view(spark, d, "cache")
    files = view(spark, d, "doc_files")
    issue = F.struct(F.lit("x").alias("file"), F.lit("lint").alias("type"))
    cache = old.select("path", "hash", "strategy", F.lit("t0").alias("scanned_at"), F.array_repeat(issue, F.col("n_issues")).alias("issues"))
    missed = incremental.partition(files, old, "fingerprint").where("not hit").select("path", "hash")
    issues = missed.where(F.substring("hash", 1, 1).isin("0", "1", "2", "3")).select(F.col("path").alias("file"), F.lit("lint").alias("type"))
    fresh = incremental.upsert(cache, missed, issues, files.select("path"), "fingerprint", "t1")
    return fresh.select("path", "hash", "strategy", F.size("issues").alias("n_issues"))


_LOCAL = _RULES.replace("WITH ", "WITH ai_found AS (" + oracle_with("ai_found").split("AS (", 1)[1].rstrip()[:-1] + "), ", 1)
_TOLD = ", told AS (SELECT file, line, type FROM found)"
_NODUP = """, nodup AS (SELECT * FROM ai_found a WHERE NOT EXISTS (SELECT 1 FROM told l WHERE l.file = a.file AND l.type = a.type AND (abs(a.line - l.line) <= 3 OR (a.line IS NULL AND l.line IS NULL))))"""


@query(_LOCAL + _TOLD + _NODUP + " SELECT seq, file, line, type FROM nodup")
def near_local_dropped(spark, d):
    return verify.drop_local_duplicates(view(spark, d, "ai_found"), detect.scan_rules(view(spark, d, "code_files"))).select("seq", "file", "line", "type")


@query(oracle_with("ai_found", "code_files") + "SELECT seq, file FROM ai_found WHERE file IN (SELECT path FROM code_files)")
def in_known_files(spark, d):
    return verify.in_known_files(view(spark, d, "ai_found"), view(spark, d, "code_files")).select("seq", "file")


def _norm(x: str) -> str:
    return f"lower(regexp_replace({_trim(x)}, '\\s+', ' ', 'g'))"


def _corrected(source: str) -> str:
    return f""", c AS (SELECT a.*, content, string_split(content, chr(10)) AS ls, {_norm('line_content')} AS claim FROM {source} a JOIN code_files ON file = path),
      k AS (SELECT *, coalesce(len(claim) > 10 AND line > 0, false) AS checked, (SELECT min(j) FROM (SELECT unnest(range(greatest(1, line - 5), least(len(ls), line + 5) + 1)) AS j) WHERE contains({_norm('ls[j]')}, claim) OR contains(claim, {_norm('ls[j]')})) AS hit FROM c),
      corrected AS (SELECT * REPLACE (CASE WHEN checked THEN CAST(hit AS INT) ELSE line END AS line), checked AS content_verified FROM k WHERE NOT checked OR hit IS NOT NULL)"""


@query(oracle_with("ai_found", "code_files") + _corrected("ai_found") + " SELECT seq, line, content_verified FROM corrected")
def corrected_lines(spark, d):
    files = view(spark, d, "code_files")
    return verify.correct_lines(verify.in_known_files(view(spark, d, "ai_found"), files), files).select("seq", "line", "content_verified")


def _evidence_sql() -> str:
    region = "array_to_string(ls[greatest(1, coalesce(line, 1) - 15):coalesce(line, 1) + 15], chr(10))"
    flat = lambda x: f"lower(regexp_replace({x}, '\\s+', ' ', 'g'))"
    cases = []
    for keywords, needs in R.EVIDENCE:
        named = " AND ".join("(" + " OR ".join(f"contains(lower(description), {_q(w)})" for w in words) + ")" for words in keywords)
        cases.append(f"WHEN {named} THEN " + " AND ".join(f"regexp_matches({region}, {_q(p)})" for p in needs))
    return f"(coalesce(len({_trim('evidence')}) > 15 AND (contains({flat(region)}, {_norm('evidence')}) OR contains({flat('content')}, {_norm('evidence')})), false) OR CASE {' '.join(cases)} ELSE false END)"


_GRAVE = "type = 'security' AND severity IN ('high', 'critical') AND NOT content_verified"


@query(oracle_with("ai_found", "code_files") + f", e AS (SELECT a.*, content, string_split(content, chr(10)) AS ls FROM ai_found a JOIN code_files ON file = path) SELECT seq, {_evidence_sql()} AS borne FROM e")
def evidence_checks(spark, d):
    met = view(spark, d, "ai_found").join(view(spark, d, "code_files"), F.col("file") == F.col("path"))
    return met.select("seq", verify.has_evidence(F.col("description"), F.col("evidence"), F.col("line"), F.col("content")).alias("borne"))


@query(_LOCAL + _TOLD + _NODUP + _corrected("nodup") + f" SELECT seq, file, line, type, severity FROM corrected WHERE NOT ({_GRAVE}) OR {_evidence_sql()}")
def verified_findings(spark, d):
    files = view(spark, d, "code_files")
    return verify.verify(view(spark, d, "ai_found"), detect.scan_rules(files), files).select("seq", "file", "line", "type", "severity")


@query(oracle_with("issues") + "SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS n FROM issues) WHERE n % 3 = 0 AND n % 5 <> 0")
def real_verdicts(spark, d):
    rows = score.batches(view(spark, d, "issues"), ["seq"], 8, ["file"])
    place = F.col("batch") * 8 + F.col("index")
    # A verdict that names no issue of its batch, and some that are not real.
    index = F.when(place % 5 == 0, F.col("index") + 8).otherwise(F.col("index"))
    verdicts = rows.select("file", "batch", index.alias("index"), (place % 3 == 0).alias("is_real"))
    return verify.keep_real(rows, verdicts, ["file", "batch", "index"]).select("seq")


@query(oracle_with("ai_found") + "SELECT file FROM (SELECT file, min(seq) AS s FROM ai_found GROUP BY file ORDER BY s, file LIMIT 5)")
def suspicious_files(spark, d):
    return verify.suspicious_files(view(spark, d, "ai_found"))


@query(
    oracle_with("worked", "results")
    + """, m AS (SELECT w.cluster_id, w.seq, w.file, w.line, r.status, r.reason, r.ord IS NOT NULL AS met FROM worked w LEFT JOIN results r ON w.cluster_id = r.cluster_id AND w.file = r.file AND (r.line IS NULL OR r.line = 0 OR r.line = w.line)
      QUALIFY row_number() OVER (PARTITION BY w.seq ORDER BY r.ord) = 1)
    SELECT cluster_id, seq, file, line, CASE WHEN status = 'fixed' THEN 'fixed' ELSE 'skipped' END AS status,
      CASE WHEN status = 'fixed' THEN NULL WHEN status = 'skipped' THEN coalesce(nullif(reason, ''), 'Agent could not fix') ELSE 'No result reported by agent' END AS skip_reason FROM m"""
)
def matched_results(spark, d):
    return outcomes.match_results(view(spark, d, "worked"), view(spark, d, "results"))


@query(
    oracle_with("worked", "results")
    + """, ch AS (SELECT DISTINCT cluster_id, file FROM results WHERE status = 'fixed'), m AS (SELECT w.*, ch.file IS NOT NULL AS c FROM worked w LEFT JOIN ch ON w.cluster_id = ch.cluster_id AND w.file = ch.file)
    SELECT cluster_id, seq, file, CASE WHEN c THEN 'fixed' ELSE 'skipped' END AS status, CASE WHEN NOT c THEN 'Agent did not modify this file' END AS skip_reason FROM m WHERE cluster_id IN (SELECT cluster_id FROM m WHERE c)"""
)
def inferred_from_changes(spark, d):
    changed = view(spark, d, "results").where("status = 'fixed'").select("cluster_id", "file")
    return outcomes.infer_from_changes(view(spark, d, "worked"), changed)


@query(
    oracle_with("worked", "commits")
    + """, f AS (SELECT file, arg_min(sha, ord) AS commit_sha FROM commits GROUP BY file)
    SELECT seq, w.file, CASE WHEN commit_sha IS NULL THEN 'skipped' ELSE 'fixed' END AS status, CASE WHEN commit_sha IS NULL THEN 'Cherry-pick conflict — fix lost' END AS skip_reason, commit_sha FROM worked w LEFT JOIN f ON w.file = f.file"""
)
def attached_commits(spark, d):
    return outcomes.attach_commits(view(spark, d, "worked"), view(spark, d, "commits"))


def _test_command_sql() -> str:
    facts, cases = [], []
    for i, (names, folder, text) in enumerate(outcomes.TEST_COMMANDS):
        there = f"path IN ({', '.join(map(_q, names))})"
        if "package.json" in names:
            there += " AND coalesce(json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.scripts.test') NOT LIKE '%no test specified%', false)"
        facts.append(f"bool_or({there}) AS f{i}")
        if folder:
            facts.append(f"bool_or(path LIKE '{folder}/%') AS d{i}")
        cases.append(f"WHEN f{i}{f' AND d{i}' if folder else ''} THEN {_q(text)}")
    return f"SELECT repo, CASE {' '.join(cases)} ELSE '' END AS command FROM (SELECT repo, {', '.join(facts)} FROM markers GROUP BY repo)"


@query(oracle_with("markers") + _test_command_sql())
def test_command_of_repos(spark, d):
    return outcomes.commands_for_tests(view(spark, d, "markers"))


_RESOLVED = oracle_with("code_files") + f""", {_IMPORTS},
  cand AS (SELECT path, pos, spec, 0 AS ord, regexp_replace(spec, '\\.', '/', 'g') || '.py' AS candidate FROM imports WHERE NOT starts_with(spec, '.') UNION ALL
    SELECT path, pos, spec, 1, regexp_replace(spec, '\\.', '/', 'g') || '/__init__.py' FROM imports WHERE NOT starts_with(spec, '.') UNION ALL
    SELECT path, pos, spec, unnest(range(0, 8)), CASE WHEN starts_with(spec, './') THEN split_part(path, '/', 1) || '/' || substr(spec, 3) ELSE substr(spec, 4) END || unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js']) FROM imports WHERE starts_with(spec, '.')),
  resolved AS (SELECT path, pos, spec, arg_min(candidate, ord) AS target FROM cand WHERE candidate IN (SELECT path FROM code_files) GROUP BY path, pos, spec)"""
_EDGES = _RESOLVED + ", edges AS (SELECT path AS src, target AS dst FROM resolved WHERE path <> target UNION SELECT target, path FROM resolved WHERE path <> target)"


@query(_RESOLVED + " SELECT path, pos, spec, target FROM resolved")
def resolved_imports(spark, d):
    files = view(spark, d, "code_files")
    return graph.resolve_imports(detect.full_imports(files), files)


@query(_EDGES + ", g AS (SELECT src, count(*) AS n FROM edges GROUP BY src) SELECT path, coalesce(n, 0) AS degree FROM code_files LEFT JOIN g ON path = src")
def file_degrees(spark, d):
    files = view(spark, d, "code_files")
    return graph.degrees(files, graph.file_graph(graph.resolve_imports(detect.full_imports(files), files)))


@query(
    oracle_with("code_files")
    + f""", {_IMPORTS}, placed AS (SELECT path, id % 7 AS chunk, id AS pos FROM code_files), j AS (SELECT DISTINCT chunk, i.path, spec FROM imports i JOIN placed p ON i.path = p.path), n AS (SELECT DISTINCT chunk AS from_chunk, spec FROM j),
    fwd AS (SELECT n.from_chunk AS chunk, p.chunk AS other_chunk, p.path, p.pos FROM n JOIN placed p ON p.chunk <> n.from_chunk AND (ends_with(p.path, spec || '.ts') OR ends_with(p.path, spec || '.py') OR ends_with(p.path, regexp_replace(spec, '\\.', '/', 'g') || '.py') OR p.path = spec)),
    back AS (SELECT p.chunk, j.chunk AS other_chunk, j.path, q.pos FROM j JOIN placed p ON p.chunk <> j.chunk AND (ends_with(p.path, spec || '.ts') OR ends_with(p.path, spec || '.py') OR p.path = spec) JOIN placed q ON q.path = j.path)
    SELECT chunk, other_chunk, path, CAST(row_number() OVER (PARTITION BY chunk ORDER BY other_chunk, pos, path) AS INT) AS n FROM (SELECT * FROM fwd UNION SELECT * FROM back) QUALIFY n <= 6"""
)
def related_files(spark, d):
    files = view(spark, d, "code_files")
    return graph.related_files(files.select("path", (F.col("id") % 7).alias("chunk"), F.col("id").alias("pos")), detect.full_imports(files))


@query(
    oracle_with("code_files")
    + """, r AS (SELECT split_part(path, '/', 1) AS directory, split_part(path, '/', 2) AS name, ext, path FROM code_files),
    k AS (SELECT directory, ext, count(*) AS n, min(path) AS first FROM r GROUP BY ALL)
    SELECT directory, '  ' || directory || '/ ' || string_agg(n || ext, ' ' ORDER BY first) AS line FROM k GROUP BY directory"""
)
def directory_manifest(spark, d):
    return graph.directory_manifest(view(spark, d, "code_files"))


@query(
    oracle_with("doc_files").replace("WITH ", "WITH RECURSIVE ")
    + """, i AS (SELECT path, split_part(path, '/', 1) AS repo, CAST(ceil(len(content) / 3.2::DOUBLE) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY doc_id % 5 DESC, doc_id, path) - 1 AS pos FROM doc_files),
    w AS (SELECT repo, path, tokens, pos, 0 AS chunk, tokens AS used FROM i WHERE pos = 0 UNION ALL
      SELECT i.repo, i.path, i.tokens, i.pos, CASE WHEN w.used + i.tokens > 2000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + i.tokens > 2000 THEN i.tokens ELSE w.used + i.tokens END FROM w JOIN i ON i.repo = w.repo AND i.pos = w.pos + 1)
    SELECT repo, path, tokens, CAST(chunk AS INT) AS chunk, CAST(pos AS INT) AS pos FROM w"""
)
def packed_fingerprints(spark, d):
    files = view(spark, d, "doc_files")
    items = files.select(X.dirname(F.col("path")).alias("repo"), "path", X.token_estimate(F.col("content")).alias("tokens"), (F.col("doc_id") % 5).alias("hotspots"), F.col("doc_id").alias("ord"))
    return graph.pack_next_fit(items, 2000, ["repo"], spark.sparkContext.defaultParallelism).select("repo", "path", "tokens", "chunk", F.col("pos").cast("int").alias("pos"))


@query()
def smart_groups(spark, d):
    """All files as one repository, with all edges; files of more than 240 characters are compressed first."""
    files = view(spark, d, "code_files")
    edges = graph.file_graph(graph.resolve_imports(detect.full_imports(files), files))
    one = F.lit("all").alias("repo")
    return graph.smart_group(files.select(one, "path", "ext", "content"), edges.select(one, "src", "dst"), 240)


@query(
    oracle_with("code_files").replace("WITH ", "WITH RECURSIVE ")
    + ", "
    + _prints_sql(None)
    + """, ci AS (SELECT path, split_part(path, '/', 1) AS repo, tokens, n_hotspots, text, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY n_hotspots DESC, path) - 1 AS pos FROM prints),
    cw AS (SELECT repo, path, tokens, n_hotspots, text, pos, 0 AS chunk, tokens AS used FROM ci WHERE pos = 0 UNION ALL
      SELECT i.repo, i.path, i.tokens, i.n_hotspots, i.text, i.pos, CASE WHEN w.used + i.tokens > 7500 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + i.tokens > 7500 THEN i.tokens ELSE w.used + i.tokens END FROM cw w JOIN ci i ON i.repo = w.repo AND i.pos = w.pos + 1)
    SELECT repo || '-' || chunk AS chunk, count(*) AS files, CAST(sum(n_hotspots) AS BIGINT) AS hotspots, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(len(text) + 1) AS INT) AS n_chars FROM cw GROUP BY repo, chunk"""
)
def chunk_prompts(spark, d):
    files = view(spark, d, "code_files")
    prints = compress.fingerprints(files)
    repo = prints.select(X.top_dir(F.col("path")).alias("repo"), "path", "tokens", F.col("n_hotspots").alias("hotspots"), F.col("path").alias("ord"))
    packed = graph.pack_next_fit(repo, 7500, ["repo"]).select("path", F.concat_ws("-", "repo", "chunk").alias("chunk"), "pos")
    return compress.chunk_prompts(prints, packed).select("chunk", "files", "hotspots", "tokens", F.length("text").alias("n_chars"))


@query(oracle_with("code_files") + ", " + _hotspot_sql() + ", o AS (SELECT DISTINCT path, n, label FROM h) SELECT path, count(*) AS n_hotspots FROM o GROUP BY path")
def hotspot_counts(spark, d):
    return compress.fingerprints(view(spark, d, "code_files")).where("n_hotspots > 0").select("path", F.col("n_hotspots").cast("long").alias("n_hotspots"))


@query("SELECT l_orderkey AS id, CASE WHEN l_linenumber < ceil(l_quantity / 2) THEN 0 ELSE 1 END AS half FROM lineitem")
def chunk_halves(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    return rows.select(F.col("l_orderkey").alias("id"), graph.halves(F.col("l_linenumber"), F.col("l_quantity")).alias("half"))


# ---- sets and semi-structured ----------------------------------------------------------------------------------------


@query(oracle_with("issues", "ai_found") + "SELECT file, line, type, 0 AS src_rank FROM issues UNION ALL SELECT file, line, type, 1 FROM ai_found")
def union_findings(spark, d):
    return findings.union_findings(view(spark, d, "issues"), view(spark, d, "ai_found")).select("file", "line", "type", "src_rank")


@query(oracle_with("doc_files", "cache") + "SELECT path FROM doc_files EXCEPT SELECT path FROM cache")
def files_not_cached(spark, d):
    return view(spark, d, "doc_files").join(view(spark, d, "cache"), "path", "left_anti").select("path").distinct()


_TYPE_LIST = ", ".join(f"'{t}'" for t in R.TYPES)
_SEV_LIST = ", ".join(f"'{t}'" for t in R.SEVERITIES)
_TEXT = lambda k: f"CASE WHEN json_type(v, '$.{k}') = 'VARCHAR' THEN json_extract_string(v, '$.{k}') END"


@query(
    oracle_with("answers")
    + rf""", p AS (SELECT seq, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(regexp_extract(raw, '(?s)\{{.*\}}')) THEN regexp_extract(raw, '(?s)\{{.*\}}') END AS j FROM answers),
    e AS (SELECT seq, unnest(range(0, len(a))) AS pos, unnest(a) AS v FROM (SELECT seq, CAST(json_extract(j, '$.issues[*]') AS JSON[]) AS a FROM p WHERE j IS NOT NULL))
    SELECT seq, CAST(pos AS INT) AS pos, CASE WHEN {_TEXT('type')} IN ({_TYPE_LIST}) THEN {_TEXT('type')} ELSE 'lint' END AS type, CASE WHEN {_TEXT('severity')} IN ({_SEV_LIST}) THEN {_TEXT('severity')} ELSE 'medium' END AS severity,
      coalesce(nullif({_TEXT('file')}, ''), 'unknown') AS file, CASE WHEN json_type(v, '$.line') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(v, '$.line') AS DOUBLE) END AS line,
      coalesce(nullif({_TEXT('description')}, ''), 'Unknown issue') AS description FROM e WHERE json_type(v) = 'OBJECT'"""
)
def parsed_answers(spark, d):
    return findings.parse_issues(view(spark, d, "answers")).select("seq", "pos", "type", "severity", "file", "line", "description")


@query(
    oracle_with("stream_lines")
    + """, v AS (SELECT run, seq, line FROM stream_lines WHERE json_valid(line) AND line <> ''), k AS (SELECT run, seq, json_extract_string(line, '$.type') AS t, json_extract_string(line, '$.result') AS r, json_extract_string(line, '$.message.content[0].text') AS s FROM v)
    SELECT run, coalesce(nullif(arg_max(r, seq) FILTER (t = 'result'), ''), arg_max(s, seq) FILTER (t = 'assistant' AND contains(s, '"results"')), '') AS output FROM k GROUP BY run"""
)
def agent_outputs(spark, d):
    return findings.agent_output(view(spark, d, "stream_lines"))


@query(oracle_with("stream_lines") + "SELECT run, row_number() OVER (PARTITION BY run ORDER BY seq) - 1 AS seq, replace(line, 'not json', 'nöt jsön €') AS line FROM stream_lines")
def agent_lines(spark, d):
    """Lines put together from chunks: each line, with its line end, is cut in two at any byte, and five such parts that
    follow one another are a chunk."""
    lines = view(spark, d, "stream_lines")
    place = F.row_number().over(Window.partitionBy("run").orderBy("seq")) - 1
    data = F.encode(F.concat(F.replace("line", F.lit("not json"), F.lit("nöt jsön €")), F.lit("\n")), "UTF-8")
    rows = lines.select("run", place.alias("n"), data.alias("data")).withColumn("at", (F.col("n") * 7 % F.octet_length("data")).cast("int"))
    parts = F.array(F.substring("data", F.lit(1), F.col("at")), F.substring("data", F.col("at") + 1, F.octet_length("data")))
    cut = rows.select("run", (F.col("n") * 2).alias("n"), F.posexplode(parts).alias("k", "part")).withColumn("n", F.col("n") + F.col("k"))
    five = F.sort_array(F.collect_list(F.struct("n", F.hex("part").alias("part"))))
    chunks = cut.groupBy("run", F.floor(F.col("n") / 5).alias("seq")).agg(F.unhex(F.array_join(F.transform(five, lambda p: p["part"]), "")).alias("chunk"))
    return findings.lines_of(chunks)


_CUSTOM = (R.Rule("own_print", r"print\([^)]*\)", "duplicates", "low", "A print", (".py",)), R.Rule("own_struct", r"struct\s+\{|interface\s+\w+", "dead-code", "high", "A struct"))


@query(
    oracle_with("code_files")
    + ", "
    + _rules_cte(_CUSTOM)
    + " SELECT file, CAST(line AS INT) AS line, type, severity, description FROM found"
)
def plugin_rules(spark, d):
    """Rules as a plug-in brings them, those that may run."""
    nested = R.Rule("slow", r"(a+)+", "lint", "low", "never runs")
    return detect.scan_rules(view(spark, d, "code_files"), policy.usable_rules([*_CUSTOM, nested])).select("file", "line", "type", "severity", "description")


@query(oracle_with("issues") + f"SELECT seq, file, type FROM issues WHERE type NOT IN ('types', 'lint') AND {_UP} >= 1 AND NOT regexp_matches(file, '^d[34]/.*$') AND NOT regexp_matches(file, '^root[^/]*\\.py$')")
def repository_policy(spark, d):
    """What a repository ignores and turns off, over the filters of its plug-ins."""
    base = policy.Filters(("root*.py",), ("lint",), "medium")
    return policy.apply_filters(view(spark, d, "issues"), policy.with_config(base, ["d3/**", "d4/**"], {"types": "off", "bugs": "high"})).select("seq", "file", "type")


@query(
    oracle_with("code_files")
    + """, r AS (SELECT split_part(path, '/', 1) AS directory, ext, path, id FROM code_files), k AS (SELECT directory, ext, count(*) AS n, min(path) AS first FROM r GROUP BY ALL),
    l AS (SELECT directory, 'Files of ' || directory || chr(10) || 'Structure:' || chr(10) || '  ' || directory || '/ ' || string_agg(n || ext, ' ' ORDER BY first) || chr(10) AS head FROM k GROUP BY directory),
    t AS (SELECT directory, head || 'Related files in other chunks:' || chr(10) || array_to_string(rel[1:6], chr(10)) || chr(10) || CASE WHEN len(rel) > 6 THEN '  ... +' || (len(rel) - 6) || ' more' || chr(10) ELSE '' END AS text
      FROM l JOIN (SELECT directory, list('other file of some length: ' || path ORDER BY path) AS rel FROM r GROUP BY directory) USING (directory))
    SELECT directory, CASE WHEN len(text) <= 260 THEN text ELSE text[1:240] || chr(10) || '  ... (trimmed)' || chr(10) END AS text FROM t"""
)
def cut_manifests(spark, d):
    """Manifests of directories with related files, cut to 260 characters."""
    files = view(spark, d, "code_files")
    top = X.top_dir(F.col("path")).alias("directory")
    place = F.row_number().over(Window.partitionBy("directory").orderBy("path"))
    first = files.select(top, "path").withColumn("n", place).where(F.col("n") <= graph.RELATED)  # cut before the rows move
    named = first.groupBy("directory").agg(F.transform(F.sort_array(F.collect_list("path")), lambda p: F.concat(F.lit("other file of some length: "), p)).alias("related"))
    counted = files.groupBy(top).agg(F.count(F.lit(1)).alias("n"))
    met = graph.directory_manifest(files).join(named, "directory").join(counted, "directory")
    text = graph.manifest_text(F.concat(F.lit("Files of "), "directory"), F.array("line"), F.col("related"), 260, F.col("n"))
    return met.select("directory", text.alias("text"))


@query(
    oracle_with("code_files")
    + """, p AS (SELECT id % 50 AS chunk, id AS pos, path, row_number() OVER (PARTITION BY id % 50 ORDER BY id) - 1 AS n, count(*) OVER (PARTITION BY id % 50) AS c FROM code_files),
    a AS (SELECT *, CASE WHEN chunk % 3 = 0 THEN CASE WHEN n < ceil(c / 2) THEN '0' ELSE '1' END ELSE '' END AS part FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY chunk, part ORDER BY pos) - 1 AS m, count(*) OVER (PARTITION BY chunk, part) AS e FROM a),
    f AS (SELECT chunk, path, CASE WHEN part = '1' AND chunk % 6 = 0 THEN part || CASE WHEN m < ceil(e / 2) THEN '0' ELSE '1' END ELSE part END AS part FROM b)
    SELECT chunk, path, part, CASE WHEN part <> '' THEN CAST(4500 // count(*) OVER (PARTITION BY chunk, part) AS BIGINT) END AS file_budget FROM f"""
)
def split_chunks(spark, d):
    """Chunks that were refused once, and some second halves that were refused again."""
    placed = view(spark, d, "code_files").select((F.col("id") % 50).alias("chunk"), F.col("id").alias("pos"), "path")
    chunks = placed.select("chunk").distinct()
    refused = chunks.where("chunk % 3 = 0").select("chunk", F.lit("").alias("part")).unionByName(chunks.where("chunk % 6 = 0").select("chunk", F.lit("1").alias("part")))
    return graph.split_chunks(placed, refused, 10_000).select("chunk", "path", "part", "file_budget")


@query(
    oracle_with("results")
    + """SELECT cluster_id, CAST(0 AS INT) AS ord, file, CASE WHEN line > 0 THEN line END AS line, status, reason FROM results"""
)
def reported_results(spark, d):
    """Results as agents wrap them: a document in the text of a wrapper's `result`, amid prose."""
    rows = view(spark, d, "results")
    line = F.when(F.col("line") > 0, F.col("line"))
    inner = F.to_json(F.struct(F.array(F.struct("file", line.alias("line"), "status", "reason")).alias("results")))
    raw = F.to_json(F.struct(F.lit("success").alias("type"), F.concat(F.lit("Done. "), inner, F.lit(" That is all.")).alias("result")))
    return findings.parse_results(rows.select("cluster_id", raw.alias("raw")))


@query(
    oracle_with("issues")
    + "SELECT seq, type, severity, file, CAST(line AS DOUBLE) AS line, description FROM (SELECT seq, type, CASE WHEN severity = 'odd' THEN 'medium' ELSE severity END AS severity, file, line, description FROM issues)"
)
def loop_answers(spark, d):
    """Answers of the fixing loop: a wrapper whose `result` holds the issues in prose."""
    rows = view(spark, d, "issues")
    inner = F.to_json(F.struct(F.array(F.struct("type", "severity", "file", "line", "description")).alias("issues")))
    raw = F.to_json(F.struct(F.concat(F.lit("I found this: "), inner).alias("result")))
    return findings.parse_issues(rows.select("seq", raw.alias("raw")), "loop").select("seq", "type", "severity", "file", "line", "description")


# ---- streaming -------------------------------------------------------------------------------------------------------


@query(ORACLES["hotspots_in_documents"])
def streaming_incremental_scan(spark, d):
    """A stream of documents, scanned twice: the second pass finds nothing new."""
    table = f"{d}/documents.parquet"
    raw = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/documents.parque[t]")  # a pattern, so that it may be one file
    number = F.col("doc_id").cast("string")
    ext = F.element_at(F.array(*map(F.lit, (".md", ".py", ".ts", ".txt", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = raw.select(F.concat(F.col("source"), F.lit("/doc_"), number, ext).alias("path"), ext.alias("ext"), F.coalesce("text", F.lit("")).alias("content"))
    root = scratch.folder(spark, "stream")
    for _ in range(2):
        streaming.incremental_scan(files, detect.hotspots, root).awaitTermination()
    return streaming.current(spark, root, "path string, line int, label string, snippet string, ord int")


@query(
    _LOCAL
    + ", "
    + _ALLS
    + ", told AS (SELECT file, line, type FROM alls)"
    + _NODUP
    + _corrected("nodup")
    + f""", kept AS (SELECT * FROM corrected WHERE NOT ({_GRAVE}) OR {_evidence_sql()}),
    joint AS (SELECT file, line, type, severity, description, 'local' AS source, 0 AS src, rule_ord * 4294967296 + match_ord AS ord FROM alls UNION ALL SELECT file, line, type, severity, description, 'ai', 1, seq FROM kept),
    passed AS (SELECT * FROM joint WHERE type <> 'duplicates' AND NOT regexp_matches(file, '^d6/') AND NOT regexp_matches(file || ':' || description, '(?i)hack in a'))
    SELECT type, severity, source, count(*) AS n FROM (SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY file, line, type ORDER BY src, ord, severity, description) = 1) GROUP BY ALL"""
)
def scan_end_to_end(spark, d):
    """Local and reported findings, verified, filtered, once each: the issues of a scan by type and severity."""
    files = view(spark, d, "code_files")
    reported = view(spark, d, "ai_found").withColumns({"status": F.lit("found"), "source": F.lit("ai")})
    settings = scans.Settings(filters=policy.Filters(("d6/**",), ("duplicates",)), min_severity="low", allow=["hack in a"])
    return score.count_by(scans.scan(files, settings, reported).issues, "type", "severity", "source")


# The oracle's positions are 64-bit numbers where Spark's are 32-bit.
for _name, _columns in {
    "rule_findings": ("line", "match_ord"), "hotspots": ("line",), "hotspots_in_documents": ("line",), "streaming_incremental_scan": ("line",), "signatures": ("line",), "imports_light": ("pos",), "imports_full": ("pos",),
    "unused_imports": ("line",), "comments_stripped": ("n_chars",), "resolved_imports": ("pos",),
}.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in _columns)}) FROM ({ORACLES[_name]})"
