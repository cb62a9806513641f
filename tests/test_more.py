"""Policy on null fields, patterns of the engine's dialect, state and settings on disk, orders, splits, streams."""

import bisect
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from test_operators import files, issues

from gneiss.functions import text as X
from gneiss.operators import compress, detect, graph, ordering, outcomes, policy, score, verify
from gneiss.plans import catalog, fixtures, prompts, scan
from gneiss.sources import config, findings
from gneiss.sources import files as sources
from gneiss.streaming import incremental


def test_null_fields_are_excluded_by_nothing(spark):
    rows = issues(spark, {"type": None}, {"file": None}, {"description": None}, {"type": "lint"}, {"file": "d1/a.ts"})
    kept = policy.apply_filters(rows, policy.Filters(("d1/**",), ("lint",)))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 1, 2]
    assert sorted(r["seq"] for r in policy.apply_allow_rules(rows, ["d1/"]).collect()) == [0, 1, 2, 3]
    table = spark.createDataFrame([("d1/",), (None,), ("(open",), ("Test.issue$",)], "pattern string")
    assert sorted(r["seq"] for r in policy.apply_allow_table(rows, table).collect()) == [2]


def test_java_says_which_patterns_are_valid(spark):
    assert policy.valid_regex("(?<n>x)") and not policy.valid_regex("(?P<n>x)") and not policy.valid_regex("(x")
    rows = issues(spark, {"description": "has x"}, {"description": "has y"})
    assert [r["seq"] for r in policy.apply_allow_rules(rows, ["(?P<n>y)", "s (?<n>x)$"]).collect()] == [1]


def test_literals_that_a_pattern_needs():
    some = {"block [12]": "block ", "a+bcd": "bcd", "abc?d": None, "abcd?": "abc", "abc{0,2}def": "def", "(abc)def": "def", "abc|def": None, "(abc|def)ghij": "ghij", "(?i)abc": None, "x\\.yz": "x.yz", "\\bword\\b": "word", "a\\x41bc": None,
            "ab\\Qc\\E": None, "[abc]": None, "[]abc]def": "def", "[^]x]abc": "abc", "[a[bc]]def": None, "M3": None, "ÄBC": None, "ROOTS*": "root", "(?:abc)+defg*": "def", "a.bcd": "bcd", "": None, "abc++d": "abc", "(?=abc)xyz": "xyz", "abcd{2}": "abc"}
    assert {p: policy.needed_literal(p) for p in some} == some


def test_allow_tables_by_index_equal_all_patterns_on_all_texts(spark):
    r = random.Random(8)
    parts = ["abc", "x.z", "[ab]c", "d+", "(?:ef|gh)", "\\.", "q?", "k{1,2}", "TODO", " ", "é", "^", "abcabc", "mno"]
    patterns = sorted({"".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(150)})
    texts = ["".join(r.choice(["abc", "xyz", "ac", "ddd", "ef", "gh", ".", "q", "kk", "todo", " ", "é", "É", "mno", "İ"]) for _ in range(r.randrange(1, 9))) for _ in range(200)]
    rows = issues(spark, *({"description": t} for t in texts * 2))
    for some in (patterns, patterns[:3], []):
        table = spark.createDataFrame([(p,) for p in some], "pattern string")
        assert sorted(x["seq"] for x in policy.apply_allow_table(rows, table).collect()) == sorted(x["seq"] for x in policy.apply_allow_rules(rows, some).collect())
    plan = policy.apply_allow_table(rows, spark.createDataFrame([(f"description {i} of",) for i in range(50)], "pattern string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_local_findings_near_a_line_equal_all_pairs(spark):
    r = random.Random(9)
    line = lambda: r.choice([None, 0, -2, *range(1, 40)])
    found = issues(spark, *({"file": r.choice("ab"), "type": r.choice(["lint", "bugs"]), "line": line()} for _ in range(120)))
    local = issues(spark, *({"file": r.choice("ab"), "type": "lint", "line": line()} for _ in range(5)))
    def near(a, b):
        return a["file"] == b["file"] and a["type"] == b["type"] and (a["line"] == b["line"] or (a["line"] is not None and b["line"] is not None and a["line"] != 0 and abs(a["line"] - b["line"]) <= 3))
    told = local.collect()
    want = sorted(a["seq"] for a in found.collect() if not any(near(a, b) for b in told))
    kept = verify.drop_local_duplicates(found, local)
    assert sorted(x["seq"] for x in kept.collect()) == want and 0 < len(want) < 120
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()


def test_a_directory_with_nearly_all_issues_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 40)
    r = random.Random(10)
    rows = issues(spark, *({"file": r.choice(["src/a", "src/b", "src/c", "src/d", "x/y", None]), "severity": r.choice(["low", "high", "critical"])} for _ in range(600)))
    got = score.batches(rows, ["seq"], 8, ["file"])
    count = {}
    want = {}
    for x in sorted(rows.collect(), key=lambda x: x["seq"]):
        n = count[x["file"]] = count.get(x["file"], -1) + 1
        want[x["seq"]] = (n // 8, n % 8)
    assert {x["seq"]: (x["batch"], x["index"]) for x in got.collect()} == want
    assert len({x["cluster_rank"] for x in score.clusters(rows).collect()}) == score.clusters(rows).count()


def test_long_allow_tables_take_several_joins(spark, monkeypatch):
    monkeypatch.setattr(policy, "ALLOW_PART", 3)
    rows = issues(spark, *({"description": f"number {i}"} for i in range(30)))
    table = spark.createDataFrame([(f"number (?:{i})$",) if i % 2 else (f" {i}$|zzz{i}",) for i in range(5, 25)], "pattern string")
    assert sorted(r["seq"] for r in policy.apply_allow_table(rows, table).collect()) == [*range(5), *range(25, 30)]


def lines_of_matches(text, pattern):
    import re

    out = []
    for m in re.finditer(pattern, text):
        start = text.rfind("\n", 0, m.start()) + 1
        out.append((text.count("\n", 0, m.start()) + 1, m.start() - start, m[0]))
    return out


def test_places_of_matches(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["ab", "a", "b", " ", "\n", "/", "x", "\t"]) for _ in range(r.randint(0, 40))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", F.expr(X.regex_lines("t", r"a\s*b")).alias("m")).collect()
    assert all([tuple(x) for x in row["m"]] == lines_of_matches(row["t"], r"a\s*b") for row in got)


def test_places_of_matches_follow_the_matches_in_time(spark):
    def took(n):
        best = 1e9
        for _ in range(3):
            frame = spark.range(1, numPartitions=1).select(F.lit("a.ts").alias("path"), F.lit(".ts").alias("ext"), F.repeat(F.lit("  x = y as any\n"), n).alias("content"))
            began = time.perf_counter()
            last = detect.scan_rules(frame).agg(F.count(F.lit(1)), F.max("line"), F.max("match_ord")).first()
            best = min(best, time.perf_counter() - began)
            assert tuple(last) == (n, n, n - 1)
        return best

    took(100)
    assert took(32_000) < 4.5 * took(8_000)


def test_comment_lines_by_the_whole_beginning_of_the_line(spark):
    text = "  // TODO a\nx # TODO b\n \t# TODO c\n* TODO d\n/* TODO e */\n / TODO f\nTODO g TODO h\nTODO:\n# TODO i\nx TODO: \n\n// y\n"
    rows = detect.scan_rules(spark.createDataFrame([("a.py", ".py", text), ("b.py", ".py", ""), ("c.py", ".py", None)], "path string, ext string, content string")).collect()
    assert sorted((r["file"], r["line"], r["description"], r["match_ord"]) for r in rows) == [
        ("a.py", 2, "TODO b", 1), ("a.py", 5, "TODO e */", 4), ("a.py", 6, "TODO f", 5), ("a.py", 7, "TODO g TODO h", 6), ("a.py", 8, "TODO:\n# TODO i", 7), ("a.py", 10, "TODO: \n\n// y", 8),
    ]


def test_unused_imports_count_words(spark):
    text = "import { A, B as C, D, $e, F } from './m'\nimport G from 'g'\nimport React from 'react'\nimport { A2 } from 'x'\nC(D, $e, G$, A2x); $e\n"
    rows = detect.unused_imports(spark.createDataFrame([("a.ts", ".ts", text), ("b.ts", ".ts", None), ("c.py", ".py", text)], "path string, ext string, content string")).collect()
    assert sorted((r["file"], r["line"], r["description"].split("'")[1], r["match_ord"]) for r in rows) == [("a.ts", 1, "$e", 0), ("a.ts", 4, "A2", 1)]
    text = "import {Aa, Bb as Cc, Dd,\n $ee, type Ff } from './m'\n\nimport Gg from 'g'\nCc(Dd) $ee type Ff\n"
    rows = detect.unused_imports(spark.createDataFrame([("a.ts", ".ts", text)], "path string, ext string, content string")).collect()
    assert [(r["line"], r["description"].split("'")[1], r["match_ord"]) for r in sorted(rows, key=lambda r: r["match_ord"])] == [(1, "Aa", 0), (1, "$ee", 1), (4, "Gg", 2)]


def test_every_rule_has_a_row_in_the_fixture(spark):
    if not catalog.QUERIES or not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    code = fixtures.view(spark, "/root/testdata/sf0.01", "code_files").cache()
    from gneiss.functions import rules as R

    assert {r[0] for r in detect.scan_rules(code).select("rule_ord").distinct().collect()} == set(range(len(R.RULES)))
    assert {r[0] for r in detect.hotspots(code).select("label").distinct().collect()} == {h.label for h in R.HOTSPOTS}
    hits = set()
    for i, row in enumerate(R.SIGNATURES):
        test = F.col("ext").isin(*row[1]) & F.regexp_replace("line", r"^\s+", "").rlike(row[2].replace("|$)", r"|\z)"))
        lines = code.select("ext", F.explode(X.lines(F.col("content"))).alias("line"))
        hits |= {i} if lines.where(test).limit(1).count() else set()
    assert hits == set(range(len(R.SIGNATURES)))
    borne = catalog.evidence_checks(spark, "/root/testdata/sf0.01")
    told = fixtures.view(spark, "/root/testdata/sf0.01", "ai_found").select("seq", "description", "evidence").where("evidence is null")
    found = {r["description"] for r in borne.where("borne").join(told, "seq").select("description").distinct().collect()}
    assert {"Hardcoded password", "SQL injection risk", "Command injection"} <= found
    code.unpersist()


def test_views_leave_the_sessions_names_alone(spark):
    spark.range(3).createOrReplaceTempView("part")
    fixtures.view(spark, "/root/testdata/sf0.001", "code_files").limit(1).collect()
    assert spark.table("part").count() == 3
    spark.catalog.dropTempView("part")


@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers(spark, monkeypatch, descending):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    r = random.Random(3)
    rows = [(r.randint(0, 60) if i % 17 else None, i) for i in range(400)]
    got = ordering.row_numbers(spark.createDataFrame(rows, "k int, i int"), "k", ["i"], "n", descending).collect()
    order = sorted(rows, key=lambda x: ((x[0] is not None) != descending, (-x[0] if descending else x[0]) if x[0] is not None else 0, x[1]))
    assert [(x["k"], x["i"]) for x in sorted(got, key=lambda x: x["n"])] == order and sorted(x["n"] for x in got) == list(range(1, 401))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_of_row_numbers_grows_with_the_ranges_alone(spark, monkeypatch):
    # 36 ranges by six steps: a step that writes out the one before four times makes a plan of some MB.
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    rows = spark.range(360).select(F.col("id").alias("run"))
    got = score.newest_first(rows)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 100_000
    assert {r["run"]: r["place"] for r in got.collect()} == {i: 360 - i for i in range(360)}


def test_place_by_bisection(spark):
    for n in (0, 1, 2, 3, 7, 8, 900):
        bounds = [float(3 * i) for i in range(n)]
        values = [None, -1.0, 0.0, 1.0, 2.9, 3.0, 3.0 * n, 3.0 * n - 3, 3.0 * n - 4, 1e18]
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        got = rows.select("v", ordering._place(F.col("v"), bounds).alias("p")).collect()
        assert [r["p"] for r in got] == [0 if v is None else bisect.bisect_right(bounds, v) for v in values]


def test_plan_of_clusters_grows_with_the_ranges_alone(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    sizes = []
    settled = score.scratch.settled

    def watched(df, kind):
        sizes.append(len(df._jdf.queryExecution().analyzed().toString()))
        return settled(df, kind)

    monkeypatch.setattr(score.scratch, "settled", watched)
    rows = spark.range(360).selectExpr("id AS seq", "concat('d', id % 3, '/m', id) AS file", "if(id % 2 = 0, 'high', 'low') AS severity")
    got = score.clusters(rows).collect()
    assert sizes and max(sizes) < 200_000
    assert sum(r["n"] for r in got) == 360 and sorted(r["cluster_rank"] for r in got) == list(range(1, len(got) + 1))


def test_plan_of_ranked_clusters_grows_with_the_ranges_alone(spark, monkeypatch):
    # One issue a cluster and 120 directories: the numbering of clusters, which the test above leaves unmeasured, has 36 ranges as well.
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    rows = spark.range(360).selectExpr("id AS seq", "concat('d', id % 120, '/m', id) AS file", "if(id % 2 = 0, 'high', 'low') AS severity")
    got = score.clusters(rows, 1)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 100_000
    worst = {i: score.R.RANK_DOWN["low" if i % 2 else "high"] for i in range(360)}
    each = [(worst[i], d, batch) for d in range(120) for batch, i in enumerate(sorted(range(d, 360, 120), key=lambda i: (worst[i], i)))]
    assert {r["cluster_rank"]: (r["worst"], r["directory"], r["batch"], r["n"]) for r in got.collect()} == {n: (w, f"d{d}", b, 1) for n, (w, d, b) in enumerate(sorted(each), 1)}


def test_counts_before_ranges_of_groups_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 10)
    rows = spark.range(360).selectExpr("id AS seq", "concat('f', id % 70) AS file")
    got = score.batches(rows, ["seq"], 2, ["file"])
    assert "Broadcast" not in _plan(got)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 100_000
    assert {r["seq"]: (r["batch"], r["index"]) for r in got.collect()} == {i: (i // 70 // 2, i // 70 % 2) for i in range(360)}


def test_verdicts_are_not_broadcast(spark):
    found = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "batch int, index int, t string")
    verdicts = spark.createDataFrame([(0, 0, True), (0, 1, False), (1, 9, True)], "batch int, index int, is_real boolean")
    got = verify.keep_real(found, verdicts)
    assert "Broadcast" not in _plan(got) and [r["t"] for r in got.collect()] == ["a"]


def test_results_are_reduced_before_they_meet_issues(spark):
    r = random.Random(5)
    lines = [None, 0, 1, 2, 3]
    work = [(r.randint(0, 2), i, f"f{r.randint(0, 3)}", r.choice(lines)) for i in range(300)]
    said = [(r.randint(0, 2), i, f"f{r.randint(0, 3)}", r.choice([1, 2, 3] * 5 + lines), r.choice(["fixed", "skipped", "odd"]), r.choice(["", "why"])) for i in range(40)]
    got = outcomes.match_results(spark.createDataFrame(work, "cluster_id int, seq int, file string, line int"), spark.createDataFrame(said, "cluster_id int, ord int, file string, line int, status string, reason string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("min_by")  # what stands lower comes first
    want = {}
    for cluster, seq, file, line in work:
        first = min((x for x in said if x[0] == cluster and x[2] == file and (x[3] in (None, 0) or x[3] == line)), key=lambda x: x[1], default=None)
        fixed = first is not None and first[4] == "fixed"
        skipped = (first[5] or "Agent could not fix") if first is not None and first[4] == "skipped" else "No result reported by agent"
        want[seq] = ("fixed", None) if fixed else ("skipped", skipped)
    assert {x["seq"]: (x["status"], x["skip_reason"]) for x in got.collect()} == want and got.count() == 300


def test_local_findings_are_not_broadcast(spark):
    found = spark.createDataFrame([("a", 5, "lint"), ("a", 9, "lint"), ("b", 5, "lint")], "file string, line int, type string")
    local = spark.createDataFrame([("a", 3, "lint")], "file string, line int, type string")
    got = verify.drop_local_duplicates(found, local)
    assert "Broadcast" not in _plan(got) and sorted((r["file"], r["line"]) for r in got.collect()) == [("a", 9), ("b", 5)]


def test_contents_are_not_broadcast(spark):
    found = spark.createDataFrame([(1, "a", 1, "lint", "low", "d", None, None), (2, "gone", 1, "lint", "low", "d", None, None)], "seq int, file string, line int, type string, severity string, description string, evidence string, line_content string")
    local = spark.createDataFrame([("b", 3, "lint")], "file string, line int, type string")
    files = spark.createDataFrame([("a", "x\ny")], "path string, content string")
    got = verify.verify(found, local, files)
    assert "Broadcast" not in _plan(got) and [r["seq"] for r in got.collect()] == [1]
    corrected = verify.correct_lines(verify.in_known_files(found, files), files)
    assert "Broadcast" not in _plan(verify.require_evidence(corrected, files))


def test_batches_over_all_rows(spark):
    got = score.batches(issues(spark, *[{}] * 20), ["seq"], 8).collect()
    assert {r["seq"]: (r["batch"], r["index"]) for r in got} == {i: (i // 8, i % 8) for i in range(20)}


def test_next_fit_without_groups(spark):
    items = spark.createDataFrame([(f"p{i}", n, h, i) for i, (n, h) in enumerate([(50, 0), (60, 1), (45, 0), (200, 0), (1, 0)])], "path string, tokens int, hotspots int, ord int")
    got = graph.pack_next_fit(items, 100).orderBy("pos").collect()
    assert [(r["path"], r["chunk"]) for r in got] == [("p1", 0), ("p0", 1), ("p2", 1), ("p3", 2), ("p4", 3)]
    assert graph.pack_next_fit(items.where("false"), 100).count() == 0


def test_refused_chunks_are_halved_twice_at_most(spark):
    placed = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)] + [(2, 0, "q")], "chunk int, pos int, path string")
    refused = spark.createDataFrame([(1, ""), (1, "0"), (1, "00")], "chunk int, part string")
    got = {r["path"]: (r["part"], r["file_budget"]) for r in graph.split_chunks(placed, refused, 1000).collect()}
    assert got == {"p0": ("00", 225), "p1": ("00", 225), "p2": ("01", 450), "p3": ("1", 225), "p4": ("1", 225), "q": ("", None)}


def test_skeletons(spark):
    body = "\n".join(f"    x{i} = {i}" for i in range(6))
    assert compress.skeleton(f"import a\n\ndef f():\n{body}\ny = 1\n", ".py") == "import a\n\ndef f():\n    x0 = 0\n    x1 = 1\n    x2 = 2\n  // ... 3 lines collapsed\ny = 1\n"
    assert compress.skeleton("def f():\n  a\ndef g():\n  b\n  c\n  d\n  e", ".py") == "def f():\n  a\ndef g():\n  b\n  c\n  d\n  e"
    assert compress.skeleton("const f = (\n  a\n  b\n  c\n  d", ".ts") == "const f = (\n  a\n  b\n  c\n  // ... 1 lines collapsed"


def test_tree_with_hidden_names(spark, tmp_path):
    for p in ("a.py", "pkg/__init__.py", "pkg/_x/y.ts", "sub/.github/w.yml", ".github/z.yml", ".git/h.py", "node_modules/_m.js", "_top.go", "sub/.hidden/q.py", "we[i]rd/_k.py", "__pycache__/c.py"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(p)
    got = {r["path"]: r["content"] for r in sources.read_tree(spark, str(tmp_path)).collect()}
    assert got == {p: p for p in ("a.py", "pkg/__init__.py", "pkg/_x/y.ts", "sub/.github/w.yml", ".github/z.yml", "_top.go", "we[i]rd/_k.py")}


def test_settings_of_a_repository(tmp_path):
    (tmp_path / ".tool" / "profiles").mkdir(parents=True)
    assert config.repository_settings(str(tmp_path), "tool") == {}
    (tmp_path / ".tool" / "config.yaml").write_text("mode: fix\nfail-below: 3\n")
    (tmp_path / ".tool" / "profiles" / "night.yaml").write_text("fail-below: 70\nagent: codex\n")
    assert config.repository_settings(str(tmp_path), "tool") == {"mode": "fix", "fail-below": 3}
    assert config.repository_settings(str(tmp_path), "tool", "night") == {"mode": "fix", "fail-below": 70, "agent": "codex"}
    (tmp_path / ".tool.yml").write_text("mode: scan\n")
    assert config.repository_settings(str(tmp_path), "tool", "none") == {"mode": "scan"}


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("a: 1\nb: 'x y'\n# no\nc:\n  - one\n  - k: v\n    l: w\n", {"a": "1", "b": "x y", "c": ["one", {"k": "v", "l": "w"}]}),
        ("f:\n  g: h\n  i: \"j\"\n", {"f": {"g": "h", "i": "j"}}), ("t: |\n  one\n    two\n\n  three\nz: []\n", {"t": "one\n  two\n\nthree", "z": []}), ("x: [a, b] # c\njunk\n- top\n", {"x": "[a, b] # c"}), ("", {}),
    ],
)
def test_yaml(text, value):
    assert config.parse_yaml(text) == value


def test_loop_state(spark, tmp_path):
    path = str(tmp_path / "state" / "loop.json")
    assert scan.load_loop(spark, path, 1) is None
    scan.save_loop(spark, path, [scan.Pass(1, 5, 3, 2, 40)], {"total_fixed": 3})
    assert scan.load_loop(spark, path, 0) is None
    assert scan.load_loop(spark, path, 2) == {"passes": [scan.Pass(1, 5, 3, 2, 40)], "total_fixed": 3, "chain": 2}
    sources.write_text(spark, path, "{broken")
    assert scan.load_loop(spark, path, 1) is None
    sources.write_text(spark, path, json.dumps({"passes": [{"odd": 1}]}))
    assert scan.load_loop(spark, path, 1) is None
    assert scan.issue_facts({"file": "a.py", "line": None, "type": "bugs"}) == {"issue_file": "a.py", "issue_line": "", "issue_type": "bugs", "issue_severity": "", "issue_description": "", "issue_status": ""}


def test_history_with_a_broken_line(spark, tmp_path):
    path = str(tmp_path / "history")
    schema = "run int, score int"
    assert sources.read_history(spark, path, schema).count() == 0
    sources.append_history(spark.createDataFrame([(1, 50)], schema), path)
    (tmp_path / "history" / "part-x.json").write_text("{not json\n")
    sources.append_history(spark.createDataFrame([(2, 60)], schema), path)
    assert sorted(tuple(r) for r in sources.read_history(spark, path, schema).collect()) == [(1, 50), (2, 60)]


def test_requests_are_recorded(spark):
    usage = spark.createDataFrame([("m", "2024-01-02", 3), ("m", "2024-01-01", 9), ("n", "2024-01-02", 1)], "model string, date string, requests_used int").withColumn("date", F.to_date("date"))
    kept = outcomes.record_requests(usage, F.to_date(F.lit("2024-01-02")), "m", 2)
    assert sorted((r["model"], r["requests_used"]) for r in kept.collect()) == [("m", 5), ("n", 1)]


def test_requests_as_text():
    issue = {"severity": "high", "type": "bugs", "file": "a.py", "line": 3.0, "description": "d"}
    assert "side by side" not in prompts.fix_request([issue]) and "2 files" in prompts.fix_request([issue, {**issue, "file": "b.py", "line": None}], test="make test")
    assert "bugs, high, at a.py:3: d" in prompts.single_request(issue) and "`make`" in prompts.single_request(issue, test="make")
    assert "- x fixed" in prompts.pass_request(2, ["x fixed"]) and "Plan:\np" in prompts.pass_request(1, [], "p")
    assert prompts.context_section({}) == ""
    told = prompts.context_section({"app": {"type": "web", "exposure": "public", "auth": True}, "framework": "f", "trusted": ["t"], "allow": [{"pattern": "p", "reason": "r"}]}, "mine")
    assert all(x in told for x in ("- type: web", "- auth: yes", prompts.EXPOSURE["public"], "- framework: f", "- t", "- p (r)", "mine"))
    assert prompts.EXPOSURE["local"] in prompts.context_section({"app": {"network": "localhost", "exposure": "public"}})


def test_stream_keeps_the_last_content_and_forgets_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    schema, seen = "path string, ext string, content string, at int", []
    source, root = tmp_path / "in", str(tmp_path / "state")

    def find(batch):
        seen.append(sorted((r["path"], r["content"]) for r in batch.collect()))
        return batch.select("path", F.length("content").alias("n"))

    def turn(number, *rows):
        spark.createDataFrame([(p, ".py", c, at) for p, c, at in rows], schema).coalesce(1).write.parquet(f"{source}/{number}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/*")
        incremental.incremental_scan(stream, find, root, "at").awaitTermination()
        return {r["path"]: r["n"] for r in incremental.current(spark, root, "path string, n int").collect()}

    assert turn(1, ("a", "old one", 1), ("a", "new", 2), ("b", "bb", 1)) == {"a": 3, "b": 2}
    assert turn(2, ("a", "new", 3), ("b", None, 3), ("c", "c", 1)) == {"a": 3, "c": 1}
    assert turn(3, ("b", "bb", 4), ("c", "c", 5)) == {"a": 3, "b": 2, "c": 1}
    assert turn(4, ("a", "newer", 9)) == {"a": 5, "b": 2, "c": 1}
    assert turn(5, ("a", "late", 8), ("d", "d", None)) == {"a": 5, "b": 2, "c": 1, "d": 1}
    assert turn(6, ("b", None, 10)) == {"a": 5, "c": 1, "d": 1} and turn(7, ("b", "x", 6)) == {"a": 5, "c": 1, "d": 1}
    assert turn(8, ("b", "x", 11)) == {"a": 5, "b": 1, "c": 1, "d": 1}
    assert sorted(p.name for p in (tmp_path / "state" / "found").iterdir() if p.name[0] not in "._") == [f"batch={n}" for n in (6, 7)]
    assert [("a", "new"), ("b", "bb")] in seen and [("c", "c")] in seen and [("b", "bb")] in seen and seen.count([("a", "newer")]) >= 1


def test_stream_reads_no_more_in_later_batches(spark, tmp_path):
    schema, source, root = "path string, ext string, content string", tmp_path / "in", str(tmp_path / "state")
    reads = []
    for n in range(6):
        spark.createDataFrame([(f"f{n}", ".py", "x = 1"), ("same", ".py", "y")], schema).coalesce(1).write.parquet(f"{source}/{n}")
        asked = incremental.incremental_scan(spark.readStream.schema(schema).parquet(f"{source}/*"), lambda b: b.select("path"), root)
        asked.awaitTermination()
        last = [p for p in asked.recentProgress if p["numInputRows"]][-1]
        store = last["stateOperators"][0]["customMetrics"]
        reads.append((last["numInputRows"], store["rocksdbGetCount"], last["stateOperators"][0]["numRowsTotal"]))
    assert len({r[:2] for r in reads[1:]}) == 1 and reads[-1][2] == 7
    assert incremental.current(spark, root, "path string").count() == 7
    assert "rocksdb" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "").lower()


def test_lines_of_chunks(spark, tmp_path):
    r = random.Random(3)
    texts = {n: "".join(r.choice(["a", "é", "€", "\n", "𝒳", "bc"]) for _ in range(r.randint(0, 40))) for n in range(30)}
    rows = []
    for n, t in texts.items():
        data, cuts = t.encode(), sorted(r.randrange(len(t.encode()) + 1) for _ in range(r.randint(0, 6)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        rows += [(n, i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts)]
    schema = "run int, seq int, chunk binary, last boolean"
    want = sorted((n, i, line) for n, t in texts.items() for i, line in enumerate(t.split("\n") if t and t[-1] != "\n" else t.split("\n")[:-1]))
    frame = spark.createDataFrame(rows, schema)
    assert sorted(tuple(x) for x in findings.lines_of(frame).collect()) == want
    for part in range(3):  # chunks arrive in three batches
        frame.where(F.col("seq").between(part * 2, part * 2 + 1) | ((F.lit(part) == 2) & (F.col("seq") > 5))).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
        incremental.agent_lines(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), str(tmp_path / "state")).awaitTermination()
    assert sorted((x["run"], x["seq"], x["line"]) for x in spark.read.parquet(str(tmp_path / "state" / "lines")).collect()) == want


def test_reported_order_is_the_same_each_time(spark):
    code = files(spark, a_dot_py="x\n" * 30)
    rows = [("a.py", 5.0, "bugs", s, d, "found", "ai", None, None) for s, d in [("low", "b"), ("high", "a"), ("high", "0")]]
    told = spark.createDataFrame(rows, "file string, line double, type string, severity string, description string, status string, source string, evidence string, line_content string")
    for frame in (told, told.orderBy(F.desc("description"))):
        got = scan.scan(code, reported=frame).issues.collect()
        assert [(r["severity"], r["description"]) for r in got] == [("high", "0")]
