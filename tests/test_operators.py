"""Operators over small tables, and all queries over the smallest data."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text as X
from gneiss.operators import compress, detect, graph, incremental, outcomes, policy, score, verify
from gneiss.plans import catalog

SMALL = "/root/testdata/sf0.001"


def files(spark, **contents):
    rows = [(p.replace("__", "/").replace("_dot_", "."), c) for p, c in contents.items()]
    return spark.createDataFrame(rows, "path string, content string").withColumn("ext", X.extension(F.col("path")))


ISSUE = "seq int, file string, line int, type string, severity string, description string, status string"


def issues(spark, *rows):
    base = {"seq": 0, "file": "src/foo.ts", "line": None, "type": "bugs", "severity": "medium", "description": "Test issue", "status": "found"}
    return spark.createDataFrame([tuple({**base, "seq": i, **r}.values()) for i, r in enumerate(rows)], ISSUE)


def test_filters(spark):
    assert policy.apply_filters(issues(spark, {}), policy.Filters()).count() == 1
    kept = policy.apply_filters(issues(spark, {"type": "lint"}, {}), policy.Filters(exclude_types=("lint",)))
    assert [r["type"] for r in kept.collect()] == ["bugs"]
    assert policy.apply_filters(issues(spark, *({"severity": s} for s in ("low", "high", "critical"))), policy.Filters(min_severity="high")).count() == 2
    kept = policy.apply_filters(issues(spark, {}, {"file": "tests/bar.ts"}), policy.Filters(exclude_paths=("tests/**",)))
    assert [r["file"] for r in kept.collect()] == ["src/foo.ts"]


@pytest.mark.parametrize(("glob", "path", "hit"), [("vendor/", "vendor/a", False), ("vendor/", "vendor/", True), ("**/*.test.ts", "a.test.ts", False), ("**/*.test.ts", "x/a.test.ts", True), ("a?b", "axb", False), ("src/*.ts", "src/x/y.ts", False)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(policy.glob_regex(glob)).alias("v")).first()["v"] is hit


def test_merged_filters():
    merged = policy.merge_filters([policy.Filters(("a", "b"), ("lint",), "low"), policy.Filters(("b",), (), "high"), policy.Filters()])
    assert merged == policy.Filters(("a", "b"), ("lint",), "high")
    assert policy.with_config(merged, ["c"], {"types": "off", "bugs": "high"}).exclude_types == ("lint", "types")


def test_comment_lines_are_skipped(spark):
    found = detect.scan_rules(files(spark, a_dot_py="# TODO no\nx TODO yes\n/* FIXME: yes */\n  * HACK no\n// XXX no\n")).orderBy("line").collect()
    assert [(r["line"], r["description"]) for r in found] == [(2, "TODO yes"), (3, "FIXME: yes */")]


def test_a_marker_takes_the_next_line(spark):
    found = detect.scan_rules(files(spark, a_dot_go="TODO:\nnext")).collect()
    assert [(r["line"], r["description"]) for r in found] == [(1, "TODO:\nnext")]


@pytest.mark.parametrize(
    ("code", "names"),
    [
        ("function f(a) {", ["f"]), ("export async function g(a): number {", []), ("const h = (a) => a", ["h"]), ("const h: Fn = (a) => a", []), ("const k = (a.b).c", []),
        ("const m = (a): string => a", []), ("const n = (a) ? x : (b) => c", []), ("function p(\n  a,\n  b\n) {", ["p"]), ("// function q() {", []), ("function constructor() {", []),
        ("function r(a = (1)) { }\n", ["r"]), ("function s(", []), ("const t = (a)\n  : number => a", []),
    ],
)
def test_missing_return_types(code, names):
    assert [n for _, n in detect.functions_without_return(code)] == names


def test_declaration_files_have_no_missing_types(spark):
    assert detect.missing_return_types(files(spark, a_dot_d_dot_ts="function f(a)")).count() == 0


def test_unused_imports(spark):
    code = "import { Foo, Bar as Baz, q } from './m'\nimport React from 'react'\nimport Gone from 'gone'\nimport A, { B } from 'c'\nFoo()\n"
    found = detect.unused_imports(files(spark, a_dot_ts=code)).orderBy("match_ord").collect()
    assert [(r["line"], r["description"]) for r in found] == [(1, "Unused import: 'Baz'"), (3, "Unused import: 'Gone'")]


def test_scores(spark):
    def scored(total, loc):
        return spark.range(1).select(score.score_of(F.lit(total), F.lit(loc) if loc else None).alias("v")).first()["v"]

    assert (scored(0, None), scored(30, None), scored(500, None), scored(30, 500), scored(30, 3000)) == (100, 70, 0, 70, 90)


def test_first_wins_and_clusters(spark):
    rows = issues(spark, {"severity": "low"}, {"severity": "high"}, {"line": 3}, {"file": "root.py", "severity": "critical"})
    assert [r["seq"] for r in score.first_wins(rows, ["seq"]).orderBy("seq").collect()] == [0, 2, 3]
    many = issues(spark, *({"file": f"a/{i}.ts"} for i in range(21)), {"file": "root.py", "severity": "critical"})
    got = [(r["directory"], r["batch"], r["n"]) for r in score.clusters(many).orderBy("cluster_rank").collect()]
    assert got == [(".", 0, 1), ("a", 0, 10), ("a", 1, 10), ("a", 2, 1)]


def test_line_correction(spark):
    content = "\n".join(f"statement number {i}" for i in range(1, 30))
    rows = spark.createDataFrame([(1, "a.py", 10, "statement   NUMBER 14"), (2, "a.py", 10, "statement number 16"), (3, "a.py", 10, "short"), (4, "a.py", None, "statement number 1")], "seq int, file string, line int, line_content string")
    got = {r["seq"]: (r["line"], r["content_verified"]) for r in verify.correct_lines(rows, files(spark, a_dot_py=content)).collect()}
    assert got == {1: (14, True), 3: (10, False), 4: (None, False)}
    blank = verify.correct_lines(rows.where("seq = 2"), files(spark, a_dot_py="x\n\n" + "y\n" * 20)).collect()
    assert blank == []


def test_band_of_local_findings(spark):
    local = issues(spark, {"line": 10})
    found = issues(spark, {"line": 13}, {"line": 14}, {"line": None}, {"line": 10, "type": "lint"}, {"line": 0})
    assert sorted(r["seq"] for r in verify.drop_local_duplicates(found, local).collect()) == [1, 2, 3, 4]
    assert sorted(r["seq"] for r in verify.drop_local_duplicates(found, issues(spark, {}, {"line": 2})).collect()) == [0, 1, 3, 4]


def test_cache(spark):
    f = files(spark, a_dot_py="one", b_dot_py="two", c_dot_py="three", d_dot_py="four")
    hashed = f.select("path", X.content_hash(F.col("content")).alias("hash"))
    kinds = F.element_at(F.create_map(*map(F.lit, ("a.py", "deep", "b.py", "fingerprint", "d.py", "deep"))), F.col("path"))
    cache = hashed.withColumn("strategy", kinds).withColumn("hash", F.when(F.col("path") == "d.py", "other").otherwise(F.col("hash")))
    hits = lambda s: sorted(r["path"] for r in incremental.partition(f, cache, s).where("hit").collect())
    assert (hits("deep"), hits("fingerprint")) == (["a.py"], ["a.py", "b.py"])


def test_resolution(spark):
    f = files(spark, src__a_dot_ts="", src__b_dot_tsx="", src__lib__index_dot_ts="", pkg__mod_dot_py="", pkg__sub____init___dot_py="", top_dot_ts="")
    f = f.unionByName(spark.createDataFrame([("pkg/sub/__init__.py", "", ".py")], "path string, content string, ext string"))
    specs = [("src/a.ts", 0, "./b"), ("src/a.ts", 1, "./lib"), ("src/a.ts", 2, "../top"), ("x.py", 0, "pkg.mod"), ("x.py", 1, "pkg.sub"), ("x.py", 2, "nowhere"), ("src/lib/index.ts", 0, "./../a")]
    got = {(r["path"], r["pos"]): r["target"] for r in graph.resolve_imports(spark.createDataFrame(specs, "path string, pos int, spec string"), f).collect()}
    assert got == {("src/a.ts", 0): "src/b.tsx", ("src/a.ts", 1): "src/lib/index.ts", ("src/a.ts", 2): "top.ts", ("x.py", 0): "pkg/mod.py", ("x.py", 1): "pkg/sub/__init__.py", ("src/lib/index.ts", 0): "src/a.ts"}


def test_packing(spark):
    items = spark.createDataFrame([("a", 60, 5, 0), ("b", 50, 5, 1), ("c", 500, 9, 2), ("d", 50, 1, 3), ("e", 1, 1, 4)], "path string, tokens long, hotspots int, ord int")
    got = [(r["path"], r["chunk"]) for r in graph.pack_next_fit(items, 100).orderBy("pos").collect()]
    assert got == [("c", 0), ("a", 1), ("b", 2), ("d", 2), ("e", 3)]


def walked(items, budget):
    """(group, path): (chunk, pos) of next-fit, item by item."""
    out, now, used, chunk, pos = {}, None, 0, 0, -1
    for g, path, tokens, hot, order in sorted(items, key=lambda r: (r[0], -r[3], r[4], r[1])):
        if g != now:
            now, used, chunk, pos = g, 0, 0, -1
        pos += 1
        if pos and used + (tokens or 0) > budget:
            chunk, used = chunk + 1, 0
        used += tokens or 0
        out[g, path] = (chunk, pos)
    return out


def test_packing_in_ranges_equals_the_walk(spark):
    r = random.Random(4)
    items = [(g, f"p{i}", r.choice([0, 1, 7, 30, 99, 100, 101, 400, None]), r.randrange(3), i % 50) for g, n in (("a", 300), ("b", 1), ("c", 900), ("d", 2), ("e", 40)) for i in range(n)]
    frame = spark.createDataFrame(items, "repo string, path string, tokens long, hotspots int, ord int")
    for parts in (1, 2, 7, 23):
        got = graph.pack_next_fit(frame, 100, ["repo"], parts).collect()
        assert len(got) == len(items) and {(x["repo"], x["path"]): (x["chunk"], x["pos"]) for x in got} == walked(items, 100)
    alone = [("", *x[1:]) for x in items if x[0] == "c"]
    got = graph.pack_next_fit(frame.where("repo = 'c'").drop("repo"), 100, parts=9)
    assert {("", x["path"]): (x["chunk"], x["pos"]) for x in got.collect()} == walked(alone, 100)


def plain_groups(files, neighbours, budget):
    """smart_groups, by looking at every file for every chunk."""
    size = {f["path"]: f["length"] + len(f["path"]) + 10 for f in files}
    length, order = {f["path"]: f["length"] for f in files}, {f["path"]: i for i, f in enumerate(files)}
    small, taken, chunks = sorted(size, key=lambda p: (length[p], order[p])), set(), []
    where = {f["path"]: f["directory"] for f in files}
    for f in sorted(files, key=lambda f: (-len(neighbours.get(f["path"], ())), f["directory"], f["length"], order[f["path"]])):
        if f["path"] in taken:
            continue
        chunk, used = [f["path"]], size[f["path"]]
        taken.add(f["path"])
        near = sorted((n for n in neighbours.get(f["path"], ()) if n in size), key=lambda p: (length[p], order[p]))
        for pool in (near, [p for p in small if where[p] == f["directory"]], small):
            for p in pool:
                if p not in taken and used + size[p] <= budget:
                    chunk.append(p)
                    used += size[p]
                    taken.add(p)
        chunks.append(chunk)
    return chunks


def test_smart_groups_equal_a_plain_version():
    r = random.Random(5)
    for _ in range(1_000):
        files, neighbours = [], {}
        for i in range(r.randrange(25)):
            path = r.choice(["", "a/", "b/", "b/c/"]) + "x" * r.randrange(1, 20) + str(i)
            files.append({"path": path, "directory": path.rpartition("/")[0] or ".", "length": r.randrange(120)})
        for _ in range(r.randrange(2 * len(files) + 1)):
            a, b = r.choice(files)["path"], r.choice([*(f["path"] for f in files), "gone"])
            if a != b:
                neighbours.setdefault(a, set()).add(b)
                neighbours.setdefault(b, set()).add(a)
        budget = r.choice((60, 100, 200, 400))
        assert graph.smart_groups(files, neighbours, budget) == plain_groups(files, neighbours, budget)


def test_long_files_are_compressed_before_they_are_grouped(spark):
    text = "def f(a):\n" + "    x = 1  # why\n" * 60
    rows = [("r", "a.py", ".py", text), ("r", "b.py", ".py", "y = 1\n" * 10), ("r", "d/c.py", ".py", None)]
    none = spark.createDataFrame([], "repo string, src string, dst string")
    got = graph.smart_group(spark.createDataFrame(rows, "repo string, path string, ext string, content string"), none, 700).collect()
    assert {(x["path"], x["chunk"]) for x in got} == {("a.py", 0), ("b.py", 0), ("d/c.py", 0)}
    lengths = spark.createDataFrame([(r, p, len(c or "")) for r, p, _, c in rows], "repo string, path string, content_len int")
    assert {(x["path"], x["chunk"]) for x in graph.smart_group(lengths, none, 700).collect()} == {("a.py", 1), ("b.py", 0), ("d/c.py", 0)}


def plain_related(placed, imports, most):
    """related_files, pair by pair."""
    chunk, pos = {p: c for p, c, _ in placed}, {p: n for p, _, n in placed}
    found = {}
    for importer, spec in imports:
        for p in chunk:
            dotted = p.endswith(spec.replace(".", "/") + ".py")
            plain = p.endswith((spec + ".ts", spec + ".py")) or p == spec
            if chunk[p] != chunk[importer]:
                if plain or dotted:
                    found.setdefault(chunk[importer], set()).add((chunk[p], pos[p], p))
                if plain:
                    found.setdefault(chunk[p], set()).add((chunk[importer], pos[importer], importer))
    return {(c, o, p, n + 1) for c, rows in found.items() for n, (o, _, p) in enumerate(sorted(rows)[:most])}


def test_related_files(spark):
    r = random.Random(6)
    names = ["utils.py", "m.ts", "a/m.ts", "a/utils.py", "b/c.py", "b/utils.ts", "x", "b.c.ts"] + [f"d{i}/utils.py" for i in range(12)]
    for _ in range(6):
        placed = [(p, r.randrange(5), r.randrange(9)) for p in names]
        imports = [(r.choice(names), r.choice(["utils", "m", "./m", "b.c", "x", "c", "s", ""])) for _ in range(r.randrange(25))]
        got = graph.related_files(spark.createDataFrame(placed, "path string, chunk int, pos int"), spark.createDataFrame(imports, "path string, spec string"), 4)
        assert {tuple(x) for x in got.collect()} == plain_related(placed, imports, 4)
    one, two = [("a.py", 0, 0), ("utils.py", 1, 1)], [("b.py", 0, 0), ("utils.py", 1, 1)]
    both = spark.createDataFrame([("one", *x) for x in one] + [("two", *x) for x in two], "repo string, path string, chunk int, pos int")
    got = graph.related_files(both, spark.createDataFrame([("one", "a.py", "utils")], "repo string, path string, spec string"), group="repo")
    assert {tuple(x) for x in got.collect()} == {("one", 0, 1, "utils.py", 1), ("one", 1, 0, "a.py", 1)}


def test_many_importers_of_one_name_do_not_meet(spark):
    placed = spark.range(1_500).select(F.concat(F.lit("d"), F.col("id"), F.lit("/utils.py")).alias("path"), (F.col("id") % 50).alias("chunk"), F.col("id").alias("pos"))
    found = graph.related_files(placed, placed.select("path", F.lit("utils").alias("spec")))
    assert found.count() == 300
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan()
    rows = []

    def walk(node):
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    found.collect()
    walk(plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan)
    assert max(rows, default=0) < 40_000


def test_smart_groups():
    f = [{"path": p, "directory": p.rpartition("/")[0] or ".", "length": n} for p, n in [("a/x.ts", 50), ("a/y.ts", 60), ("b/z.ts", 10), ("b/w.ts", 200)]]
    chunks = graph.smart_groups(f, {"a/x.ts": {"b/z.ts"}, "b/z.ts": {"a/x.ts"}}, 160)
    assert chunks[0][:2] == ["a/x.ts", "b/z.ts"]
    assert sorted(p for c in chunks for p in c) == sorted(x["path"] for x in f)


@pytest.mark.parametrize("most", [1000, 60, 45, 30, 10])
def test_compression_fits(spark, most):
    code = "// note\nfunction f() {\n  a\n  b\n  c\n  d\n  e\n}\n/* block */\nrest\n" + "x" * 40
    row = compress.fitted(files(spark, a_dot_ts=code), F.lit(most)).first()
    assert len(row["fit"]) <= most or most == 1000
    assert row["compressed"] == (len(code) > most)


def test_compression_facts(spark):
    row = compress.fitted(files(spark, a_dot_ts="x" * 10_000), F.lit(200)).first()
    assert row["compressed"] and len(row["fit"]) <= 200 and "truncated" in row["fit"]
    row = compress.fitted(files(spark, a_dot_ts="// one\nconst x = 1; /* two */ const y = 2;\n"), F.lit(34)).first()
    assert "one" not in row["fit"] and "two" not in row["fit"]


def test_skeleton():
    code = "def f():\n    1\n    2\n    3\n    4\n    5\nx = 1\n"
    assert compress.skeleton(code, ".py") == "def f():\n    1\n    2\n    3\n  // ... 2 lines collapsed\nx = 1\n"


def test_budget_levels(spark):
    def level(*left):
        rows = spark.createDataFrame([(f"m{i}", "low", 0, n) for i, n in enumerate(left)], "model string, tier string, used int, remaining int")
        return outcomes.budget_level(rows, "m0").first()["level"]

    assert (level(0, 14), level(0, 15), level(19, 0), level(20, 0), level(0, 39), level(0, 40)) == ("critical", "normal", "normal", "flush", "normal", "flush")


def test_reported_results(spark):
    work = spark.createDataFrame([(0, 1, "a", 5), (0, 2, "b", 7), (0, 3, "c", 1)], "cluster_id int, seq int, file string, line int")
    said = spark.createDataFrame([(0, 0, "a", 6, "fixed", ""), (0, 1, "a", None, "skipped", ""), (0, 2, "a", 5, "fixed", ""), (0, 3, "b", 0, "fixed", "")], "cluster_id int, ord int, file string, line int, status string, reason string")
    got = {r["seq"]: (r["status"], r["skip_reason"]) for r in outcomes.match_results(work, said).collect()}
    assert got == {1: ("skipped", "Agent could not fix"), 2: ("fixed", None), 3: ("skipped", "No result reported by agent")}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run(spark, name):
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    rows = catalog.QUERIES[name](spark, SMALL)
    assert len(rows.columns) == len(set(rows.columns))
    assert rows.count() >= 0
