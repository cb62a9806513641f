"""Configuration text, findings in JSON, whole scans, the fixing loop, reports, streams."""

import json

import pytest
from pyspark.sql import functions as F
from test_operators import files, issues

from gneiss.functions import rules as R
from gneiss.operators import incremental, policy
from gneiss.plans import report, scan
from gneiss.sources import config, findings
from gneiss.sources import files as sources
from gneiss.streaming import incremental as streaming


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("name: my-plugin\nversion: 1.0", {"name": "my-plugin", "version": "1.0"}), ("items:\n  - alpha\n  - beta\n  - gamma", {"items": ["alpha", "beta", "gamma"]}),
        ("# comment\nname: test", {"name": "test"}), ("prompt: |\n  line one\n  line two\nname: test", {"prompt": "line one\nline two", "name": "test"}),
        ("a: 'quoted'\nb: \"double\"", {"a": "quoted", "b": "double"}), ("hooks:\n  pre-scan: ./run.sh\n  post-scan: ./done.sh", {"hooks": {"pre-scan": "./run.sh", "post-scan": "./done.sh"}}),
        ("", {}), ("mode: fix # note", {"mode": "fix # note"}), ("p:\n  - regex: a\n    type: lint\n  - regex: b", {"p": [{"regex": "a", "type": "lint"}, {"regex": "b"}]}), ("e: [.ts, .js]\nf: []", {"e": "[.ts, .js]", "f": []}),
    ],
)
def test_yaml(text, value):
    assert config.parse_yaml(text) == value


def test_plugins(tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "plugin.yml").write_text("name: first\nprompt: look\npatterns:\n  - regex: foo+\n    severity: high\n  - regex: (a+)+\n")
    (tmp_path / "two.yml").write_text("prompt: also\nfilters:\n  min-severity: high\n")
    (tmp_path / "plugin.yml").write_text("name: ignored")
    plugins = config.load_plugins(str(tmp_path))
    context = config.plugin_context(plugins, "own")
    assert [p.name for p in plugins] == ["first", "two"] and context.prompt == "own\n\nlook\n\nalso"
    assert [r.pattern for r in context.rules] == ["foo+"] and context.filters.min_severity == "high"
    assert config.load_plugins(str(tmp_path / "none")) == []


def test_settings():
    got = config.repo_settings("mode: fix\nmin-severity: HIGH\nfail-below: 70 # soft\nrules:\n  lint: off\n  odd: off\nignore:\n  - a/**\nagent: other")
    assert got == {"mode": "fix", "min-severity": "high", "fail-below": 70, "rules": {"lint": "off"}, "ignore": ["a/**"]}
    assert config.settled({"a": 1, "b": 5}, {"b": 2}, {"a": 3, "c": 4}, {"a": 1, "b": 0, "c": 0}) == {"a": 3, "b": 5, "c": 4}


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("parallel-agents: 99", {}), ("parallel-agents: 8", {"parallel-agents": 8}), ("parallel-agents: 0", {}), ("max-passes: -3", {}), ("max-passes: 5x", {"max-passes": 5}), ("min-passes: 0", {}), ("fail-below: 400", {}), ("fail-below: 100", {"fail-below": 100}),
        ("max-chains: 0\nmax-turns: 0\nmax-issues-per-pass: 0", {"max-chains": 0, "max-issues-per-pass": 0}), ("timeout: 45m\nmodel: big\ntest-command: make test", {"timeout": "45m", "model": "big", "test-command": "make test"}),
        ("plugins: False\nverbose: TRUE", {"plugins": False, "verbose": True}), ("plugins: yes", {"plugins": True}), ("fix-types:\n  - lint\n  - odd", {"fix-types": ["lint"]}), ("framework: next\nruntime: node", {"framework": "next", "runtime": "node"}),
        ("app:\n  type: API\n  exposure: everywhere\n  auth: true\n  network: vpn\n  dataSensitivity: High", {"app": {"type": "api", "network": "vpn", "data-sensitivity": "high", "auth": True}}), ("app: api", {}),
        ("trust-internal:\n  - ours\ntrust-untrusted:\n  - api/**", {"trusted": ["ours"], "untrusted": ["api/**"]}), ("allow:\n  - pattern: x.*\n    reason: meant\n  - reason: none", {"allow": [{"pattern": "x.*", "reason": "meant"}]}),
        ("strictness: HIGH\nscan-scope: pr\nscan-provider: odd", {"strictness": "high", "scan-scope": "pr"}), ("", {}), ("custom-prompt-file: a.md\noutput-file: out.json", {"custom-prompt-file": "a.md", "output-file": "out.json"}),
    ],
)
def test_bounds_of_settings(text, value):
    assert config.repo_settings(text) == value


def test_settings_reach_the_request():
    from gneiss.plans import prompts

    got = config.repo_settings("app:\n  type: cli\n  exposure: local\ntrust-internal:\n  - ours\ntrust-untrusted:\n  - stdin\nallow:\n  - pattern: eval\n    reason: a shell\nruntime: node")
    text = prompts.context_section(got, "Be brief.")
    assert all(x in text for x in ("cli", prompts.EXPOSURE["local"], "ours", "stdin", "eval (a shell)", "runtime: node", "Be brief."))


def test_summary_says_what_it_leaves_out(spark):
    rows = issues(spark, *[{"severity": "low", "line": 3}] * 4, {"severity": "critical"})
    assert "3 more issues" in report.ScanReport.of(rows, 50, 2).summary() and "more issue" not in report.ScanReport.of(rows, 50).summary()
    lines = [r["value"] for r in report.issue_lines(rows).collect()]
    assert len(lines) == 5 and lines[0] == f"| {R.SEVERITY_ICON['critical']} | bugs | `src/foo.ts` | Test issue |" and "`src/foo.ts:3`" in lines[1]


RAW = [
    ({"type": "bugs", "severity": "high", "file": "src/foo.ts", "line": 42, "description": "Null deref"}, ("bugs", "high", "src/foo.ts", 42.0, "Null deref")),
    (None, None), ("string", None), ({"type": "invalid", "file": "a"}, ("lint", "medium", "a", None, "Unknown issue")), ({"severity": "mega", "file": "a", "line": "42"}, ("lint", "medium", "a", None, "Unknown issue")),
    ({}, ("lint", "medium", "unknown", None, "Unknown issue")), ({"file": "only", "line": 1.5}, ("lint", "medium", "only", 1.5, "Unknown issue")),
]


@pytest.mark.parametrize("wrap", [lambda s: s, lambda s: f"Sure:\n```json\n{s}\n```"])
def test_findings(spark, wrap):
    rows = spark.createDataFrame([(wrap(json.dumps({"issues": [r for r, _ in RAW]})),), ("no",), ("{}",)], "raw string")
    got = findings.parse_issues(rows).orderBy("pos").collect()
    assert [(r["type"], r["severity"], r["file"], r["line"], r["description"]) for r in got] == [w for _, w in RAW if w]


def test_wrapped_answers(spark):
    inner = 'text {"issues": [{"file": "a"}]} more'
    rows = spark.createDataFrame([(json.dumps({"result": inner}),), (inner,), ('{"other": 1}',)], "raw string")
    assert findings.parse_issues(rows, "loop").count() == 2
    said = spark.createDataFrame([(1, json.dumps({"result": 'x {"results": [{"file": "a", "line": 3, "status": "fixed"}, 5]}'}))], "cluster_id int, raw string")
    assert [(r["file"], r["line"], r["status"]) for r in findings.parse_results(said).collect()] == [("a", 3, "fixed"), (None, None, None)]


def test_scan_and_cache(spark):
    f = files(spark, a_dot_ts="function f(a) {\n// x\nconsole.log(1)\n", b_dot_py="password = 'longenough'\n", c_dot_py="fine\n")
    first = scan.scan(f)
    assert first.result(f) == {"n": 3, "loc": 5, "score": 87}
    old = spark.createDataFrame([], "path string, hash string, strategy string, scanned_at string, issues array<struct<file:string,line:double,type:string,severity:string,description:string,status:string,source:string>>")
    part = incremental.partition(f, old, "fingerprint")
    cache = incremental.upsert(old, part.where("not hit").select("path", "hash"), first.found.select(*scan.FIELDS), f.select("path"), "fingerprint", "now")
    again = scan.scan(f, cache=cache)
    assert again.partitioned.where("hit").count() == 3 and again.found.count() == 0 and again.result(f) == first.result(f)
    strict = scan.scan(f, scan.Settings(min_severity="high", rules=(R.Rule("own", "fine", "bugs", "high", "Own"),)))
    assert sorted(r["description"] for r in strict.issues.collect()) == ["Hardcoded secret or password", "Own"]


def test_fix_loop():
    left, saved = [7, 3, 0], []
    passes, complete = scan.fix_loop(lambda n: left[n - 1], lambda n: (left[n - 1] - 1, 1), 10, 2, 1e12, save=lambda p: saved.append(len(p)))
    assert complete and [p.found for p in passes] == [7, 3, 0] and saved == [1, 2, 3]
    more, complete = scan.fix_loop(lambda n: 1, lambda n: (1, 0), 5, 1, 1e12, done=passes)
    assert not complete and len(more) == 5
    assert scan.fix_loop(lambda n: 1, lambda n: (1, 0), 5, 1, 0.0) == ([], False)
    assert scan.run_hooks([lambda f: f["missing"], lambda f: None], {}) == ["<lambda>: 'missing'"]
    assert policy.gate(60, 70) and not policy.gate(60, 0) and not policy.gate(70, 70)


def test_reports(spark):
    rows = issues(spark, {"severity": "critical", "line": 3}, {"severity": "low", "type": "lint"}, {"severity": "low", "type": "lint"})
    got = report.ScanReport.of(rows, 88)
    assert "**88/100** · Good · Grade B" in got.comment() and "1 critical issue" in got.summary() and "67%" in got.summary()
    assert "No issues found" in report.ScanReport(100, [], {}, []).comment()
    assert json.loads(report.badge(29))["color"] == "red"
    page = report.dashboard([{"run": 1, "score": 95, "fixed": 2, "passes": 1, "date": "</script>"}])
    assert "\\u003c/script>" in page and "No runs yet" in report.dashboard([])
    text = report.fix_report(50, 70, [{"severity": "low", "type": "lint", "file": "a", "line": None, "description": "d", "commit_sha": "abcdefghij"}], [], [{"number": 1, "found": 1, "fixed": 1, "skipped": 0, "duration_ms": 61_000}])
    assert "(+20)" in text and "`abcdefg`" in text and "1m1s" in text


def test_tree_of_odd_names(spark, tmp_path):
    names = ("pkg/__init__.py", "_x/y.py", ".github/_a/b.py", "_odd[1].py", "node_modules/_a.py", ".git/_b.py", "a b.py", "é.ts", "bad.py", "shut.py", "big.js", "none.txt")
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "bad.py").write_bytes(b"a\xffb")
    (tmp_path / "big.js").write_text("x" * 3_000_000)
    (tmp_path / "shut.py").unlink()
    (tmp_path / "shut.py").symlink_to("nowhere")
    (tmp_path / "loop").symlink_to(tmp_path)
    got = {r["path"]: r["content"] for r in sources.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"pkg/__init__.py", "_x/y.py", ".github/_a/b.py", "_odd[1].py", "a b.py", "é.ts", "bad.py", "big.js"}
    assert got["_x/y.py"] == "_x/y.py" and got["bad.py"] == "a\ufffdb" and len(got["big.js"]) == 3_000_000
    some = sources.read_tree(spark, tmp_path.as_uri(), (F.col("ext") == ".py") & F.col("path").startswith("pkg/"))
    assert [r["path"] for r in some.collect()] == ["pkg/__init__.py"]
    listed = sources.list_tree(spark, str(tmp_path))
    (tmp_path / "a b.py").unlink()  # gone, or not to be read, after the listing
    assert listed.count() == 8


def test_tree(spark, tmp_path):
    for name in ("src/a.ts", "src/b.md", "node_modules/x.js", ".github/w.yml", ".hidden/z.py", "Makefile", "deep/er/c.PY"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("é\n")
    got = {(r["path"], r["ext"], r["content"]) for r in sources.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("src/a.ts", ".ts", "é\n"), (".github/w.yml", ".yml", "é\n"), ("Makefile", "", "é\n"), ("deep/er/c.PY", ".py", "é\n")}


def test_state(spark, tmp_path):
    rows = issues(spark, {}, {"status": "fixed"})
    sources.write_issues(rows, str(tmp_path / "i"))
    assert sources.read_issues(spark, str(tmp_path / "i")).count() == 2
    (tmp_path / "doc.json").write_text(json.dumps({"version": 1, "issues": [{"file": "a", "status": "found"}, {"file": "b", "status": "fixed"}]}))
    assert sources.read_issues(spark, str(tmp_path / "doc.json"), only_found=True).count() == 1
    for _ in range(2):
        sources.append_history(spark.range(1), str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2
    assert sources.load_state(spark, str(tmp_path / "none"), "a int").count() == 0
    sources.save_state(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "s"))
    assert sources.load_state(spark, str(tmp_path / "s"), "a int").count() == 1


def test_stream_scans_changes_only(spark, tmp_path):
    schema, place = "path string, ext string, content string", str(tmp_path / "in")
    scanned = []

    def look(batch):
        scanned.append(sorted(r["path"] for r in batch.collect()))
        return batch.select("path", F.length("content").alias("n"))

    for rows in ([("a", ".py", "one"), ("b", ".py", "two")], [("a", ".py", "one"), ("b", ".py", "three"), ("c", ".py", "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
        streaming.incremental_scan(spark.readStream.schema(schema).parquet(place), look, str(tmp_path / "state")).awaitTermination()
    assert scanned == [["a", "b"], ["b", "c"]]
    got = {(r["path"], r["n"]) for r in streaming.current(spark, str(tmp_path / "state"), "path string, n int").collect()}
    assert got == {("a", 3), ("b", 5), ("c", 1)}


def test_requests(spark):
    from gneiss.plans import prompts

    text = prompts.scan_request("MAP", [("a.py", "x = 1", True)], 1, 2, "be kind")
    assert "MAP" in text and "- a.py (compressed)" in text and "x = 1" in text and "be kind" in text
    assert "1. [high] bugs at a.py:3: d" in prompts.fix_request([{"severity": "high", "type": "bugs", "file": "a.py", "line": 3.0, "description": "d"}])

    def call(t):
        if t == "bad":
            raise ValueError
        return t.upper()

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "chunk int, text string")
    assert {r["chunk"]: r["raw"] for r in prompts.ask(rows, call).collect()} == {1: "OK", 2: None}


def service(log, refuse=(), large=10**9):
    """A model that writes down what it is asked, refuses some requests the first times, and takes so many characters."""
    from gneiss.plans import prompts

    def call(text):
        with open(log, "a") as f:
            f.write(json.dumps(text) + "\n")
        asked = [json.loads(x) for x in open(log)].count(text)
        if len(text) > large:
            raise prompts.TooLarge
        for word, times, after in refuse:
            if word in text and asked <= times:
                raise prompts.RateLimited(after)
        if "odd" in text:
            raise ValueError("odd")
        return text.upper()

    return call


def test_a_model_is_asked_within_its_limits_and_never_twice(spark, tmp_path):
    from gneiss.plans import prompts

    log, kept = tmp_path / "log", str(tmp_path / "kept")
    call = service(str(log), [("later", 2, 0.0), ("never", 9, 0.0), ("long", 9, 61.0)])
    rows = spark.createDataFrame([(1, "a"), (2, "later"), (3, "never"), (4, "odd"), (5, "a"), (6, "long"), (7, None)], "chunk int, text string").coalesce(1)
    options = {"at_once": 1, "kept": kept, "sleep": lambda s: None}
    got = {r["chunk"]: (r["raw"], r["outcome"]) for r in prompts.ask(rows, call, **options).collect()}
    assert {k: v for k, v in got.items() if k not in (1, 5)} == {2: ("LATER", "answered"), 3: (None, "rate-limited"), 4: (None, "failed: odd"), 6: (None, "rate-limited"), 7: ("", "answered")}
    assert sorted([got[1], got[5]]) == [("A", "answered"), ("A", "kept")]  # the same request is made once
    asked = [json.loads(x) for x in open(log)]
    assert (asked.count("a"), asked.count("later"), asked.count("never"), asked.count("long")) == (1, 3, prompts.RETRIES + 1, 1)
    again = {r["chunk"]: r["outcome"] for r in prompts.ask(rows.where("chunk in (1, 2, 5, 7)"), call, **options).collect()}
    assert set(again.values()) == {"kept"} and len([*open(log)]) == len(asked)
    other = prompts.ask(rows.where("chunk = 1"), call, model="another", **options).first()
    assert other["outcome"] == "answered" and len([*open(log)]) == len(asked) + 1


def test_requests_keep_their_pace():
    from gneiss.plans import prompts

    clock, waits = [0.0], []
    caller = prompts.Caller(lambda t: t, 4.0, None, "", lambda s: (waits.append(s), clock.__setitem__(0, clock[0] + s)), lambda: clock[0])
    for n in range(4):
        caller.ask(str(n))
        clock[0] += 1.0
    assert waits == [3.0, 3.0, 3.0]


def test_chunks_that_are_too_large_are_asked_for_in_halves(spark, tmp_path):
    from gneiss.plans import prompts

    log = tmp_path / "log"
    placed = spark.createDataFrame([("a", i, f"f{i}") for i in range(4)] + [("b", 0, "g")] + [("c", i, "hhhhhhhhhhhh") for i in range(2)], "chunk string, pos int, path string")

    def render(rows):
        return rows.groupBy("chunk", "part").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("text"))

    got = prompts.ask_in_halves(placed, render, service(str(log), large=5), 1_000, kept=str(tmp_path / "kept")).collect()
    assert {(r["chunk"], r["part"], r["raw"], r["outcome"]) for r in got} == {
        ("a", "0", "F0,F1", "answered"), ("a", "1", "F2,F3", "answered"), ("b", "", "G", "answered"), *((("c", p, None, "too-large")) for p in ("00", "10")),
    }
    asked = [json.loads(x) for x in open(log)]
    assert asked.count("g") == 1 and asked.count("f0,f1") == 1


def test_a_scan_with_a_model_as_one_run(spark, tmp_path):
    """A fake model that sees something in every outline with FLAGS, more in whole files, and doubts what it calls doubtful."""
    import re

    from gneiss.plans import modelled

    log = tmp_path / "log"

    def call(text):
        with open(log, "a") as f:
            f.write(json.dumps(text) + "\n")
        if text.startswith("These are outlines"):
            found = [{"type": "bugs", "severity": "high", "file": p, "line": 2, "description": "Seen in the outline"} for p in re.findall(r"=== (\S+) \(\d+ lines\) ===\n(?:(?!===).*\n)*FLAGS", text)]
            return json.dumps({"issues": [*found, {"type": "lint", "severity": "low", "file": "gone.py", "line": 1, "description": "No such file"}]})
        if text.startswith("These are whole"):
            files = re.findall(r"--- (\S+) ---", text)
            return "Here: " + json.dumps({"issues": [{"type": "stubs", "severity": "low", "file": f, "line": n, "description": d, "line_content": c} for f in files for n, d, c in ((1, "doubtful", ""), (3, "Misplaced", "nowhere to be found at all"), (1, "Borne out", ""))]})
        return json.dumps({"results": [{"index": int(n), "is_real": "doubtful" not in claim} for n, claim in re.findall(r"--- Issue (\d+) ---\n(?:.*\n){3}Claim: (.*)", text)]})

    f = files(spark, a_dot_py="import os\nx = eval(user)", b_dot_py="fine = 1", c_dot_py="y = 2\nz = eval(y)")
    options = {"sleep": lambda s: None, "at_once": 2, "kept": str(tmp_path / "kept")}
    got = modelled.model_scan(f, call, **options)
    issues_ = sorted((r["file"], r["line"], r["type"], r["description"], r["source"]) for r in got.scan.issues.collect() if r["source"] == "ai")
    assert issues_ == [(p, n, t, d, "ai") for p in ("a.py", "c.py") for n, t, d in ((1.0, "stubs", "Borne out"), (2.0, "bugs", "Seen in the outline"))]
    assert {(r["kind"], r["outcome"]) for r in got.requests.collect()} == {("fingerprints", "answered"), ("whole", "answered"), ("verdicts", "answered")}
    assert got.reported.count() == 9 and got.kept.count() == 4
    asked = len([*open(log)])
    again = modelled.model_scan(f, call, **options)
    assert len([*open(log)]) == asked and again.kept.count() == 4 and {r["outcome"] for r in again.requests.collect()} == {"kept"}
    cache = incremental.upsert(spark.createDataFrame([], incremental.schema()), f.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("hash")), got.scan.found.select(*scan.FIELDS), f.select("path"), "fingerprint", "t", "m")
    third = modelled.model_scan(f, call, cache=incremental.usable(cache, "m"), **options)
    assert len([*open(log)]) == asked and third.requests.count() == 0
    assert sorted((r["file"], r["line"], r["type"]) for r in third.scan.issues.collect()) == sorted((r["file"], r["line"], r["type"]) for r in got.scan.issues.collect())

    def broken(text):
        if text.startswith("Say of each"):
            raise prompts_error
        return call(text)

    prompts_error = ValueError("down")
    kept = modelled.model_scan(f, broken, sleep=lambda s: None, kept=str(tmp_path / "other")).kept
    assert kept.count() == 6  # without verdicts all stays that the text bears out


def test_state_goes_round(spark, tmp_path):
    place, f = str(tmp_path / "state"), files(spark, a_dot_ts="function f(a) {\n// x\nconsole.log(1)\n", b_dot_py="fine\n")

    def run(model, at):
        old = incremental.usable(sources.load_state(spark, place, incremental.schema()), model)
        done = scan.scan(f, cache=old)
        new = incremental.upsert(old, done.partitioned.where("not hit").select("path", "hash"), done.found.select(*scan.FIELDS), f.select("path"), "fingerprint", at, model)
        hits, n = done.partitioned.where("hit").count(), done.result(f)["n"]
        sources.save_state(new, place)
        return hits, n

    assert run("one", "t1") == (0, 2) and run("one", "t2") == (2, 2)  # the second reads what the first wrote
    assert run("two", "t3") == (0, 2) and run("two", "t4") == (2, 2)  # another model's entries are none
    state = sources.load_state(spark, place, incremental.schema())
    assert {(r["model"], r["version"]) for r in state.collect()} == {("two", incremental.VERSION)} and incremental.usable(state, "two", 1).count() == 0
    folders = sorted(p for p in (tmp_path / "state").iterdir() if p.is_dir())
    assert len(folders) == sources.KEPT + 1
    with pytest.raises(Exception):  # noqa: B017  a run that dies while it writes
        sources.save_state(state.withColumn("path", F.raise_error(F.lit("dies"))), place)
    assert sources.load_state(spark, place, incremental.schema()).count() == 2
    for part in folders[-1].glob("*.parquet"):
        part.write_bytes(b"no parquet")
    for crc in folders[-1].glob(".*.crc"):
        crc.unlink()
    assert sources.load_state(spark, place, incremental.schema()).count() == 0
    (tmp_path / "state" / "current").write_text("no json")
    (tmp_path / "state" / ".current.crc").unlink(missing_ok=True)
    assert sources.load_state(spark, place, incremental.schema()).count() == 0 and run("two", "t5") == (0, 2) and run("two", "t6") == (2, 2)
