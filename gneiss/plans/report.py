"""Reports from small collected roll-ups: comment, summary, fix report, badge, dashboard."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.operators import score as S


def _grade(score: int) -> tuple:
    return next(g for g in R.GRADES if g[0] is None or score >= g[0])


def bar(part: float, width: int) -> str:
    filled = int(part * width + 0.5)
    return "█" * filled + "░" * (width - filled)


def duration(ms: int) -> str:
    s = ms // 1000
    if s < 60:
        return f"{s}s"
    big, small, units = (s // 60, s % 60, "ms") if s < 3600 else (s // 3600, s % 3600 // 60, "hm")
    return f"{big}{units[0]}" + (f"{small}{units[1]}" if small else "")


def _table(heads: list[str], rows: list[list]) -> str:
    lines = [heads, [":---"] * len(heads), *rows]
    return "".join("| " + " | ".join(map(str, r)) + " |\n" for r in lines)


def _icon(severity: str) -> str:
    return R.SEVERITY_ICON.get(severity, "⚪")


def _kind(kind: str) -> str:
    return R.TYPE_ICON.get(kind, "\U0001f4cc")


def _place(issue) -> str:
    return f"{issue['file']}:{int(issue['line'])}" if issue["line"] else issue["file"]


@dataclass
class ScanReport:
    """What a scan's reports need: the score, one row per type and severity, and the issues to list."""

    score: int
    types: list
    severities: dict[str, int]
    issues: list

    @classmethod
    def of(cls, issues: DataFrame, score: int, most: int = 1000) -> ScanReport:
        """most: issues that the summary lists, worst first; it says how many more there are. `issue_lines` has all."""
        types = S.type_rollup(issues).orderBy("rank", "type").collect()
        severities = {r["severity"]: r["n"] for r in S.count_by(issues, "severity").collect()}
        return cls(score, types, severities, S.by_severity(issues).limit(most).collect())

    @property
    def total(self) -> int:
        return sum(t["n"] for t in self.types)

    def breakdown(self, width: int) -> str:
        most = max((t["n"] for t in self.types), default=1)
        rows = [[_kind(t["type"]), f"**{t['type']}**", t["n"], f"{_icon(t['worst'])} {t['worst_label']}", f"`{bar(max(t['n'] / most, 0.5 / width), width)}`"] for t in self.types]
        return _table(["", "Category", "Issues", "Severity", "Distribution"], rows)

    def comment(self) -> str:
        _, letter, word, sign, _ = _grade(self.score)
        head = f"## Scan\n\n{sign} **{self.score}/100** · {word} · Grade {letter}\n\n`{bar(self.score / 100, 20)}`\n\n"
        return head + (self.breakdown(10) if self.types else "> [!NOTE]\n> No issues found.\n")

    def summary(self) -> str:
        _, letter, word, sign, _ = _grade(self.score)
        out = [f"# Code quality report\n\n{sign} **{self.score} / 100** `{bar(self.score / 100, 16)}` {word}, grade {letter}\n"]
        if not self.types:
            return "\n".join([*out, "No issues found.\n"])
        out += [f"**{self.total} issue{'s' * (self.total != 1)}** in **{len(self.types)} categor{'ies' if len(self.types) != 1 else 'y'}**\n", self.breakdown(12)]
        for severity, kind in (("critical", "CAUTION"), ("high", "WARNING")):
            if n := self.severities.get(severity):
                out.append(f"> [!{kind}]\n> **{n} {severity} issue{'s' * (n > 1)}** to look at first.\n")
                break
        shares = [[_icon(s), s.capitalize(), n, f"{int(100 * n / self.total + 0.5)}%"] for s in R.SEVERITIES if (n := self.severities.get(s))]
        out.append(_table(["", "Severity", "Count", "Share"], shares))
        rows = [[_icon(i["severity"]), i["type"], f"`{_place(i)}`", i["description"]] for i in self.issues]
        left = self.total - len(self.issues)
        more = [f"{left} more issue{'s' * (left > 1)}, less severe, are not listed here.\n"] if left else []
        return "\n".join([*out, _table(["", "Type", "File", "Description"], rows), *more])


def issue_lines(issues: DataFrame, seq: str = "seq") -> DataFrame:
    """(value): a row of the summary's table for every issue, worst first, as a table that Spark writes as text, part after
    part; nothing of it goes through the driver."""
    icons = F.create_map(*[F.lit(x) for s in R.SEVERITIES for x in (s, _icon(s))])
    place = F.concat("file", F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("long").cast("string"))).otherwise(""))
    cells = [F.coalesce(icons[F.col("severity")], F.lit("")), F.col("type"), F.concat(F.lit("`"), place, F.lit("`")), F.col("description")]
    return S.by_severity(issues, seq).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def fix_report(before: int, after: int, fixed: list, skipped: list, passes: list) -> str:
    """The text of a change request: scores, what was fixed by type (most first), what was skipped, the passes."""
    delta = after - before
    out = [f"## Fix report\n\n{before} → {after} ({'+' * (delta >= 0)}{delta}) `{bar(after / 100, 20)}` {_grade(after)[2]}\n"]
    out.append(_table(["Fixed", "Skipped", "Passes", "Duration"], [[len(fixed), len(skipped), len(passes), duration(sum(p["duration_ms"] for p in passes))]]))
    kinds: dict[str, list] = {}
    for i in fixed:
        kinds.setdefault(i["type"], []).append(i)
    for kind, rows in sorted(kinds.items(), key=lambda x: -len(x[1])):
        out.append(f"{_kind(kind)} **{kind}**: {len(rows)} fixed\n")
        out.append(_table(["", "File", "Issue", "Commit"], [[_icon(i["severity"]), f"`{_place(i)}`", i["description"], f"`{(i['commit_sha'] or '-')[:7]}`"] for i in rows]))
    if skipped:
        out.append(_table(["", "File", "Issue", "Reason"], [[_icon(i["severity"]), f"`{i['file']}`", i["description"], i["skip_reason"] or "-"] for i in skipped]))
    out.append(_table(["Pass", "Found", "Fixed", "Skipped", "Duration"], [[p["number"], p["found"], p["fixed"], p["skipped"], duration(p["duration_ms"])] for p in passes]))
    return "\n".join(out)


def badge(score: int, label: str = "quality") -> str:
    return json.dumps({"schemaVersion": 1, "label": label, "message": f"{score}/100", "color": _grade(score)[4]})


def dashboard(history: list[dict]) -> str:
    """A static page of runs, newest first, with its data inside; < is escaped so that no text ends the script."""
    data = json.dumps(history, default=str).replace("<", "\\u003c")
    grade = lambda s: "a" if s >= 90 else "b" if s >= 70 else "c" if s >= 50 else "d"
    if not history:
        body = "<p>No runs yet.</p>"
    else:
        last = history[-1]
        rows = "".join(f"<tr><td>#{h['run']}</td><td>{h['date']}</td><td class=s-{grade(h['score'])}>{h['score']}</td><td>{h['fixed']}</td><td>{h['passes']}</td></tr>" for h in reversed(history))
        body = f"<p class=s-{grade(last['score'])}>{last['score']} / 100</p><p>{len(history)} runs, {sum(h['fixed'] for h in history)} fixed</p><table>{rows}</table>"
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>Code quality over time</title></head><body><h1>Code quality over time</h1>{body}<script>const DATA={data};</script></body></html>"
