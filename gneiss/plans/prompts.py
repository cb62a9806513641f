"""Requests to a model or agent, as text; and the hook through which a model's answers come in as a table."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import rules as R
from gneiss.operators import graph
from gneiss.sources import scratch
from gneiss.sources.files import store_of

GUIDE = {"critical": "can be exploited or loses data", "high": "breaks in normal use", "medium": "hard to maintain", "low": "a matter of style"}


def scan_request(manifest: str, files: list[tuple[str, str, bool]], number: int, total: int, extra: str = "") -> str:
    """A chunk of files (path, content, compressed) to look at."""
    names = "\n".join(f"- {p}{' (compressed)' * short}" for p, _, short in files)
    guide = "\n".join(f"{s}: {GUIDE[s]}" for s in R.SEVERITIES)
    sources = "\n".join(f"--- {p} ---\n{c}\n" for p, c, _ in files)
    parts = [manifest, f"Chunk {number} of {total}. Report problems as JSON with an array `issues`.", f"Files:\n{names}", f"Kinds: {', '.join(R.TYPES)}", guide, extra, sources]
    return "\n\n".join(p for p in parts if p)


def pass_request(number: int, fixed: list[str], plan: str = "", extra: str = "") -> str:
    """A whole repository to look at: from the second pass on with what was fixed so far, not to be told again."""
    first = "Look through every file of this repository and report each real problem with its file and line."
    later = f"This is pass {number}. Look through the repository again for problems that the fixes brought to light.\n\nFixed so far:\n" + "\n".join(f"- {x}" for x in fixed)
    guide = "\n".join(f"{s}: {GUIDE[s]}" for s in R.SEVERITIES)
    parts = [first if number == 1 else later, f"Kinds: {', '.join(R.TYPES)}", guide, plan and f"Plan:\n{plan}", extra, "Answer with JSON alone: an array `issues` of type, severity, file, line, description."]
    return "\n\n".join(p for p in parts if p)


def _place(issue: dict) -> str:
    return f"{issue['file']}:{int(issue['line'])}" if issue.get("line") else issue["file"]


def fix_request(issues: list, extra: str = "", test: str = "") -> str:
    """A cluster of issues to fix, one after the other; test: a command that must pass after each."""
    rows = "\n".join(f"{n}. [{i['severity']}] {i['type']} at {_place(i)}: {i['description']}" for n, i in enumerate(issues, 1))
    files = {i["file"] for i in issues}
    apart = f"The {len(files)} files do not depend on each other: work on them side by side." if len(files) > 1 else ""
    check = f"Run `{test}` after each fix; take back a fix that it fails." if test else "See after each fix that the file still parses."
    parts = [f"Fix these {len(issues)} issues, with as small a change as each needs, and report JSON with an array `results` (file, line, status fixed or skipped, reason).", rows, apart, check, extra]
    return "\n\n".join(p for p in parts if p)


def single_request(issue: dict, extra: str = "", test: str = "") -> str:
    """One issue to fix. An answer that begins with SKIP: says why it cannot be."""
    told = f"{issue['type']}, {issue['severity']}, at {_place(issue)}: {issue['description']}"
    check = f"Run `{test}` afterwards." if test else "See that the file still parses."
    parts = ["Fix this one issue and change nothing else.", told, extra, check, "If it cannot be fixed without harm, answer with SKIP: and the reason."]
    return "\n\n".join(p for p in parts if p)


#: What an application's exposure means for the weight of findings.
EXPOSURE = {
    "local": "It is not on a network: weigh what needs a remote attacker lightly, unless it reads input that nobody vouches for.",
    "internal": "Only an internal network reaches it: weigh what needs an outside attacker lightly, access between users fully.",
    "public": "Everybody reaches it: weigh every finding about security fully.",
}


def context_section(settings: dict, custom: str = "") -> str:
    """What a request should say of the application: app (a mapping), framework, runtime, trusted packages, files at the
    boundary of trust, allowed patterns, and the user's own text. Nothing set: empty."""
    app = settings.get("app") or {}
    lines = [f"- {k.replace('-', ' ')}: {'yes' if v is True else 'no' if v is False else v}" for k, v in app.items() if v not in (None, "")]
    exposure = "local" if app.get("network") == "localhost" else app.get("exposure")
    tools = [f"- {k}: {settings[k]}" for k in ("framework", "runtime") if settings.get(k)]
    listed = lambda title, rows: f"{title}\n" + "\n".join(f"- {x}" for x in rows) if rows else ""
    allowed = [f"{r['pattern']} ({r['reason']})" if r.get("reason") else r["pattern"] for r in settings.get("allow") or []]
    parts = [
        listed("The application:", [x[2:] for x in lines]), EXPOSURE.get(exposure, "") if lines else "", listed("Built with:", [x[2:] for x in tools]), listed("Trusted as if its own:", settings.get("trusted")),
        listed("Where input that nobody vouches for comes in:", settings.get("untrusted")), listed("Meant to be so, not to be reported:", allowed), custom and f"Further rules:\n{custom}",
    ]
    return "\n\n".join(p for p in parts if p)


class RateLimited(Exception):
    """The service wants to be asked later: after so many seconds, if it said."""

    def __init__(self, after: float | None = None):
        super().__init__(after)
        self.after = after


class TooLarge(Exception):
    """The request is beyond what the model takes."""


# How often a request is made again, the waits before that where the service names none, and the longest.
RETRIES, WAITS, LONGEST_WAIT = 3, (5.0, 15.0, 45.0), 60.0


class Caller:
    """Asks a service within a task: no faster than its pace, again after a refusal, and never what is answered already.

    pace: seconds from one request to the next. kept: a folder that all tasks share; an answer is there, by a digest of
    model and request, before the next is asked for, so a task that runs again finds it."""

    def __init__(self, call: Callable[[str], str], pace: float, kept: str | None, model: str, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        self.call, self.pace, self.model, self.sleep, self.now, self.due = call, pace, model, sleep, now, 0.0
        self.store, self.folder = store_of(kept) if kept else (None, "")
        if self.store:
            self.store.create_dir(self.folder, recursive=True)

    def _place(self, text: str) -> str:
        return f"{self.folder}/{hashlib.sha256(f'{self.model}\0{text}'.encode()).hexdigest()}"

    def _known(self, text: str) -> str | None:
        try:
            with self.store.open_input_stream(self._place(text)) as f:
                return f.read().decode()
        except OSError:
            return None

    def _keep(self, text: str, answer: str) -> None:
        own = f"{self._place(text)}-{uuid.uuid4().hex}"
        with self.store.open_output_stream(own) as f:
            f.write(answer.encode())
        self.store.move(own, self._place(text))  # whole or not there

    def _once(self, text: str) -> str:
        wait = self.due - self.now()
        if wait > 0:
            self.sleep(wait)
        self.due = self.now() + self.pace
        return self.call(text)

    def ask(self, text: str) -> tuple[str | None, str]:
        """(answer, outcome): answered, kept (it was there), too-large, or why there is none."""
        if self.store and (known := self._known(text)) is not None:
            return known, "kept"
        for turn in range(RETRIES + 1):
            try:
                answer = self._once(text)
            except RateLimited as e:
                wait = WAITS[min(turn, len(WAITS) - 1)] if e.after is None else e.after
                if turn == RETRIES or wait > LONGEST_WAIT:
                    return None, "rate-limited"
                self.sleep(wait)
            except TooLarge:
                return None, "too-large"
            except Exception as e:  # noqa: BLE001  the hook is the user's code
                return None, f"failed: {e}"
            else:
                if self.store:
                    self._keep(text, answer)
                return answer, "answered"
        return None, "rate-limited"


def ask(prompts: DataFrame, call: Callable[[str], str], key: str = "chunk", text: str = "text", model: str = "", at_once: int | None = None, a_minute: float | None = None, kept: str | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, raw, outcome): what call answers to each prompt; one that fails has no answer, and its row stays to be seen.

    at_once: requests under way together, which is the number of tasks; a_minute: requests a minute of all of them, each
    task keeping its share of the pace. Both are the model's own where R.MODELS knows it. kept: see Caller. call raises
    RateLimited and TooLarge. Nothing calls this by default: without it, answers are an input table."""
    known = next((m for m in R.MODELS if m[0] == model), None)
    at_once = at_once or (known[5] if known else 1)
    a_minute = a_minute or (known[2] if known else None)
    pace = 60.0 * at_once / a_minute if a_minute else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(call, pace, kept, model, sleep)
        for b in batches:
            for k, t in zip(b[key], b[text]):  # row by row: what is answered goes on
                raw, outcome = caller.ask(t or "")
                yield pd.DataFrame({key: [k], "raw": [raw], "outcome": [outcome]})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, text).repartition(at_once).mapInPandas(run, f"`{key}` {kind}, raw string, outcome string")


def ask_in_halves(placed: DataFrame, render: Callable[[DataFrame], DataFrame], call: Callable[[str], str], budget: int, **options) -> DataFrame:
    """(chunk, part, raw, outcome) of chunks of files (placed: chunk, pos, ...): a chunk that the model finds too large is
    asked for in halves, and these once more. render: (chunk, part, text) of the rows of graph.split_chunks. What is too
    large even so stays as it is, with its outcome. Asking twice costs nothing where answers are kept."""
    refused = placed.sparkSession.createDataFrame([], f"chunk {placed.schema['chunk'].dataType.simpleString()}, part string")
    settled: DataFrame | None = None
    for depth in range(graph.HALF_DEPTH + 1):
        parts = render(graph.split_chunks(placed, refused, budget, depth))
        if settled is not None:
            parts = parts.join(settled.where("outcome <> 'too-large'").select("chunk", "part"), ["chunk", "part"], "left_anti")
        named = parts.withColumn("_key", F.struct("chunk", "part"))
        answers = scratch.settled(ask(named, call, key="_key", **options).select("_key.chunk", "_key.part", "raw", "outcome"), "answers")
        settled = answers if settled is None else settled.where("outcome <> 'too-large'").unionByName(answers)
        large = answers.where("outcome = 'too-large'").select("chunk", "part")
        if depth == graph.HALF_DEPTH or not large.limit(1).count():
            return settled
        refused = refused.unionByName(large)
    return settled
