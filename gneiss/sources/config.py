"""Configuration text: a small part of YAML, plug-in manifests, repository settings, and which setting wins."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from gneiss.functions import rules as R
from gneiss.operators.policy import Filters, merge_filters, usable_rules

Value = str | list | dict

def unquoted(s: str) -> str:
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"" else s


@dataclass
class _Entry:
    """A line as indentation, an item's dash, a key if it has one, and what is after the colon (all, without a key)."""

    indented: bool
    item: bool
    key: str | None
    value: str


def _entry(raw: str) -> _Entry:
    body = raw.strip()
    indented, item = raw[:1].isspace(), False
    if indented and body[:1] == "-" and raw.lstrip()[1:2].isspace():
        body, item = body[1:].strip(), True
    key, colon, value = body.partition(":")
    key = key.rstrip()
    letters = key.replace("-", "").replace("_", "")
    plain = letters.isascii() and (key[:1] not in ("", "-") and (letters + "x").isalnum() if item else bool(key) and (letters + "x").isalpha())
    return _Entry(indented, item, key, value.strip()) if colon and plain else _Entry(indented, item, None, body)


def _block(lines: list[str]) -> tuple[str, list[str]]:
    """The text of a | block at the start of lines, two spaces less deep, and the lines after it."""
    n = next((i for i, x in enumerate(lines) if x.strip() and not x.startswith(("  ", "\t"))), len(lines))
    return "\n".join(x.removeprefix("  ") for x in lines[:n]).rstrip(), lines[n:]


def _value(key: str, value: str, lines: list[str]) -> Value | None:
    """What a key stands for: the value beside it, or the items or the keys in the lines below it, the latter if both."""
    found: Value | None = {"[]": [], "": None}.get(value, unquoted(value))
    if value == "|":
        found, lines = _block(lines)
    items: list = []
    keys: dict = {}
    while lines:
        raw, lines = lines[0], lines[1:]
        if not raw.strip() or raw.strip().startswith("#"):
            continue
        e = _entry(raw)
        if e.item:
            items.append(unquoted(e.value) if e.key is None else {e.key: unquoted(e.value)})
        elif e.key is not None and items and isinstance(items[-1], dict):
            items[-1][e.key] = unquoted(e.value)
        elif e.key is not None and e.value == "|":
            keys[key], lines = _block(lines)  # a block below a key belongs to the outer key
        elif e.key is not None:
            keys[e.key] = unquoted(e.value)
    return keys or items or found


def parse_yaml(text: str) -> dict[str, Value]:
    """Scalars, lists, one level of nesting, and | blocks. A comment after a value is part of it; [a, b] is a string."""
    parts: list[tuple[str, str, list[str]]] = [("", "", [])]
    for raw in text.split("\n"):
        e = _entry(raw)
        if e.indented or e.key is None or raw.startswith("#"):
            parts[-1][2].append(raw if e.indented or not raw.strip() else "#")  # other text at the margin says nothing
        else:
            parts.append((e.key, e.value, []))
    values = ((key, _value(key, value, lines)) for key, value, lines in parts)
    return {key: v for key, v in values if v is not None}


@dataclass
class Plugin:
    name: str
    prompt: str = ""
    rules: tuple[R.Rule, ...] = ()
    filters: Filters = Filters()
    hooks: dict[str, str] = field(default_factory=dict)


HOOKS = ("pre-scan", "post-scan", "pre-fix", "post-fix")


def plugin_from(text: str, name: str) -> Plugin:
    data = parse_yaml(text)
    rows = [p for p in data.get("patterns", []) if isinstance(p, dict) and p.get("regex")] if isinstance(data.get("patterns"), list) else []
    rules = [
        R.Rule(name, p["regex"], p.get("type") or "lint", p.get("severity") or "medium", p.get("description", ""), tuple(x.strip() for x in p["extensions"].split(",")) if p.get("extensions") else ())
        for p in rows
    ]
    f = data.get("filters") if isinstance(data.get("filters"), dict) else {}
    lists = {k: tuple(f[k]) for k in ("exclude-paths", "exclude-types") if isinstance(f.get(k), list)}
    hooks = data.get("hooks") if isinstance(data.get("hooks"), dict) else {}
    return Plugin(
        str(data.get("name") or name), str(data.get("prompt") or ""), usable_rules(rules),
        Filters(lists.get("exclude-paths", ()), lists.get("exclude-types", ()), f.get("min-severity") or None), {k: hooks[k] for k in HOOKS if hooks.get(k)},
    )


def load_plugins(root: str) -> list[Plugin]:
    """Plug-ins of a folder on the driver: <name>/plugin.yml, or <name>.yml."""
    place = Path(root)
    if not place.is_dir():
        return []
    found = []
    for p in sorted(place.iterdir()):
        file = p / "plugin.yml" if p.is_dir() else p
        if file.is_file() and file.suffix in (".yml", ".yaml") and (p.is_dir() or p.name != "plugin.yml"):
            found.append(plugin_from(file.read_text("utf-8"), p.name if p.is_dir() else p.stem))
    return found


@dataclass
class Context:
    prompt: str
    rules: tuple[R.Rule, ...]
    filters: Filters


def plugin_context(plugins: list[Plugin], prompt: str = "") -> Context:
    """All plug-ins as one: prompts joined by blank lines, rules in order, filters merged."""
    return Context("\n\n".join(x for x in (prompt, *(p.prompt for p in plugins)) if x), tuple(r for p in plugins for r in p.rules), merge_filters([p.filters for p in plugins]))


def custom_prompt(inline: str, *files: str) -> str:
    """The inline text and the files' texts that are there, joined by blank lines."""
    texts = [inline, *(Path(f).read_text("utf-8") for f in files if f and Path(f).is_file())]
    return "\n\n".join(t.strip() for t in texts if t.strip())


# What settings may be. Whole numbers have a least and, some, a greatest value.
_CHOICES = {
    "strictness": ("low", "medium", "high"), "min-severity": R.SEVERITIES, "mode": ("scan", "fix"), "agent": ("claude", "codex"),
    "scan-scope": ("auto", "pr", "full"), "scan-provider": ("github-models", "agent"),
}
_NUMBERS = {
    "fail-below": (0, 100), "max-passes": (1, None), "min-passes": (1, None), "max-chains": (0, None), "max-turns": (1, None), "max-issues-per-pass": (0, None), "parallel-agents": (1, 8),
}
_TEXTS = ("timeout", "max-cost", "github-models-model", "custom-prompt", "custom-prompt-file", "test-command", "framework", "runtime")
_TEXTS_OR_EMPTY = ("model", "output-file")
_APP = {
    "type": ("web-app", "api", "cli", "library", "worker", "mobile", "desktop"), "exposure": ("public", "internal", "local"), "network": ("internet", "vpn", "localhost"), "data-sensitivity": ("high", "medium", "low"),
}


def _whole(text: Value, least: int, most: int | None) -> int | None:
    """The number that a text begins with, if it is in bounds."""
    m = re.match(r"\s*([+-]?[0-9]+)", text) if isinstance(text, str) else None
    return n if m and (n := int(m[1])) >= least and (most is None or n <= most) else None


def _app(given: Value) -> dict[str, str | bool]:
    """What is said of the application: known kinds alone, whether users log in, how sensitive its data are."""
    if not isinstance(given, dict):
        return {}
    given = {**given, "data-sensitivity": given.get("data-sensitivity") or given.get("dataSensitivity")}
    out: dict[str, str | bool] = {k: v.lower() for k, choices in _APP.items() if isinstance(v := given.get(k), str) and v.lower() in choices}
    return out | ({"auth": str(given["auth"]).lower() == "true"} if "auth" in given else {})


def _texts(given: Value, choices: tuple[str, ...] = ()) -> list[str] | None:
    if not isinstance(given, list):
        return None
    return [x for x in given if isinstance(x, str) and x.strip() and (not choices or x.strip() in choices)]


def repo_settings(text: str) -> dict[str, Value]:
    """Settings that are valid, by their names in the file; others are left out, so that what they set stays as it was.

    trusted and untrusted are the lists trust-internal and trust-untrusted; allow is a list of pattern and reason."""
    data = parse_yaml(text)
    rules = {k: v.lower() for k, v in data["rules"].items() if k in R.TYPES and v.lower() in ("off", *R.SEVERITIES)} if isinstance(data.get("rules"), dict) else {}
    allow = [{"pattern": r["pattern"], "reason": r.get("reason") or ""} for r in data["allow"] if isinstance(r, dict) and r.get("pattern")] if isinstance(data.get("allow"), list) else []
    out: dict[str, Value | None] = {
        "ignore": _texts(data.get("ignore")), "fix-types": _texts(data.get("fix-types"), R.TYPES), "trusted": _texts(data.get("trust-internal")), "untrusted": _texts(data.get("trust-untrusted")),
        "rules": rules or None, "allow": allow or None, "app": _app(data.get("app")) or None,
    }
    out |= {k: v.lower() if isinstance(v := data.get(k), str) and v.lower() in choices else None for k, choices in _CHOICES.items()}
    out |= {k: _whole(data.get(k), *bounds) for k, bounds in _NUMBERS.items()}
    out |= {k: v if isinstance(v := data.get(k), str) and (v or k in _TEXTS_OR_EMPTY) else None for k in (*_TEXTS, *_TEXTS_OR_EMPTY)}
    if isinstance(data.get("verbose"), str):
        out["verbose"] = data["verbose"].lower() == "true"
    if isinstance(data.get("plugins"), str):
        out["plugins"] = data["plugins"].lower() != "false"
    return {k: v for k, v in out.items() if v is not None}


def first_text(paths: list[str]) -> str | None:
    """The text of the first file that is there."""
    return next((Path(p).read_text("utf-8") for p in paths if Path(p).is_file()), None)


def repository_text(root: str, name: str) -> str | None:
    """The settings of a repository: .name.yml or .yaml, else config.yml or .yaml in the folder .name."""
    return first_text([f"{root}/.{name}.yml", f"{root}/.{name}.yaml", f"{root}/.{name}/config.yml", f"{root}/.{name}/config.yaml"])


def profile_text(root: str, name: str, profile: str) -> str | None:
    """A profile's settings, from the folder .name/profiles; None if it is not named or not there."""
    return first_text([f"{root}/.{name}/profiles/{profile}{end}" for end in (".yml", ".yaml")]) if profile else None


def repository_settings(root: str, name: str, profile: str = "") -> dict[str, Value]:
    """What a repository sets, with what a profile sets over it."""
    own, over = repository_text(root, name), profile_text(root, name, profile)
    return {**(repo_settings(own) if own is not None else {}), **(repo_settings(over) if over is not None else {})}


def settled(explicit: dict, profile: dict, repo: dict, defaults: dict) -> dict:
    """Each setting from the first of the four that has it; a value equal to its default counts as not given."""
    given = {k: v for k, v in explicit.items() if v != defaults.get(k)}
    return {**defaults, **repo, **profile, **given}
