"""Rules and lookup tables, as data.

Patterns are written for Java. Where another dialect's \\b is ASCII-only, B stands for it: Java's own is not."""

from __future__ import annotations

from dataclasses import dataclass

#: An ASCII word boundary.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


@dataclass(frozen=True)
class Rule:
    """A pattern over whole contents. sql is the same pattern for an engine without lookaround, whose \\b is ASCII."""

    name: str
    pattern: str
    type: str
    severity: str
    description: str
    extensions: tuple[str, ...] = ()
    #: A match holds one of these (any: none are known). They are looked for first, since that costs a fraction.
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        return self.pattern.replace(r"\b", B)

    @property
    def sql(self) -> str:
        return self.pattern


TS = (".ts", ".tsx")
SCRIPT = (".ts", ".tsx", ".js", ".jsx")
PY = (".py",)

# The rules that match without help from a model, in their order.
RULES = (
    Rule("secret_assignment", r"(?i)(?:password|passwd|secret|api_key|apikey|auth_token)\s*[=:]\s*['\"][^'\"]{8,}['\"]", "security", "critical", "Hardcoded secret or password", needs=("password", "passwd", "secret", "api_key", "apikey", "auth_token")),
    Rule("token_literal", r"['\"](?:sk[-_]|pk[-_]|key[-_]|ghp_|gho_|ghs_|github_pat_|glpat-|xox[bpsar]-|AKIA)[A-Za-z0-9_\-]{16,}['\"]", "security", "critical", "Hardcoded API key or token", needs=("sk", "pk", "key", "gh", "github", "glpat", "xox", "AKIA")),
    Rule("eval_input", r"(?i)\beval\s*\([^)]*(?:req|request|input|user|data|param|query|body)", "security", "critical", "eval() called on user-controlled input", needs=("eval",)),
    Rule("exec_input", r"(?i)\bexec\s*\([^)]*(?:req|request|input|user|data|param|query|body)", "security", "critical", "exec() called on user-controlled input", PY, needs=("exec",)),
    Rule("raw_html", r"\bdangerouslySetInnerHTML\b", "security", "high", "dangerouslySetInnerHTML usage — verify input is sanitized", (".tsx", ".jsx", ".js", ".ts"), needs=("dangerouslySetInnerHTML",)),
    Rule("os_system", r"\bos\.system\s*\(", "security", "high", "os.system() is vulnerable to shell injection — use subprocess with shell=False", PY, needs=("os.system",)),
    Rule("todo_marker", r"\b(?:TODO|FIXME|HACK|XXX)\b[:\s]*.{0,80}", "stubs", "medium", "TODO/FIXME marker", needs=("TODO", "FIXME", "HACK", "XXX")),
    Rule("not_implemented_py", r"raise\s+NotImplementedError", "stubs", "medium", "NotImplementedError — stub implementation", PY, needs=("NotImplementedError",)),
    Rule("not_implemented_js", r"(?i)throw\s+new\s+Error\s*\(\s*['\"]not\s+implemented", "stubs", "medium", 'Stub: throws "not implemented"', SCRIPT, needs=("implemented",)),
    Rule("console_log", r"\bconsole\.log\s*\(", "lint", "low", "console.log() left in code", SCRIPT, needs=("console.log",)),
    Rule("debugger", r"\bdebugger\b", "lint", "medium", "debugger statement left in code", SCRIPT, needs=("debugger",)),
    Rule("explicit_any", r":\s*any\b", "types", "medium", "Explicit `any` type — consider using a specific type", TS, needs=("any",)),
    Rule("as_any", r"\bas\s+any\b", "types", "medium", "Unsafe cast to `any` — consider using a specific type", TS, needs=("any",)),
)


@dataclass(frozen=True)
class Hotspot:
    """A pattern over single lines. sql: the same for an engine without lookaround, where the pattern needs another form."""

    label: str
    pattern: str
    extensions: tuple[str, ...] = ()
    other: str | None = None
    needs: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        return self.pattern.replace(r"\b", B).replace("$", r"\z") if self.pattern.endswith("$") else self.pattern.replace(r"\b", B)

    @property
    def sql(self) -> str:
        return self.other or self.pattern


# Lines worth a look, in their order.
HOTSPOTS = (
    Hotspot("EVAL", r"\beval\s*\(", needs=("eval",)),
    Hotspot("EXEC", r"\bexec\s*\(", needs=("exec",)),
    Hotspot("SHELL", r"\bos\.system\s*\(", PY, needs=("os.system",)),
    Hotspot("SUBPROCESS", r"\bsubprocess", PY, needs=("subprocess",)),
    Hotspot("CHILD_PROC", r"\bchild_process", (".ts", ".js"), needs=("child_process",)),
    Hotspot("RAW_HTML", r"dangerouslySetInnerHTML", (".tsx", ".jsx"), needs=("dangerouslySetInnerHTML",)),
    Hotspot("RAW_HTML", r"innerHTML\s*=", needs=("innerHTML",)),
    Hotspot("SQL_FSTRING", r"(?i)f[\"'][^\"']*(?:SELECT|INSERT|UPDATE|DELETE)\b", PY, needs=("f\"", "f'")),
    Hotspot("SQL_TEMPLATE", r"(?i)`[^`]*(?:SELECT|INSERT|UPDATE|DELETE)\b[^`]*\$\{", (".ts", ".js"), needs=("`",)),
    Hotspot("RAW_QUERY", r"\.raw\s*\(|\.execute\s*\(", needs=(".raw", ".execute")),
    Hotspot("EMPTY_EXCEPT", r"except\s*(?:\w+\s*)?:\s*(?:pass|\.\.\.)\s*$", PY, needs=("except",)),
    Hotspot("EMPTY_CATCH", r"catch\s*\([^)]*\)\s*\{\s*\}", needs=("catch",)),
    Hotspot("HARDCODED_SECRET", r"(?:password|secret|api_key|token)\s*[=:]\s*['\"][^'\"]{6,}", needs=("password", "secret", "api_key", "token")),
    Hotspot("STUB", r"\bTODO\b|\bFIXME\b|\bHACK\b|\bXXX\b", needs=("TODO", "FIXME", "HACK", "XXX")),
    Hotspot("NOT_IMPL", r"(?i)NotImplementedError|not.implemented", needs=("implemented",)),
    Hotspot("ANY_TYPE", r":\s*any\b|as\s+any\b", TS, needs=("any",)),
    Hotspot("TYPE_IGNORE", r"type:\s*ignore", PY, needs=("ignore",)),
    Hotspot("CONSOLE_LOG", r"console\.log\s*\(", SCRIPT, needs=("console.log",)),
    # A print( with no file= after it: that is the last one of the line.
    Hotspot("PRINT", r"\bprint\s*\((?!.*file\s*=)", PY, needs=("print",)),
    Hotspot("DEBUGGER", r"\bdebugger\b", SCRIPT, needs=("debugger",)),
)

# Signatures by file kind; the first that matches a line (without leading white space) wins. name, params
# and returns are group numbers; 0: none. returns may name two groups, the first that is not empty counts.
SIGNATURES = (
    ("fn", PY, r"^(async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*(.+?))?:", 2, 3, (4,)),
    ("class", PY, r"^class\s+(\w+)(?:\(([^)]*)\))?:", 1, 2, ()),
    ("fn", SCRIPT, r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?::\s*([^{]+?))?(?:\s*\{|$)", 1, 2, (3,)),
    ("class", SCRIPT, r"^(?:export\s+)?class\s+(\w+)", 1, 0, ()),
    ("fn", SCRIPT, r"^(?:export\s+)?const\s+(\w+)\s*(?::\s*([^=]+?))?\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::\s*([^=>{]+?))?(?:\s*=>|$)", 1, 3, (4, 2)),
    ("fn", SCRIPT, r"^(?:export\s+)?const\s+(\w+)\s*(?::\s*([^=]+?))?\s*=\s*(?:async\s*)?\(", 1, 0, (2,)),
    ("type", SCRIPT, r"^(?:export\s+)?(?:interface|type)\s+(\w+)", 1, 0, ()),
    ("fn", (".go",), r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)\s*([^{]*)", 1, 2, (3,)),
    ("type", (".go",), r"^type\s+(\w+)\s+(?:struct|interface)", 1, 0, ()),
    ("fn", (".java", ".kt"), r"(?:public|private|protected)\s+(?:static\s+)?(\w[\w<>,\s]*?)\s+(?!(?:if|for|while|switch|catch)\s*\()(\w+)\s*\(([^)]*)\)\s*(?:throws\s+\w+\s*)?[{]", 2, 3, (1,)),
    ("fn", (".java", ".kt"), r"(?:(?:public|private|internal|override)\s+)?(?:suspend\s+)?fun\s+(\w+)\s*\(([^)]*)\)\s*(?::\s*(\S+))?", 1, 2, (3,)),
    ("fn", (".rs",), r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?(?:\s*(?:where\s|\{)|$)", 1, 2, (3,)),
    ("type", (".rs",), r"^(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", 1, 0, ()),
)

# What a claim about security must find near its line. A claim is judged by the first family of which it
# has a keyword (every word list of `keywords` must have one); all `needs` must match the region.
EVIDENCE = (
    (((("hardcoded", "password", "secret", "api key", "credential"),)), (r"(?i)(?:password|passwd|secret|api_key|apikey|auth_token|credential)\s*[=:]\s*['\"][^'\"]{4,}",)),
    ((("xss", "cross-site", "innerhtml"),), (r"(?i)(?:\.innerHTML\s*=|dangerouslySetInnerHTML|document\.write\s*\()",)),
    ((("sql",), ("injection",)), (r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|DROP)\b", r"(?i)(?:\$\{|%s|\+\s*['\"])")),
    ((("log",), ("sensitive", "password", "token", "secret")), (r"(?i)(?:console\.log|console\.info|console\.debug|logger\.\w+|log\.\w+|print\s*\()", r"(?i)(?:password|token|secret|credential|api_key|private_key)")),
    ((("command injection", "shell injection"),), (r"(?i)(?:exec\s*\(|spawn\s*\(|system\s*\(|os\.system|subprocess)",)),
)

# Names, ranks, weights.
TYPES = ("security", "bugs", "types", "lint", "dead-code", "stubs", "duplicates", "coverage")
SEVERITIES = ("critical", "high", "medium", "low")
PENALTY = {"critical": 10, "high": 5, "medium": 2, "low": 1}
RANK_UP = {"low": 0, "medium": 1, "high": 2, "critical": 3}
RANK_DOWN = {"critical": 0, "high": 1, "medium": 2, "low": 3}
COMMIT_PREFIX = {"security": "fix", "bugs": "fix", "types": "fix", "lint": "style", "dead-code": "chore", "stubs": "fix", "duplicates": "refactor", "coverage": "test"}
SEVERITY_ICON = {"critical": "\U0001f534", "high": "\U0001f7e0", "medium": "\U0001f7e1", "low": "\U0001f535"}
TYPE_ICON = {"security": "\U0001f512", "bugs": "\U0001f41b", "types": "\U0001f4dd", "lint": "\U0001f9f9", "dead-code": "\U0001f480", "stubs": "\U0001f3d7️", "duplicates": "\U0001f4cb", "coverage": "\U0001f9ea"}
GRADES = ((90, "A", "Excellent", "\U0001f7e2", "brightgreen"), (70, "B", "Good", "\U0001f535", "green"), (50, "C", "Fair", "\U0001f7e1", "yellow"), (30, "D", "Poor", "\U0001f7e0", "orange"), (None, "F", "Critical", "\U0001f534", "red"))

# Models with their daily requests, requests a minute, input and output tokens, concurrency, tier.
MODELS = (
    ("openai/gpt-4o", 50, 10, 8000, 4000, 2, "high"),
    ("openai/gpt-4o-mini", 50, 10, 8000, 4000, 2, "high"),
    ("mistral-ai/mistral-small-2503", 150, 15, 8000, 4000, 5, "low"),
    ("meta/llama-3.3-70b-instruct", 150, 15, 8000, 4000, 5, "low"),
    ("meta/meta-llama-3.1-8b-instruct", 150, 15, 8000, 4000, 5, "low"),
)
DEFAULT_LIMIT, OVERHEAD_TOKENS, LEAST_CODE_TOKENS, CHARS_PER_TOKEN = 8000, 500, 1000, 3.2

# Which files are code.
CODE_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".py", ".rb", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".swift", ".kt", ".scala", ".vue", ".svelte", ".html", ".css", ".scss", ".sql", ".sh",
    ".yaml", ".yml", ".json", ".toml", ".xml", ".dockerfile",
)
CODE_NAMES = ("Dockerfile", "Makefile", "Rakefile", "Gemfile", "Procfile", "Vagrantfile", "Jenkinsfile", "Brewfile")
#: Directories left out; other names that start with a dot are left out too, but for .github.
IGNORED_DIRS = ("node_modules", ".git", "dist", "build", "out", ".next", "vendor", "__pycache__", ".venv", "venv", "target", "coverage")
