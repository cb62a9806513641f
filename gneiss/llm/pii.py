"""Personal data by a semi-Markov conditional random field: whole-span features score candidate segments, and dynamic
programming over bounded entities chooses boundaries and types jointly. Exact base patterns always stay."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import by_batch

#: Kinds with base patterns, in the order in which spans are listed, and kinds that only the model finds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "iban")
KINDS = BASE + ADDED
#: Bounds of an entity: tokens, characters (of an address; the others end earlier), digits, letters and digits of an IBAN.
LONGEST, LENGTH = 64, 254
DIGITS, IBAN = (7, 24), (15, 34)
#: Sentences that the weights are learned from (generated here, the same each time), and passes over them.
SENTENCES, PASSES = 1200, 3

# Base patterns, written so that they take linear time: a run that fails is not tried again from its inside, where it
# would fail too, and an address is looked for from its @.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All base matches, by kind as listed, then start."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: What every candidate segment holds (see _ends): seven digits close together; two letters and two digits; a dot in letters;
#: an at before a dotted name. The model need not see text farther than LENGTH from all of these.
_TRIGGER = re.compile(
    r"[0-9](?:[\x20().+/-]{0,4}[0-9]){6}"
    r"|(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=[A-Za-z0-9]|\x20[A-Za-z0-9])"
    r"|\bdot\b"
    r"|(?:\bat\b|(?<=\s)@|@(?=\s))\s*[\])}]?\s*[A-Za-z0-9-]++\.[A-Za-z0-9]",
    re.I,
)
_SYMBOLS, _OPEN, _CLOSE, _JOINS = frozenset("().+/-"), frozenset("([{"), frozenset(")]}"), frozenset("_+%")


@dataclass
class Sentence:
    text: str
    tokens: list[tuple[int, int]]
    words: list[str]

    @classmethod
    def of(cls, text: str) -> Sentence:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        return cls(text, tokens, [text[a:b] for a, b in tokens])

    def gap(self, j: int) -> str:
        """What is between token j and the one before."""
        return self.text[self.tokens[j - 1][1] : self.tokens[j][0]]


#: Words of the languages trained on that tell of a kind, and the top-level names that a bare address mostly has.
_CUES = {
    "email": {"mail", "email", "write", "address", "contact", "correo", "courriel", "schreiben", "escriba"},
    "ip": {"ip", "host", "server", "address", "from"},
    "card": {"card", "visa", "credit", "paid", "carte", "karte", "kreditkarte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "dial", "contact", "rufen", "appelez", "llame", "number", "handy"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
}
_BETWEEN = re.compile(r"[\x20().+/-]{1,4}")
_TOPS = frozenset("com org net edu gov io de fr es uk eu info it nl ch at be pl cz se no dk fi pt ie jp cn br us ca au nz me co".split())
_NATIONAL = re.compile(r"\(?[2-9][0-9]{2}\)?[\x20.\-/]{0,2}[2-9][0-9]{2}[\x20.-][0-9]{4}")
_INTERNATIONAL = re.compile(r"\+[1-9][0-9]{0,2}[\x20().0-9-]{6,18}[0-9]")
_ABROAD = re.compile(r"00[1-9][0-9]{0,2}[\x20().0-9-]{5,20}[0-9]")
_TRUNK = re.compile(r"\(?0[1-9][0-9]{1,4}\)?[\x20/-]{0,3}[0-9]{3,8}(?:[\x20-][0-9]{2,5}){0,2}")
_PAIRS = re.compile(r"0[1-9](?:[\x20.-][0-9]{2}){4}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")


# How many characters an IBAN of a country has.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def iban_valid(s: str) -> bool:
    """Whether the check digits are right, and the length where the country's is known."""
    flat = re.sub(r"\s", "", s).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", flat, re.A) or len(flat) != IBAN_LENGTHS.get(flat[:2], len(flat)):
        return False
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _plain_number(w: str) -> bool:
    return w.isascii() and w.isdigit()


def _neighbours(s: Sentence, blocked: list[bool]) -> tuple[list[bool], list[bool]]:
    """For each token whether another number comes shortly before its first digit, and shortly after its last one."""
    n = len(s.tokens)
    before, after, last = [False] * n, [False] * n, -1
    for j, w in enumerate(s.words):
        if not blocked[j] and _plain_number(w):
            if last >= 0 and s.tokens[j][0] - s.tokens[last][1] <= 4 and _BETWEEN.fullmatch(s.text, s.tokens[last][1], s.tokens[j][0]):
                after[last] = before[j] = True
            last = j
    for j in range(n - 2, -1, -1):
        if s.words[j] in _SYMBOLS:
            before[j] = before[j + 1]
    return before, after


def _digit_ends(s: Sentence, i: int, blocked: list[bool], before: list[bool], after: list[bool]) -> Iterator[int]:
    """Ends of segments of digits, spaces and ().+/- with as many digits as DIGITS says and four other characters between
    two at most. Numbers of one digit are few in them (not every second one), and they are no inner part of a longer row."""
    count, groups, last = 0, 0, s.tokens[i][0]
    for j in range(i, min(len(s.tokens), i + LONGEST)):
        w = s.words[j]
        if blocked[j] or (j > i and s.gap(j).strip(" ")):
            return
        if _plain_number(w):
            count += len(w)
            groups += 1
            if count > DIGITS[1] or s.tokens[j][0] - last > 4:
                return
            last = s.tokens[j][1]
            if count >= max(DIGITS[0], 2 * groups - 1) and not (before[i] and after[j]):
                yield j + 1
        elif w not in _SYMBOLS:
            return


def _iban_ends(s: Sentence, i: int, blocked: list[bool]) -> Iterator[int]:
    """Ends of segments of letters and digits, single spaces between, that begin with two letters and two digits."""
    count = 0
    for j in range(i, min(len(s.tokens), i + LONGEST)):
        w = s.words[j]
        if blocked[j] or not (w.isascii() and w.isalnum()) or (j > i and s.gap(j) != " "):
            return
        count += len(w)
        if count > IBAN[1]:
            return
        if count >= IBAN[0]:
            yield j + 1


def _mark(s: Sentence, k: int) -> tuple[str, int] | None:
    """What joins the word before token k to a next one: at, dot, join, or local (before an at only), and the token after it. A word at or dot may be in
    brackets; an @ has space about it, other marks have none."""
    n = len(s.tokens)
    opened = k < n and s.words[k] in _OPEN
    j = k + opened
    if j >= n:
        return None
    w = s.words[j].lower()
    if w in ("at", "dot"):
        after = j + 1 + (j + 1 < n and s.words[j + 1] in _CLOSE)
        return (w, after) if "\n" not in s.text[s.tokens[k - 1][1] : s.tokens[min(after, n - 1)][0]] else None
    if opened or j + 1 >= n:
        return None
    if w == "@":
        space = s.gap(j) + s.gap(j + 1)  # without any, it is a base pattern's
        return ("at", j + 1) if space and "\n" not in space else None
    if s.gap(j) or s.gap(j + 1):
        return None
    return ("dot", j + 1) if w == "." else ("join", j + 1) if w == "-" else ("local", j + 1) if w in _JOINS else None


def _address_ends(s: Sentence, i: int, blocked: list[bool]) -> Iterator[int]:
    """Ends of segments that read word, mark, word, mark, ... with one at, and a dot somewhere behind it."""
    j, at, dots = i, False, 0
    while j < len(s.tokens) and j < i + LONGEST and s.tokens[j][1] - s.tokens[i][0] <= LENGTH:
        if blocked[j] or not (s.words[j].isascii() and s.words[j].isalnum()):
            return
        if at and dots:
            yield j + 1
        found = _mark(s, j + 1)
        if not found or any(blocked[j + 1 : found[1]]) or (at and found[0] in ("at", "local")):
            return
        at |= found[0] == "at"
        dots += found[0] == "dot" and at
        j = found[1]


def _ends(s: Sentence, i: int, blocked: list[bool], before: list[bool], after: list[bool]) -> Iterator[int]:
    """Where the candidate segments that begin at token i end."""
    w = s.words[i]
    if w in "+(" or _plain_number(w):
        yield from _digit_ends(s, i, blocked, before, after)
    elif re.match(r"[A-Za-z]{2}[0-9]{2}", w):
        yield from _iban_ends(s, i, blocked)
    if w.isascii() and w.isalnum():
        yield from _address_ends(s, i, blocked)


def span_features(s: Sentence, i: int, j: int) -> list[str]:
    """Features of tokens i to j (exclusive) as one whole, and of what is beside it."""
    start, end = s.tokens[i][0], s.tokens[j - 1][1]
    text, before, after = s.text[start:end], s.text[max(0, start - 10) : start], s.text[end : end + 10]
    groups = [len(g) for g in re.findall(r"[0-9]+", text)]
    n = sum(groups)
    f = ["bias"]
    if not re.search(r"[^0-9\x20().+/-]", text):
        rest = re.sub(r"[0-9]", "", text)
        f += [f"digits={n}", f"groups={'-'.join(map(str, groups[:6]))}", f"separators={''.join(sorted(set(rest)))}", "open" if rest.count("(") != rest.count(")") else "closed"]
        f += [name for name, shape in (("national", _NATIONAL), ("trunk", _TRUNK), ("pairs", _PAIRS), ("ssn-shape", _SSN)) if shape.fullmatch(text)]
        if _TRUNK.fullmatch(text) or _PAIRS.fullmatch(text):
            f.append(f"trunk-parted={len(groups) > 1},{9 <= n <= 12}")
        if 8 <= n <= 15 and _INTERNATIONAL.fullmatch(text):
            f.append("international")
        if 9 <= n <= 17 and _ABROAD.fullmatch(text):
            f.append("abroad")
        if n >= 13:
            f.append(f"luhn={luhn(_digits(text))}")
        f.append("digits-before" if re.search(r"[0-9][\x20().+/-]{1,4}$", before) else "none-before")
        f.append("digits-after" if re.match(r"[\x20().+/-]{1,4}[0-9]", after) else "none-after")
    elif re.match(r"[A-Za-z]{2}[0-9]{2}", text) and text.replace(" ", "").isalnum():
        f += [f"iban={iban_valid(text)}"]
    else:
        words = [w.lower() for w in s.words[i:j]]
        bracket, top = any(w in _OPEN | _CLOSE for w in words), words[-1] in _TOPS
        f += ["address", f"brackets={bracket},top={top}", f"spelled={'dot' in words},top={top}", "letters" if words[-1].isalpha() and len(words[-1]) > 1 else "no-name"]
        goes_on = _mark(s, j) if j < len(s.tokens) else None
        f.append("address-goes-on" if goes_on and goes_on[0] == "dot" and goes_on[1] < len(s.tokens) and s.words[goes_on[1]][0].isalnum() else "address-ends")
        f.append("address-cut" if re.search(r"\w\s?[\[(]?\s?(?:\bdot\s?[\])]?\s?|[._%+-])$", before, re.I) else "address-begins")
    f.append("joined-left" if re.search(r"[\w.+@/-]$", before) else "free-left")
    f.append("joined-right" if re.match(r"[\w@/+-]|\.\w", after) else "free-right")
    near = {w.lower() for w in s.words[max(0, i - 4) : i]}
    f += [f"cue={k}" for k, c in _CUES.items() if near & c]
    return f


Weights = dict[tuple[str, str], float]


def _score(w: Weights, kind: str, features: list[str]) -> float:
    return sum(w.get((kind, f), 0.0) for f in features)


def _segments(s: Sentence, blocked: list[bool]) -> dict[int, list[tuple[int, list[str]]]]:
    """end: [(start, features)] of the candidate segments."""
    found: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
    before, after = _neighbours(s, blocked)
    for i in range(len(s.tokens)):
        for j in dict.fromkeys(_ends(s, i, blocked, before, after)):
            found[j].append((i, span_features(s, i, j)))
    return found


def viterbi(s: Sentence, w: Weights, blocked: list[bool]) -> list[tuple[str, int, int]]:
    """The best way to part the tokens into entities and single tokens outside (which score 0)."""
    ends = _segments(s, blocked)
    best, back = [0.0], [None]
    for j in range(1, len(s.tokens) + 1):
        top, how = best[j - 1], None
        for i, features in ends.get(j, ()):
            for kind in KINDS:
                v = best[i] + _score(w, kind, features)
                if v > top:
                    top, how = v, (kind, i)
        best.append(top)
        back.append(how)
    out, j = [], len(s.tokens)
    while j:
        if back[j]:
            kind, i = back[j]
            out.append((kind, i, j))
            j = i
        else:
            j -= 1
    return out[::-1]


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _gradient(s: Sentence, gold: set[tuple[str, int, int]], w: Weights) -> dict[tuple[str, str], float]:
    """Observed less expected features: forward and backward sums over all ways to part the sentence."""
    ends = _segments(s, [False] * len(s.tokens))
    arcs = [(i, j, k, f, _score(w, k, f)) for j, rows in ends.items() for i, f in rows for k in KINDS]
    n = len(s.tokens)
    into, out = defaultdict(list), defaultdict(list)
    for a in arcs:
        into[a[1]].append(a)
        out[a[0]].append(a)
    forward = [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = _log_add([forward[j - 1], *[forward[a[0]] + a[4] for a in into[j]]])
    backward = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        backward[i] = _log_add([backward[i + 1], *[backward[a[1]] + a[4] for a in out[i]]])
    slope: dict[tuple[str, str], float] = defaultdict(float)
    for i, j, kind, features, score in arcs:
        share = math.exp(forward[i] + score + backward[j] - forward[n])
        change = ((kind, i, j) in gold) - share
        if abs(change) > 1e-6:
            for f in features:
                slope[kind, f] += change
    return slope


# What the weights are learned from: sentences with a place for an entity of a kind, for one of any kind, or for what only
# looks like one. Made for this purpose; the tests have others.
_SENTENCES = {
    "phone": (
        "You can reach the office by phone at {} on weekdays.", "Rufen Sie uns bitte unter {} an, wenn etwas fehlt.", "Appelez le {} pour confirmer le rendez-vous.", "Llame al {} antes de las nueve.",
        "My new mobile number is {}, please pass it on.", "Tel. {}", "Der Arzt hat die Nummer {} hinterlassen.", "If nobody answers, try {} instead.", "Fax: {} (only in the morning)",
    ),
    "email": (
        "For questions write to {} and we will answer soon.", "Schreiben Sie bitte an {}, falls Sie Fragen haben.", "Envoyez votre dossier à {} avant vendredi.", "Escriba a {} para recibir la lista.",
        "The author can be contacted by mail: {}", "Bugs go to {}, patches too.", "Send the form back to {} by Monday.",
    ),
    "ssn": ("Her social security number is {} according to the form.", "SSN: {}", "The clerk wrote {} next to the name.", "Applicants with {} on file need not come again."),
    "iban": ("Please transfer the rent to {} by the third.", "Die Überweisung geht auf das Konto {} bei der Sparkasse.", "Le virement a été fait sur le compte {} hier.", "La cuenta es {} y está a mi nombre.", "IBAN {}"),
    "card": ("The order was paid with card {} last month.", "Die Kreditkarte {} wurde gesperrt.", "Ma carte, {}, ne marche plus.", "The number on the back was {}, he said."),
    "any": ("{}", "Note: {}.", "It said ({}) and nothing else.", "Somebody had written {} on the wall, then left.", "See {}; the rest is known."),
    "none": (
        "The invoice dates from {}, as the clerk noted.", "Version {} mends the problem for good.", "Order {} left the warehouse yesterday.", "The file has {} bytes in all.", "Das Paket {} ist unterwegs.",
        "Le chapitre {} donne les résultats.", "El informe {} no dice nada de eso.", "We counted {} of them before noon.", "The book ({}) is out of print.", "Die Rechnung {} ist noch offen.", "{}", "Look at this: {}.",
    ),
}
_NAMES = "anna jens lee garcia mueller info sales office marie paul kim lopez schmidt dubois tom rosa ivan nora support team".split()
_HOSTS = "mail example acme post web uni cloud home shop office kontor ville casa north".split()


def _example(r: random.Random) -> tuple[str, list[Span]]:
    """Some sentences with entities and look-alikes, and where the entities are."""
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    first = lambda n: r.choice("123456789") + number(n - 1)
    pick = lambda *x: r.choice(x)

    def checked(n: int, right: bool) -> str:
        d = number(n - 1)
        good = next(c for c in "0123456789" if luhn(d + c))
        return d + (good if right else str((int(good) + r.randint(1, 9)) % 10))

    def iban() -> str:
        country = pick(*IBAN_LENGTHS, "XK")
        body = number(IBAN_LENGTHS.get(country, 20) - 4)
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        flat = f"{country}{98 - rest:02d}{body}"
        return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if r.random() < 0.6 else flat

    def address() -> str:
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" (at) ", "."), (" at ", "."), (" @ ", "."))
        inner = dot if r.random() < 0.5 else pick(".", "_", "-")
        top = pick("com", "org", "net", "de", "fr", "io", "es", "co") if at in (" at ", " @ ") or r.random() < 0.7 else pick("xyz", "dev", "shop", "museum")
        return inner.join(pick(*_NAMES) for _ in range(r.randint(1, 3))) + at + dot.join([*[pick(*_HOSTS) for _ in range(r.randint(1, 3))], top])

    def phone() -> str:
        a, b, c = pick(*"23456789") + number(2), pick(*"23456789") + number(2), number(4)
        return pick(
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{r.randint(1, 99)} {number(3)} {number(3)} {number(4)}", f"00{r.randint(10, 99)} {number(9)}", f"+{r.randint(1, 99)} ({a}) {b}-{c}",
            f"0{first(3)} {number(7)}", f"(0{first(2)}) {number(4)} {number(4)}", f"0{first(4)} {number(6)}", f"0{first(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{first(3)}/{number(7)}", f"0{first(2)}-{number(7)}",
            f"0{first(3)} {number(3)} {number(4)}",
        )

    made = {"email": address, "phone": phone, "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", "iban": iban, "card": lambda: "/".join([(d := checked(16, True))[:4], d[4:8], d[8:12], d[12:]])}
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    alike = [
        lambda: checked(16, False), lambda: number(r.randint(7, 12)), lambda: f"{r.randint(1900, 2030)}-{number(2)}-{number(2)} {number(2)}.{number(2)}.{number(4)}", lambda: f"{r.randint(1, 31):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2030)}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 31):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)} - {r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)}/{number(6)}",
        lambda: hexed(40), lambda: hexed(18), lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"v{r.randint(0, 9)}.{number(3)}.{number(4)}.{number(3)}", lambda: f"{first(3)} {number(3)} {number(3)}",
        lambda: f"{number(4)} {number(4)} {number(4)}", lambda: f"97{pick(8, 9)}-{number(1)}-{number(3)}-{number(5)}-{number(1)}", lambda: f"{number(5)}.{number(6)}", lambda: f"0.{number(9)}", lambda: f"{first(2)}.{number(3)}.{number(3)}",
        lambda: f"look at {pick('file', 'main', 'setup', 'index', 'node')}.{pick('py', 'js', 'ts', 'rs', 'txt', 'html')}", lambda: f"it is at the {pick(*_HOSTS)}. {pick(*_NAMES)} dot {pick(*_NAMES)}", lambda: f"the dot is at the end of {pick(*_HOSTS)}", lambda: f"{pick(*_NAMES)} dot {pick(*_NAMES)} said",
        lambda: " ".join(number(r.randint(1, 3)) for _ in range(r.randint(5, 9))), lambda: " ".join(f"0{number(1)}" for _ in range(r.randint(5, 9))), lambda: f"token = \"{hexed(40)}\"", lambda: pick("DE", "FR", "XX", "No") + number(2) + " " + " ".join(number(4) for _ in range(4)), lambda: f"AB12 and {pick(*_NAMES)} CD34 as well",
        lambda: f"{number(3)}-{number(3)}-{number(3)}-{number(3)}", lambda: f"#{number(8)}", lambda: f"{number(2)}:{number(2)}:{number(2)} {number(4)}", lambda: f"{r.randint(1, 99)} at {number(4)}.{number(4)}",
    ]
    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        kind = pick(*made) if r.random() < 0.55 else None
        own = _SENTENCES[kind] if kind and r.random() < 0.7 else _SENTENCES["any" if kind else "none"]
        before, after = pick(*own).split("{}")
        text += (" " if text else "") + before
        value = made[kind]() if kind else pick(*alike)()
        if kind:
            spans.append((kind, len(text), len(text) + len(value)))
        text += value + after
    return text, spans


@lru_cache(1)
def weights() -> dict[tuple[str, str], float]:
    """Learned by maximum likelihood (adaptive steps) from generated sentences, the same in every process."""
    r = random.Random(9)
    rows = []
    for _ in range(SENTENCES):
        text, spans = _example(r)
        s = Sentence.of(text)
        by_start, by_end = {a: i for i, (a, _) in enumerate(s.tokens)}, {b: i + 1 for i, (_, b) in enumerate(s.tokens)}
        rows.append((s, {(k, by_start[a], by_end[b]) for k, a, b in spans}))
    w: Weights = {(k, "bias"): -1.0 for k in KINDS}
    seen: dict[tuple[str, str], float] = defaultdict(float)
    for _ in range(PASSES):
        r.shuffle(rows)
        for s, gold in rows:
            for f, g in _gradient(s, gold, w).items():
                seen[f] += g * g
                w[f] = w.get(f, 0.0) + 0.5 * g / math.sqrt(seen[f] + 1e-6) - 2e-4 * w.get(f, 0.0)
    return w


def _zones(text: str) -> list[tuple[int, int]]:
    """The stretches of text, apart and in order, that hold all candidate segments: what is within LENGTH of a trigger."""
    zones: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - LENGTH), min(len(text), m.end() + LENGTH)
        if zones and a <= zones[-1][1]:
            zones[-1] = (zones[-1][0], b)
        else:
            zones.append((a, b))
    return zones


def model_spans(text: str, base: list[Span], w: Weights) -> list[Span]:
    """Entities that the base patterns miss; none overlaps a base span or another.

    A word that reaches beyond its stretch is in no candidate there: it is farther than LENGTH from what such a segment
    holds. So the work follows the length of the text, with white space in it or without."""
    taken = sorted((a, b) for _, a, b in base)
    found, first = [], 0
    for a, b in _zones(text):
        s = Sentence.of(text[a:b])
        while first < len(taken) and taken[first][1] <= a:
            first += 1
        blocked, n, reach = [False] * len(s.tokens), first, -1
        for i, (x, y) in enumerate(s.tokens):
            while n < len(taken) and taken[n][0] < a + y:
                reach = max(reach, taken[n][1])
                n += 1
            blocked[i] = reach > a + x
        if blocked:
            blocked[0] |= a > 0 and text[a - 1].isalnum() and text[a].isalnum()
            blocked[-1] |= b < len(text) and text[b].isalnum() and text[b - 1].isalnum()
        found += [(k, a + s.tokens[i][0], a + s.tokens[j - 1][1]) for k, i, j in viterbi(s, w, blocked)]
    return found


def listed(spans: list[Span]) -> str:
    """kind:start:end, by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the model adds. Offsets count code points; ends are exclusive."""
    base = base_spans(text)
    return base, model_spans(text, base, w)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of personal data replaced by [KIND] (of the first span in it; overlaps are one stretch)."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_masked: bool = False) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_added and, with keep_masked, masked.

    Null and empty text: no spans. Rows are independent and read whole; repeats, ties and other columns need nothing
    special; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(weights())  # some hundreds of numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, out = held.value, []
        for value in batch.column(1):
            t = value.as_py() or ""
            base, added = find(t, w)
            counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
            out.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added), masked(t, base + added) if keep_masked else None))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string()][: 8 if keep_masked else 7]
        names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "masked"][: len(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["doc_id", *names])

    kind = dict(docs.dtypes)[doc_id]
    return by_batch(docs.select(doc_id, text), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long{', masked string' if keep_masked else ''}")


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; a null text stays null, n_chars follows if it is there.

    Each row is masked by itself, whole: null or repeated doc_ids, ties and other columns need nothing special; an empty
    table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(weights())
    at, count = docs.columns.index(text), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [v.as_py() for v in batch.column(at)]
        fresh = [v if not v else masked(v, sum(find(v, held.value), [])) for v in values]
        columns = list(batch.columns)
        columns[at] = pa.array(fresh, batch.schema.field(at).type)
        if count is not None:
            columns[count] = pa.array([None if v is None else len(v) for v in fresh], batch.schema.field(count).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return by_batch(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
