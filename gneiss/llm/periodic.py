"""Periodic runs of words: a suffix automaton of each stretch of words, whose end-position sets are merged small to large
along the suffix links; two positions that become neighbours in a state at least as long as their distance are a square,
and squares are extended to runs.

Texts go through Arrow batch by batch; each document is a matter of its own, so nothing is shuffled."""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_batch

#: A run has at least LEAST_WORDS words and LEAST_PERIODS periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Ends:
    """An ordered set of end positions in blocks, so that an insertion moves one block and not the whole set."""

    BLOCK = 512

    def __init__(self, first: int):
        self.blocks, self.least, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert x, which is not there; gives its neighbours."""
        k = max(0, bisect_right(self.least, x) - 1)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else None  # x below all of the first block: nothing is before it
        after = block[at] if at < len(block) else self.least[k + 1] if k + 1 < len(self.least) else None
        block.insert(at, x)
        self.least[k] = block[0]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[k : k + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self.least.insert(k + 1, self.blocks[k + 1][0])
        return before, after

    def __iter__(self) -> Iterator[int]:
        return itertools.chain.from_iterable(self.blocks)


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a sequence: length and suffix link of each state, and the end position at which a state
    was made (-1 for copies and the root)."""
    length, link, end, steps = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(ids):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        steps.append({})
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                steps.append(dict(steps[q]))
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, end


def squares(ids: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period): the words up to `end` and the `period` words before them and after them; each a square that ends
    at end + period. Every run of three periods or more holds one of its own period.

    Longest states first, each state's set goes into that of its suffix link, the smaller into the larger: an insertion
    puts a position between two neighbours. In a state of length m, positions d <= m apart end equal stretches of d words
    that touch."""
    length, link, end = automaton(ids)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        own, up = sets[v], link[v]
        sets[v] = None
        if up == 0:
            continue  # the root's words have no length
        other = sets[up]
        if other is None:
            sets[up] = own
            continue
        if own.size > other.size:
            own, other = other, own
        most = length[up]
        for x in own:
            before, after = other.add(x)
            if before is not None and x - before <= most:
                yield before, x - before
            if after is not None and after - x <= most:
                yield x, after - x
        sets[up] = other


def _agree(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words agree from a and from b on, both going on by `step` (1 or -1); blocks double, so the cost follows the result."""
    n, size = 0, 32
    while True:
        if step > 0:
            left, right = x[a + n : a + n + size], x[b + n : b + n + size]
        else:
            left, right = x[max(0, a - n - size + 1) : a - n + 1][::-1] if a - n >= 0 else x[:0], x[max(0, b - n - size + 1) : b - n + 1][::-1]
        m = min(len(left), len(right))
        differ = np.flatnonzero(left[:m] != right[:m])
        if len(differ):
            return n + int(differ[0])
        n += m
        if m < size:
            return n
        size *= 2


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period. least_periods is 3 or more.

    A square that lies in a run already found with its period is no new one. The period is the smallest: a smaller one
    would have put a position between the two neighbours."""
    known: dict[int, tuple[list[int], list[int]]] = {}
    out = []
    for end, period in squares(ids.tolist()):
        starts, stops = known.setdefault(period, ([], []))
        at = bisect_right(starts, end - period + 1) - 1
        if at >= 0 and stops[at] > end + period:
            continue
        start = end - _agree(ids, end, end + period, -1) + 1
        stop = end + period + _agree(ids, end + 1, end + 1 + period, 1) + 1
        at = bisect_left(starts, start)
        starts.insert(at, start)
        stops.insert(at, stop)
        if stop - start >= max(least_words, least_periods * period):
            out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """(start, stop) of the stretches that can hold a run at all; no run reaches beyond one.

    Each word of a run is in it least_periods times at least. So a word that is in its stretch less often is in no run and
    parts the stretch, until nothing changes; what is left shorter than least_words goes."""
    at = np.arange(len(ids))
    stretch = np.zeros(len(ids), np.int64)
    while len(at):
        _, word, count = np.unique(stretch * np.int64(len(ids)) + ids[at], return_inverse=True, return_counts=True)
        often = count[word] >= least_periods
        stay = at[often]
        fresh = np.cumsum(np.diff(stay, prepend=-2) > 1) - 1 if len(stay) else stay  # words that follow one another
        long = np.bincount(fresh)[fresh] >= least_words if len(stay) else often[:0]
        if long.all() and len(stay) == len(at):
            break
        at, stretch = stay[long], fresh[long]
    parts = np.flatnonzero(np.diff(at, prepend=-2) > 1) if len(at) else at
    return [(int(a[0]), int(a[-1]) + 1) for a in np.split(at, parts[1:])] if len(at) else []


def document_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """The runs of a document's words: (start, length, period), numbered from 0."""
    if len(words) < least_words:
        return []
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, itertools.count()), np.int64, len(words))  # each word: where it is first
    return [(a + start, length, period) for a, b in stretches(ids, least_words, least_periods) for start, length, period in runs_of(ids[a:b], least_words, least_periods)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by a space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, text: str = "text", prefix: str = "", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """docs with n_words, runs (array of start, length, period; by start, then period) and collapsed (the words that stay,
    joined by a space).

    A word is a run of anything but ASCII white space. Every whole text is read. Null text: no words, no runs, an empty
    collapsed text; so with an empty text. Rows are judged one by one, so nulls, ties and repeats elsewhere need nothing
    special. Columns of docs are kept, but for those named like the new ones (a prefix tells them apart). Empty table: no
    rows."""
    if least_periods < 3:
        raise ValueError("least_periods is 3 at least")
    names = [f"{prefix}{n}" for n in ("n_words", "runs", "collapsed")]
    docs = docs.select(*[c for c in docs.columns if c not in names])
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found, left = [], [], []
        for value in batch.column(at).cast(pa.binary()):
            words = (value.as_py() or b"").split()  # parts bytes at ASCII white space alone
            runs = document_runs(words, least_words, least_periods)
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            left.append(collapsed(words, runs).decode())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(left, pa.string())], [*batch.schema.names, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_batch(docs, run, f"{kept}, {names[0]} bigint, {names[1]} {RUNS}, {names[2]} string")


def words(text: Column) -> Column:
    """The words of a text in order. Null: none."""
    bare = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, " ")).otherwise(F.array().cast("array<string>"))


def repeating(words: Column, doc_id: Column) -> Column:
    """The words of a document; for one in ten, by crc32 of doc_id, repeated with a period from some word on: each word i
    from a on becomes word a + (i - a) % p. Null doc_id: as they are. words: a column that is there already."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)) + 1
    turned = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
    return F.when((h % 10 == 0) & (n > 0), turned).otherwise(words)


def longest(runs: Column) -> Column:
    """The run with the greatest length; ties go to the smallest start, then period. Null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
