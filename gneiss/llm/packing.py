"""Best-fit packing by minimum bin slack: per bin, a bitset subset-sum over the available lengths finds the fullest
combination, which is then removed."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import CACHES, buckets_for, by_batch, running_total, settle

CAPACITY = 2048
#: Words whose ids a worker remembers at least since it last made room, and bytes of them; twice as many at most. A longer
#: stretch without white space than LONG_WORD is encoded each time.
CACHE_WORDS, CACHE_BYTES, LONG_WORD = 600_000, 48 << 20, 200


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination with the largest sum up to room. available: (length, count), longest first.

    Bit s of a whole number stands for the sum s. A length is added in portions of 1, 2, 4, ... copies, which is exact
    for its count; the numbers before each portion lead back to the combination."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, count in available:
        if length > room:
            continue
        left, portion = min(count, room // length), 1
        while left > 0:
            portion = min(portion, left)
            grown = (reach | reach << (length * portion)) & mask
            if grown != reach:
                steps.append((reach, length, portion))
                reach = grown
            left -= portion
            portion *= 2
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, portion in reversed(steps):
        if not before >> at & 1:
            at -= length * portion
            chosen[length] = chosen.get(length, 0) + portion
    return sorted(chosen.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, how many in each)]) over all pieces. counts: pieces by length, at most `capacity` lengths.

    Each bin starts with the longest piece left, so that none is left over for last; the rest of it is filled by
    `fullest`. The same combination is used as often as the counts allow, so the work follows the number of lengths and
    not of documents."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    lengths = sorted(left, reverse=True)
    while lengths:
        seed = lengths[0]
        rest = [(k, left[k] - (k == seed)) for k in lengths if left[k] > (k == seed)]
        chosen = dict(fullest(rest, capacity - seed)) if seed < capacity else {}
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        plan.append((times, sorted(chosen.items(), reverse=True)))
        for k, n in chosen.items():
            left[k] -= n * times
        lengths = [k for k in lengths if left[k]]
    return plan


def placements(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, bins, first bin, offset) by length and rank: where the pieces of a length go by their rank.

    The table has a few rows per combination of the plan, whatever the number of pieces."""
    rows, used, first = [], {}, 0
    for times, chosen in plan:
        offset = 0
        for length, n in chosen:
            rows.append((length, used.get(length, 0), times, first, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, length: str, ties: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: bins of at most `capacity`, filled gaplessly from 0.

    pieces: rows with a length from 1 to capacity; ties: columns that put pieces of one length in order (rows equal in
    all of them may swap places). Only the number of pieces of each length reaches the driver. Pieces of a length are
    ranked in buckets, so a length that a third of all pieces have is no hot group. No pieces: no rows."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    table = placements(plan_bins(counts, capacity))
    keyed = pieces.withColumn("_key", F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ties]))).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(keyed, [length], "_key", ties, "_one", "_rank", buckets_for(sum(counts.values()))).drop("_key", "_one")
    held = pieces.sparkSession.sparkContext.broadcast(table)  # a few rows per length at most: see plan_bins

    def place(batches):
        t = held.value
        keys = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_rank"))
            at = np.searchsorted(keys, size << 44 | rank, side="right") - 1
            slot, turn = np.divmod(rank - t[at, 1], t[at, 2])
            columns = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(t[at, 3] + turn), pa.array(t[at, 4] + slot * size)], [*[n for n in b.schema.names if n != "_rank"], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def _plain(word: str) -> tuple[str, str]:
    """(stem, mark) whose ids, one after the other, are the word's: a mark after a letter is a token of its own, and in
    Latin script the tokenizer's lower case is Python's. Words that share a stem are then encoded once."""
    mark = word[-1] if len(word) > 1 and word[-1] in ".," and word[-2].isalpha() else ""
    stem = word[:-1] if mark else word
    low = stem.lower()
    return (low, mark) if stem.isalpha() and max(low) < "\u0180" and max(stem) < "\u0180" else (word, "")


@lru_cache(1)
def word_encoder(path: str, cache_words: int = CACHE_WORDS) -> Callable[[str], bytes]:
    """text: its ids as little-endian 32-bit numbers, equal to the tokenizer's own on the whole text.

    This tokenizer's words never cross white space, its changes to the text (composition, lower case) don't either, and
    white space yields no id. So each stretch without it is encoded once and remembered, by the worker process and not
    only by the task. Texts with the four control characters that Python alone takes for white space are encoded whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known: dict[str, bytes] = {"": b""}
    older: dict[str, bytes] = {}

    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    held = 0  # bytes of known, about

    def learn(stems: list[str], others: list[str]) -> None:
        """stems: words of letters alone, each of which is one word to the tokenizer, whose last token says so. They are
        encoded as one text, which costs a good deal less than each by itself."""
        if stems:
            ids = np.array(tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(stops) != len(stems):
                raise ValueError("the tokenizer's words do not end as expected")
            for w, stop in zip(stems, stops):
                known[w] = data[start:stop]
                start = stop
        for w, e in zip(others, tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()

    def encode(text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        nonlocal known, older, held
        words = text.split()
        fresh = list(set(words).difference(known))
        long = {}
        if fresh:
            if len(known) > cache_words or held > CACHE_BYTES:
                known, older, held = {"": b""}, known, 0
                fresh = list(set(words))
            plain = {}
            for w in fresh:
                if len(w) > LONG_WORD:
                    long[w] = array("I", tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
                elif (ids := older.get(w)) is None:
                    plain[w] = _plain(w)
                else:
                    known[w] = ids
                    held += len(w) + len(ids)
            stems = {stem for stem, _ in plain.values()}.difference(known)
            simple = [w for w in stems if w.isalpha() and max(w) < "\u0180" and w == w.lower()]
            learn(simple, [*stems.difference(simple), *{mark for _, mark in plain.values()}.difference(known)])
            for w, (stem, mark) in plain.items():
                known[w] = known[stem] + known[mark]
                held += 2 * len(w) + len(known[w])
        if long:
            return b"".join(long[w] if len(w) > LONG_WORD else known[w] for w in words)
        return b"".join(map(known.__getitem__, words))

    return encode


CACHES.append(word_encoder.cache_clear)


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. A document is its ids and then `end`; only a longer one
    than capacity is cut, into pieces of that length. Null and empty texts: one piece with `end` alone."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encode = word_encoder(tokenizer, cache_words)
        last = np.array([end], "<u4").tobytes()
        rows, piece, start, length, crc = [], [], [], [], []
        for i, value in enumerate(b.column(1)):
            ids = encode(value.as_py() or "") + last
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append(i)
                piece.append(n)
                start.append(n * capacity)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return by_batch(docs.select(doc_id, text), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", remember=True)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """token_pieces with sequence_id and offset. cache_words: see CACHE_WORDS; fewer take less memory and more time. Repeated rows are packed each; extra columns are not read; empty table: no rows.

    The pieces are written once to the shared folder, since tokenizing is the costly part and three jobs read them."""
    pieces = settle(token_pieces(docs, tokenizer, doc_id, text, capacity, cache_words=cache_words), "pieces")
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"], capacity)
