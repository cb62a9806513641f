"""Order MinHash with DataFrame functions alone: occurrence-numbered k-mers, the minimal ones of each bin, kept in text
order, hashed as tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, minima of a tuple, tuples of a signature (a power of two).
K, TUPLE, BINS = 3, 2, 64
#: Letters and digits of a word at most; longer runs of them are taken apart where their own characters say so.
WORD_LETTERS = 24
#: Rows of a range of neighbours, about; ranges at most, so that their bounds stay few. One range holds that part of the
#: rows at most, and Spark sorts it with spills.
NEIGHBOUR_ROWS, NEIGHBOUR_RANGES = 500, 100_000

# Blocks of scripts that are written without spaces (South-East Asian, Tibetan, Kana, Han).
_UNSPACED = r"\u0E00-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: The letters and digits that end a piece of a long run: those whose code is divisible by 4.
_ENDS = "".join(c for c in map(chr, range(48, 123)) if c.isalnum() and ord(c) % 4 == 0)


def word_pattern(unspaced: str = _UNSPACED) -> str:
    """A run of up to WORD_LETTERS letters and digits; else a piece of up to 16 that ends where _ENDS says; else one
    character. Where a word begins depends on what is near it alone, so an edit changes the words about it and no others."""
    letter = rf"[A-Za-z0-9[\p{{L}}\p{{N}}&&[^{unspaced}]]]"
    return rf"{letter}{{1,{WORD_LETTERS}}}+(?!{letter})|[A-Za-z0-9&&[^{_ENDS}]]{{0,15}}+[{_ENDS}]|\S"


def _shift(name: str, x: Column, bits: Column) -> Column:
    return F.call_function(name, x, bits)


def fingerprints(df: DataFrame, text: Column, out: str, k: int = K, pick: int = TUPLE, bins: int = BINS) -> DataFrame:
    """df with `out`: the order min-hash signature of the text, an array of at most `bins` numbers (bin, then tuple hash).

    Words: see word_pattern; characters of scripts without spaces are words of their own. A k-mer is k consecutive words; a
    text of fewer words is one k-mer, one without words (or null) has none. Its occurrence number tells equal k-mers of a
    text apart. A random number drawn from (k-mer, occurrence) puts the pair in a bin and ranks it there; each bin keeps
    its `pick` lowest pairs, puts them in text order and hashes their k-mers as a tuple. (The bins stand for the
    independent permutations of the published method: each pair is drawn once, not once per permutation.) An empty bin has
    no number. Two texts agree in a bin if the lowest pairs are the same and in the same order, so moving words about
    lowers the likeness although the set of k-mers hardly changes.

    A k-mer has 64 bits. To sort, hash and position share 63 bits, as many for the position as the text needs: in a text of
    n k-mers two different ones are numbered as one with a chance below n**3 / 2**63.

    Each step is a projection of its own, so that arrays are made once and sorted as plain numbers."""
    c = {n: f"_{out}_{n}" for n in ("w", "h", "b", "s", "d", "e", "p")}
    bin_bits = bins.bit_length() - 1
    high = 63 - bin_bits  # bits below the bin
    col = F.col
    steps = df.withColumn(c["w"], F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({word_pattern()})"), F.lit(1)))
    count = F.when(F.size(c["w"]) > 0, F.greatest(F.size(c["w"]) - (k - 1), F.lit(1))).otherwise(0)
    kmer = lambda i: F.xxhash64(*[F.get(col(c["w"]), i + j if j else i) for j in range(k)])
    steps = steps.withColumn(c["h"], F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), kmer)).otherwise(F.array().cast("array<bigint>")))
    steps = steps.withColumn(c["b"], F.length(F.bin(F.size(c["h"]).cast("long"))))
    b = col(c["b"])
    mask = _shift("shiftleft", F.lit(1).cast("long"), b) - 1

    def position(x: Column) -> Column:
        return x.bitwiseAND(mask).cast("int")

    def above(x: Column, i: Column) -> Column:
        """The high bits of a hash, then a position."""
        return _shift("shiftleft", _shift("shiftrightunsigned", x, b + 1), b).bitwiseOR(i.cast("long"))

    # Equal k-mers side by side, in text order.
    steps = steps.withColumn(c["s"], F.sort_array(F.transform(c["h"], above)))
    # Where a run of equal k-mers begins, and the end.
    n = F.size(c["s"])
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_shift("shiftright", F.get(col(c["s"]), i), b) != _shift("shiftright", F.get(col(c["s"]), i - 1), b)))
    steps = steps.withColumn(c["d"], F.when(n > 0, F.concat(begins, F.array(n))).otherwise(F.array(F.lit(0))))

    def drawn(i: Column, occurrence: Column) -> Column:
        place = position(F.get(col(c["s"]), i))
        return above(F.xxhash64(F.get(col(c["h"]), place), occurrence.cast("int")), place)

    def run(start: Column, j: Column) -> Column:
        end = F.get(col(c["d"]), j + 1)
        return F.when(end - start == 1, F.array(drawn(start, F.lit(0)))).otherwise(F.transform(F.sequence(start, end - 1), lambda i: drawn(i, i - start)))

    pairs = F.flatten(F.transform(F.slice(col(c["d"]), F.lit(1), F.size(c["d"]) - 1), run))
    steps = steps.withColumn(c["e"], F.sort_array(pairs))
    # An element has fewer than `pick` before it in its bin if the one `pick` places earlier is in another bin.
    lowest = F.filter(col(c["e"]), lambda e, i: (i < pick) | (F.shiftright(F.get(col(c["e"]), i - pick), high) != F.shiftright(e, high)))
    # Bin and position alone, so that sorting gives text order within a bin.
    steps = steps.withColumn(c["p"], F.sort_array(F.transform(lowest, lambda e: _shift("shiftleft", F.shiftright(e, high), b).bitwiseOR(position(e).cast("long")))))

    p = col(c["p"])
    bin_of = lambda x: _shift("shiftright", x, b)

    def tuple_at(x: Column, i: Column) -> Column:
        same = F.filter(F.slice(p, i + 1, F.lit(pick)), lambda y: bin_of(y) == bin_of(x))
        number = F.xxhash64(F.transform(same, lambda y: F.get(col(c["h"]), position(y))))
        first = (i == 0) | (bin_of(F.get(p, i - 1)) != bin_of(x))
        return F.when(first, F.shiftleft(bin_of(x), high).bitwiseOR(F.shiftrightunsigned(number, bin_bits + 1)))

    steps = steps.withColumn(out, F.filter(F.transform(p, tuple_at), lambda v: v.isNotNull()))
    return steps.drop(*c.values())


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Share of the bins that agree, among those that either text fills; 1 if neither fills any."""
    shift = 64 - bins.bit_length()
    filled = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, shift)), F.transform(b, lambda v: F.shiftright(v, shift))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def printed(signature: Column) -> Column:
    """16 hex digits for each tuple, in order of the bins."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def _bounds(df: DataFrame, value: Column, rows: int) -> list[int]:
    """Lowest values of the ranges but the first, about NEIGHBOUR_ROWS rows each: approximate quantiles, found in one pass."""
    ranges = max(1, min(NEIGHBOUR_RANGES, rows // NEIGHBOUR_ROWS))
    if ranges < 2:
        return []
    found = df.agg(F.min(value), F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()
    bounds = sorted(set(found[1] or []))
    if max(abs(found[0]), abs(bounds[-1])) > 1 << 53:  # quantiles go by double precision: take the values that are there
        bounds = [r[1] for r in df.where(value.isNotNull()).groupBy(_range_of(value, bounds)[0].alias("r")).agg(F.min(value)).collect()]
    return sorted(set(bounds) - {found[0]})


def _range_of(value: Column, bounds: list[int]) -> tuple[Column, Column]:
    """How many bounds are not above the value (a binary search over a constant array), and whether it is one of them."""
    if not bounds:
        return F.lit(0), F.lit(False)
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - 1) <= value), at + s).otherwise(at))
    return at, F.coalesce(F.get(array, F.when(at > 0, at - 1).otherwise(0)) == value, F.lit(False)) & (at > 0)


def with_next(df: DataFrame, order: str, ties: list[str], columns: list[str]) -> DataFrame:
    """df with _next_<column> of the next row in order; after the last row comes the first. order: whole numbers.

    Rows without a number come first, by a hash of their ties; rows with one number are in order of their ties. Rows go to
    ranges of the order whose bounds are approximate quantiles (a bounded number of values on the driver), and the rows at
    a bound go to the range before it as well, where the window only looks at them. So neighbours meet in one shuffle and
    no range is a task of all rows; only rows with one and the same number stay together. A single row is its own next."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.count(order).alias("given"), F.min(order).alias("lo")).first()
    none = facts["n"] - facts["given"]
    value = F.col(order).cast("long")
    rows = df.withColumn("_tie", F.when(value.isNull(), F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in ties]), 12)))
    loose, given = (_bounds(rows.where(value.isNull()), F.col("_tie"), none) if none else []), _bounds(df, value, facts["given"])
    last = len(loose) + len(given) + (1 if none and facts["given"] else 0)  # ranges are numbered from 0
    first_given = last - len(given)
    (low, low_at), (high, high_at) = _range_of(F.col("_tie"), loose), _range_of(value, given)
    rows = rows.withColumn("_range", F.when(value.isNull(), low).otherwise(high + first_given))
    # The rows that the range before must see: those at its bound, and the first of all rows with or without a number.
    start = rows.where(value.isNull()).agg(F.min("_tie")).first()[0] if none else None
    leads = F.when(value.isNull(), low_at | (F.col("_tie") == F.lit(start) if none else F.lit(False))).otherwise(high_at | (value == F.lit(facts["lo"])) if facts["given"] else F.lit(False))
    before = F.when(F.col("_range") > 0, F.col("_range") - 1).otherwise(F.lit(last))
    seat = lambda at, look: F.struct(at.alias("range"), F.lit(look).alias("look"))
    seats = F.when(leads, F.array(seat(F.col("_range"), 0), seat(before, 1))).otherwise(F.array(seat(F.col("_range"), 0)))
    dealt = rows.withColumn("_seat", F.explode(seats)).withColumns({"_range": F.col("_seat.range"), "_look": F.col("_seat.look")}).drop("_seat")
    along = Window.partitionBy("_range").orderBy("_look", F.col(order).asc_nulls_first(), "_tie", *ties)
    met = dealt.withColumns({f"_next_{c}": F.lead(c).over(along) for c in columns})
    return met.where(F.col("_look") == 0).drop("_range", "_look", "_tie")


def neighbour_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (bins joined), near_edited, near_next.

    The edited text is the text with its last floor(n_chars/4) code points replaced by the first as many (or all) of the
    next row's by doc_id. Null text: empty. Rows with the same doc_id follow each other by text, those without one come
    first, by a hash of it. Any length of text, repeated rows and other columns need nothing special. Empty table: no rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = fingerprints(rows, F.col("_text"), "_own")
    met = with_next(own, "doc_id", ["_text"], ["_text", "_own"])
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - quarter), F.substring("_next__text", F.lit(1), quarter))
    made = met.withColumns({"n_chars": n.cast("long"), "_edited_text": edited}).drop("_text", "_next__text")
    made = fingerprints(made.withColumn("edited_sha256", F.sha2(F.encode("_edited_text", "UTF-8"), 256)), F.col("_edited_text"), "_edited")
    return made.select("doc_id", "n_chars", "edited_sha256", printed(F.col("_own")).alias("fingerprint"), printed(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next__own")).alias("near_next"))
