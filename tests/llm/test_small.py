"""Defined results on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import chosen_path, html, langid, mixing, ogg, order_minhash, packing, pii, sharding, shingles, suffixes
from gneiss.llm.components import components
from gneiss.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def docs(spark, *texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    return table(spark, [(i, t, "en", sources[n] if sources else "s", None if t is None else len(t)) for n, (i, t) in enumerate(zip(ids, texts))])


def odd(spark):
    """Nulls, empties, a long text, repeated rows, a repeated id, columns whose names the operators use."""
    r = random.Random(5)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four five six seven", "b"), (3, "one two three four five six seven", "b"), (4, long, None), (5, long, "a"), (6, "  \n\t ", "b"), (7, "é" * 300, None), (7, "other text", "c"), (None, "no id at all here in this row", "a")]
    frame = table(spark, [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows])
    clash = {c: F.lit(9) for c in ("size", "name", "row", "part", "_size", "_key", "_part", "_c0", "_c9", "_node", "label", "score", "lang_pred", "length", "target", "_bucket", "_kept", "blob", "key", "rep")}
    return frame.withColumns(clash)


def empty(spark):
    return odd(spark).where("false")


OPERATORS = {
    "order_minhash": lambda d: order_minhash.neighbour_fingerprints(d),
    "ogg": lambda d: ogg.media_columns(d),
    "kd": lambda d: sharding.slots(sharding.kd_partition(d.withColumn("w", F.coalesce(F.length("text"), F.lit(0)) + 16), ["source", "w", "doc_id"], "w", ["doc_id", "text"], shards=3), "_shard", ["doc_id", "text"], d.count()),
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "chosen_path": lambda d: chosen_path.near_duplicates(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "language": lambda d: langid.identify(d, langid.learn(d)),
    "pii": lambda d: pii.personal_data(d),
    "packing": lambda d: packing.pack_documents(d, tokenizer_path()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = OPERATORS[name](odd(spark)).collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert set(ids) == {1, 2, 3, 4, 5, 6, 7, None}
    if name != "packing":
        assert len(rows) == 10


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


# ---- 1 ---------------------------------------------------------------------------------------------------------------




def test_fingerprints_follow_edits(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    base = words[:1000]
    near = base[:500] + ["changed"] + base[501:]
    swapped = base[500:] + base[:500]
    shuffled = base[:]
    r.shuffle(shuffled)
    rows = docs(spark, *(" ".join(x) for x in (base, near, swapped, shuffled, words[1000:2000], base)))
    made = order_minhash.fingerprints(rows, F.col("text"), "f").select("doc_id", "f")
    got = {x["doc_id"]: x["f"] for x in made.collect()}

    def like(a, b):
        frame = spark.createDataFrame([(got[a], got[b])], "a array<bigint>, b array<bigint>")
        return frame.select(order_minhash.likeness(F.col("a"), F.col("b")).alias("v")).first()["v"]

    assert like(0, 5) == 1.0
    assert like(0, 1) > 0.9
    # The same k-mers in another order are less alike, which plain min-hash does not see; few k-mers survive a shuffle.
    assert 0.3 < like(0, 2) < 0.7
    assert like(0, 3) < 0.05 and like(0, 4) < 0.05


def test_occurrences_count(spark):
    rows = docs(spark, "a b c " * 50, "a b c " * 100, "a b c")
    got = [r["f"] for r in order_minhash.fingerprints(rows, F.col("text"), "f").orderBy("doc_id").collect()]
    assert got[0] != got[1] and len(got[1]) > len(got[2]) == 1


def test_next_row(spark):
    rows = docs(spark, *"abcdefg", ids=[5, 1, 9, 3, 7, 100, 50])
    many = rows.unionByName(spark.range(200, 3200, 3).selectExpr("id doc_id", "cast(id as string) text", "'' lang", "'' source", "1L n_chars"))
    met = order_minhash.with_next(many, "doc_id", ["text"], ["doc_id"])
    order = sorted(r["doc_id"] for r in many.collect())
    assert {r["doc_id"]: r["_next_doc_id"] for r in met.collect()} == dict(zip(order, order[1:] + order[:1]))


def test_edited_text(spark):
    rows = docs(spark, "abcdefgh", None, "xy", "0123456789")
    got = {r["doc_id"]: r["edited_sha256"] for r in order_minhash.neighbour_fingerprints(rows).collect()}
    edited = ["abcdef", "", "xy", "01234567ab"]
    assert [got[i] for i in range(4)] == [hashlib.sha256(t.encode()).hexdigest() for t in edited]


# ---- 2 ---------------------------------------------------------------------------------------------------------------

PARAGRAPH = "A paragraph with a good number of words so that its window of lines has surged well past the threshold."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<html></html>", ""), ("plain", "plain"),
        (f"<nav><a>x</a></nav><article><h1>T&amp;C</h1><p>{PARAGRAPH}</p><p>As.</p></article><footer>f</footer>", f"T&C\n{PARAGRAPH}\nAs."),
        ("<article><p>a\n  b<br>c</p><script>var t='</p>';</script><p>d<!-- x --></p><div class='ad'>buy</div><ul><li>i<li>j</ul></article>", "a b c\nd\ni\nj"),
        ("<article><p>cut &am", "cut &am"), ("<article><p>cut<b", "cut"), ("<article><p>1 < 2 &#233;&nbsp;x", "1 < 2 é x"),
        (f"<div id='menu'>m</div><div><p>{PARAGRAPH}</p><p>short</p></div><section class='comments'><p>{PARAGRAPH}{PARAGRAPH}</p></section>", f"{PARAGRAPH}\nshort"),
        (f"<main><p>{PARAGRAPH}</p><form>f<input></form><aside>s</aside><p>end</p></main>", f"{PARAGRAPH}\nend"),
        (f"<article><p>{PARAGRAPH}</p><article class='comment'><p>me too</p></article></article>", PARAGRAPH),
        (f"<ul><li><a href=a>one link</a></li><li><a href=b>two link</a></li></ul><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>", f"{PARAGRAPH}\n{PARAGRAPH}"),
        ("<div class='ad'>buy<article><p>kept</p></article>", "kept"), ("<article><p class=a<b>x</p><p>y <i>z", "x\ny z"),
        ("<body class='no-sidebar'><article><header><h1>Head</h1><span>by me</span></header><p>x</p></article>", "Head\nx"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>Site name</p><div class='content-sidebar-wrap'><article><p>{PARAGRAPH}</p><p>b</p></article></div>", f"{PARAGRAPH}\nb"),
        (f"<p>Site name</p><div class='layout has-sidebar'><aside class='sidebar'><p>about</p></aside><main><p>{PARAGRAPH}</p></main></div>", PARAGRAPH),
        (f"<p>Site name</p><article class='post no-sidebar'><p>{PARAGRAPH}</p></article>", PARAGRAPH),
        (f"<p>top</p><div class='ad'>buy<div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>", f"top\nbuy\n{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<body><p>top</p><nav><ul><li><a href=a>a link</a></ul><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></body>", f"top\na link\n{PARAGRAPH}\n{PARAGRAPH}"),
        (f"<body><p>top</p><form><div class='menu'>m</div><div><p>{PARAGRAPH}</p></div><footer>legal</footer></form></body>", f"top\n{PARAGRAPH}"),
        (f"<article><p>{PARAGRAPH}</p></article><div class='related'><article><p>{PARAGRAPH} More.</p></article></div><footer>{PARAGRAPH * 9}</footer>", None),
        (f"<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div class='related'><article class='card'><p>teaser</p></article></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
    ],
)
def test_what_encloses_the_text_is_no_surroundings(page, text):
    assert html.main_text(page) == (PARAGRAPH if text is None else text)


LINKS = "<ul>" + "<li><a href=a>a link</a>" * 4 + "</ul>"
LINKED = "\n".join(["a link"] * 4)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<h1>T</h1><p>{PARAGRAPH * 2}</p>{LINKS}<p>{PARAGRAPH}</p>", f"T\n{PARAGRAPH * 2}\n{LINKED}\n{PARAGRAPH}"),
        (f"<div><p>{PARAGRAPH * 9}</p>{LINKS}<p>{PARAGRAPH * 9}</p></div>{LINKS}<div>{PARAGRAPH}</div>", f"{PARAGRAPH * 9}\n{LINKED}\n{PARAGRAPH * 9}"),
        (f"<main><p>{PARAGRAPH}</p><article class='card'><p>teaser</p></article><p>end</p></main>", f"{PARAGRAPH}\nteaser\nend"),
        (f"<div class='content'><p>{PARAGRAPH}</p></div><article class='card'><p>teaser</p></article>", PARAGRAPH),
        (f"<article><p>{PARAGRAPH}</p></article><p>x</p><article><p>{PARAGRAPH} 2</p></article>", f"{PARAGRAPH}\n{PARAGRAPH} 2"),
        (f"<p>{PARAGRAPH * 3}</p><article class='card'><p>teaser</p></article>", f"{PARAGRAPH * 3}\nteaser"),
        (f"<main><p>x</p><article><p>{PARAGRAPH}</p></article></main>", PARAGRAPH),
    ],
)
def test_all_stretches_and_parts_stay(page, text):
    assert html.main_text(page) == text


def test_markup_takes_linear_time():
    for page in ("<p>" + "<a " * 100_000, '<a "' * 50_000, "<a '<a \"" * 50_000, "<" * 200_000, "<!--" * 50_000, "<b>" * 20_000):
        html.main_text(page)


def test_surges():
    assert html.surges([0, 0, 50, 60, 0, 0, 0, 0, 10, 0], 80) == [(2, 4)]
    assert html.surges([10, 200, 5, 0, 0, 0, 1], 80)[0] == (0, 3)
    assert html.surges([], 1) == []


def test_pages_with_nulls(spark):
    rows = table(spark, [(1, None, None), (2, "u", ""), (2, "u", ""), (3, None, "<p>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(rows).collect())
    assert got == [(1, "", 0), (2, "", 0), (2, "", 0), (3, "x", 1)]


# ---- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 63, 64, 255, 4096, 65_024, 65_025, 300_000])
def test_ogg_round_trip(size):
    data = random.Random(size).randbytes(size)
    back, info = ogg.load(ogg.store(ogg.payload_of(data)))
    assert back[:size] == data and not back[size:].strip(b"\0") and len(back) % 64 == 0 and len(back) >= 64
    assert info["seconds"] == len(back) / ogg.RATE


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def test_ogg_crc():
    for n in (0, 1, 5, 300):
        data = random.Random(n).randbytes(n)
        assert ogg.ogg_crc(data) == slow_crc(data)


@pytest.mark.parametrize("sizes", [[0], [255], [510, 0, 3], [70_000], [10, 70_000, 255, 1], [254] * 600])
def test_ogg_packets_span_pages(sizes):
    packets = [random.Random(n).randbytes(n) for n in sizes]
    pages = ogg.paginate(7, [(p, i) for i, p in enumerate(packets)])
    other = ogg.paginate(9, [(b"x", 0), (b"y" * 999, 1)])
    mixed = b"junk" + pages[0] + other[0] + b"".join(pages[1:2]) + other[1] + b"".join(pages[2:])
    streams, failed = ogg.demultiplex(mixed)
    assert not failed and streams[7].packets == packets and streams[9].packets == [b"x", b"y" * 999]
    assert streams[7].ended


def test_ogg_damage():
    packets = [bytes([i]) * 40_000 for i in range(5)]
    pages = ogg.paginate(7, [(b"head", 0), *[(p, i) for i, p in enumerate(packets)]])
    broken = bytearray(b"".join(pages))
    broken[len(pages[0]) + len(pages[1]) + 500] ^= 1
    streams, failed = ogg.demultiplex(bytes(broken))
    assert failed == 1 and streams[7].gaps == 1
    assert all(p in [b"head", *packets] for p in streams[7].packets) and len(streams[7].packets) < 6
    with pytest.raises(ValueError):
        ogg.load(ogg.store(bytes(64))[:-10])


def test_ogg_granules_of_every_page():
    media = ogg.store(random.Random(1).randbytes(200_000))
    places, at = [], 0
    while at < len(media):
        n = media[at + 26]
        places.append((at, stop := at + 27 + n + sum(media[at + 27 : at + 27 + n])))
        at = stop
    assert len(places) > 5
    streams, _ = ogg.demultiplex(media)
    assert ogg.packet_starts(streams[ogg.SAMPLES]) == [0, *range(0, 200_000, ogg.PACKET)]
    for at, stop in places:
        page = media[at:stop]
        granule = int.from_bytes(page[6:14], "little", signed=True)
        wrong = page[:6] + max(0, granule - 1 if granule > 0 else 7).to_bytes(8, "little") + page[14:22] + bytes(4) + page[26:]
        wrong = wrong[:22] + ogg.ogg_crc(wrong).to_bytes(4, "little") + wrong[26:]
        with pytest.raises(ValueError, match="granule"):
            ogg.load(media[:at] + wrong + media[stop:])


def test_ogg_columns(spark):
    got = ogg.media_columns(docs(spark, None, "", "é", "é", "x" * 64), keep_media=True).orderBy("doc_id").collect()
    assert [r["n_bytes"] for r in got] == [0, 0, 2, 2, 64] and all(r["payload_bytes"] == 64 for r in got)
    assert got[2]["media_sha256"] == got[3]["media_sha256"] == hashlib.sha256(got[2]["media"]).hexdigest()
    assert got[0]["tail_crc32"] == zlib.crc32(bytes(64))


# ---- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_kd_leaves_are_even(spark, hot):
    r = random.Random(3)
    rows = [(i, "big" if hot and i % 3 else f"s{i % 17}", r.randint(1, 1000) if i % 50 else 5000) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = sharding.slots(sharding.kd_partition(frame, ["source", "size", "doc_id"], "size", ["doc_id"], shards=7), "_shard", ["doc_id"], 4000).collect()
    sums, slots = Counter(), defaultdict(list)
    for x in got:
        sums[x["_shard"]] += x["size"]
        slots[x["_shard"]].append(x["_slot"])
    assert set(sums) == set(range(7)) and max(sums.values()) - min(sums.values()) < 0.06 * sum(sums.values()) / 7
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_kd_target(spark):
    frame = spark.range(1000).selectExpr("id doc_id", "10L size")
    assert sharding.kd_partition(frame, ["doc_id"], "size", ["doc_id"], target=1000).select("_shard").distinct().count() == 10


# ---- 5 ---------------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    n = suffixes.LENGTH
    first = {}
    for i, b in sorted(rows):
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    out = []
    for i, b in rows:
        f = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                f[p : p + n] = True
        runs = np.count_nonzero(np.diff(np.concatenate([[0], f.astype(np.int8)])) == 1)
        out.append((i, len(b), int(f.sum()), int(runs), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~f])).hexdigest()))
    return sorted(out)


def test_shared_marks_are_a_row_per_place_and_then_per_document():
    passage = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))
    texts = [f"{passage} and {i} words of document number {i * 7919} alone {'x' * (i % 5)}" for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(range(a, a + 20)), pa.int64()), pa.array(texts[a : a + 20])], ["row", "text"]) for a in (0, 20, 40)]
    marked = pa.Table.from_batches([suffixes._marks(b, 8) for b in batches]).sort_by("part")
    shared = pa.Table.from_batches(suffixes._shared(iter(marked.to_batches()), 4)).sort_by("place")
    assert shared.num_rows == 4
    got = pa.Table.from_batches(suffixes._by_document(iter(shared.to_batches()))).to_pylist()
    assert sorted(r["row"] for r in got) == list(range(60))
    own = [set((suffixes._all_runs(t.encode())[2] >> np.uint64(32)).tolist()) for t in texts]
    for r in got:
        others = set().union(*(m for i, m in enumerate(own) if i != r["row"]))
        assert set(np.frombuffer(r["blob"], np.uint32).tolist()) == own[r["row"]] & others


@pytest.mark.parametrize(("seed", "hot"), [(0, 5000), (1, 5000), (2, 5000), (3, 5000), (0, 2), (1, 2), (2, 2), (3, 2)])
def test_repeats_as_by_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffixes, "HOT_DOCS", hot)
    r = random.Random(seed)
    alphabet = ["ab", "abcdefghijklmnop ", "é ñ", "a"][seed]
    pool = ["".join(r.choice(alphabet) for _ in range(r.randint(20, 150))) for _ in range(12)]
    texts = []
    for _ in range(120):
        kind = r.random()
        if kind < 0.2 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.4 and texts:
            t = r.choice(texts) or "x"
            k = r.randrange(len(t))
            texts.append(t[:k] + r.choice(["", "q", "zz"]) + t[k + 1 :])
        else:
            texts.append("".join(r.choice([r.choice(pool), "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))]) for _ in range(r.randint(0, 5))))
    ids = [r.randrange(100) for _ in texts]
    got = suffixes.remove_repeats(docs(spark, *texts, ids=ids)).collect()
    assert sorted(tuple(x) for x in got) == brute_repeats([(i, t.encode()) for i, t in zip(ids, texts)])


def test_repeats_in_long_runs(spark):
    texts = ["a" * 5000, "b" + "a" * 700 + "b", None, "a" * 49, "a" * 50]
    got = suffixes.remove_repeats(docs(spark, *texts), keep_text=True).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0, 700, 0, 0, 50] and got[1]["kept"] == b"bb"


def test_repeats_by_ids_that_are_no_numbers(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(80)) for _ in range(6)]
    ids = [None if i == 3 else f"id{i % 10}" for i in range(24)]
    rows = [(i, (texts[n % 6] + texts[n * 5 % 6])[n % 7 :]) for n, i in enumerate(ids)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    number = {v: i for i, v in enumerate(sorted({i for i in ids if i}))} | {None: 99}
    assert sorted((number[x["doc_id"]], *x[1:]) for x in got) == brute_repeats([(number[i], t.encode()) for i, t in rows])


def test_hot_runs_are_parted_by_their_windows():
    r = random.Random(2)
    for _ in range(200):
        data = bytes(r.choice(b"ab") for _ in range(r.randint(90, 400))) if r.random() < 0.5 else bytes([97]) * r.randint(60, 200)
        for s, n, m in zip(*suffixes._all_runs(data)):
            _, places = suffixes._leads(data, np.array([s]), np.array([m]))
            place, at = int(places[0]), int(s)
            gram = data[place : place + suffixes.GRAM]
            for start, count, key in suffixes._fine(data, int(s), int(n), place):
                assert start == at and count > 0
                at += count
                for w in range(start, start + count):  # the key follows from the window alone
                    o = data.find(gram, w) - w
                    low, high = (1 << o.bit_length()) >> 1, min((1 << o.bit_length()) - 1, 34)
                    assert key == bytes([o.bit_length()]) + data[w : w + 50][o - low : o + 16 + 34 - high]
            assert at == s + n


def test_multikey_order():
    rows = np.random.default_rng(0).integers(0, 3, (500, 4)).astype(np.uint64)
    order, differs = suffixes.multikey_order(rows)
    ranked = [tuple(x) for x in rows[order].tolist()]
    assert ranked == sorted(map(tuple, rows.tolist()))
    assert differs.tolist() == [True, *[a != b for a, b in zip(ranked, ranked[1:])]]


# ---- 6 ---------------------------------------------------------------------------------------------------------------


def brute_links(rows, similarity=0.8):
    def cut(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for _, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        label[i] = min(rows[j][0] for j in seen)
    return sorted((rows[i][0], label[i], len(near[i])) for i in range(n))


def near_texts(seed, groups=8, size=30):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " ", "one two", "one two", "one two three"]
    for _ in range(groups):
        base = [word() for _ in range(r.choice([6, 40, 150]))]
        for _ in range(r.randint(1, size)):
            t = base[:]
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t) + (f"\n{line}" if r.random() < 0.5 else ""))
    return texts


@pytest.mark.parametrize(("seed", "small"), [(0, 1000), (1, 12)])
def test_links_as_by_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)  # small buckets: all levels and block pairs come into play
    monkeypatch.setattr(chosen_path, "BLOCK_SETS", 16)
    texts = near_texts(seed)
    got = chosen_path.near_duplicates(docs(spark, *texts)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_links(list(enumerate(texts)))


def test_one_of_each(spark):
    kept = chosen_path.one_of_each(docs(spark, "a b c d e f g", "a b c d e f g", "x y", None, "a b c d e f g", "a b c d e f g", ids=[4, 2, 7, 8, 2, 9]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8]


def test_one_of_each_by_rows(spark):
    near = [" ".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"[: n]) for n in (36, 35, 34)]  # similar at 0.8 or more
    far = [x.upper().replace(" ", "_ ") for x in near]
    other = " ".join(f"w{i}" for i in range(40))
    ids = [None, None, None, None, None, 5, 5, 3, 6, None]
    texts = [near[0], near[1], far[0], far[1], other, other, near[2], far[2], None, "z z"]
    kept = chosen_path.one_of_each(docs(spark, *texts, ids=ids)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(5, other), (5, near[2]), (3, far[2]), (6, None), (None, "z z")])
    lone = chosen_path.one_of_each(docs(spark, near[0], near[1], f"{other} x", other, near[2], ids=[None, None, 7, 7, 7])).collect()
    assert len(lone) == 2 and {r["doc_id"] for r in lone} == {7}


def test_runs_reach_recall():
    r = np.random.default_rng(0)
    runs, met = chosen_path.runs_for(0.999), 0
    for _ in range(300):
        tokens = np.unique(r.integers(0, 1 << 63, 110, dtype=np.uint64))
        a, b = np.sort(tokens[:100]), np.sort(tokens[11:111])  # similarity 0.8 or a little more
        x, y = chosen_path.first_paths(a, runs), chosen_path.first_paths(b, runs)
        for _ in range(chosen_path.DEPTH - 1):
            x, y = chosen_path.longer_paths(a, x), chosen_path.longer_paths(b, y)
        met += bool(set(x.tolist()) & set(y.tolist()))
    assert met >= 296


def test_sketches_leave_the_recall():
    met = 1.0
    for _ in range(chosen_path.DEPTH):
        met = 1 - math.exp(-min(1.0, 2 / 1.8) * met)
    runs = (1 - met) ** chosen_path.runs_for(chosen_path.RECALL)
    for n in range(1, chosen_path.SKETCH + 1):
        least = n * (0.8 - chosen_path.ERRORS * 0.4 / math.sqrt(n))
        missed = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n + 1) if k < least)
        assert missed < 1e-6 and runs + missed <= 1 - chosen_path.RECALL


def test_shingles():
    text = "the quick  brown\tfox jumps over the lazy dog"
    assert len(shingles.shingle_set(text.encode())) == 5
    assert shingles.shingle_set(b" a  b ").tolist() == shingles.shingle_set(b"a b").tolist()
    assert len(shingles.shingle_set(b"")) == len(shingles.shingle_set(b" \n")) == 0
    long = " ".join(str(i) for i in range(400_000)).encode()
    old, shingles.BLOCK = shingles.BLOCK, 1 << 30
    whole = shingles.word_hashes(long)
    shingles.BLOCK = old
    assert (shingles.word_hashes(long) == whole).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 203), (202, 203), (300, 300), (203, 200)] + [(500, 600 + i) for i in range(40)]
    r.shuffle(edges)
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 204)}, **{i: 500 for i in [500, *range(600, 640)]}}


# ---- 7 ---------------------------------------------------------------------------------------------------------------


def brute_mix(rows, seed="mix"):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for _, t, s in rows:
        sums[s] += size(t)
    order = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [s for s in sums if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, left, target = set(order), 1.5 * sum(sums.values()), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > 2 * sums[s]}
        for s in over or open_:
            target[s] = 2.0 * sums[s] if over else rate * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = []
    for s in order:
        budget = math.floor(target[s] + 0.5)
        whole, rest = divmod(budget, sums[s]) if sums[s] else (0, 0)
        for i, t, _ in sorted((x for x in rows if x[2] == s), key=lambda x: (hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest(), x[0], size(x[1]))):
            cut = min(size(t), rest)
            rest -= cut
            taken.append((i, size(t), whole * size(t) + cut))
    return sorted(taken), target


def test_mix_as_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, None if i % 40 == 0 else " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60))), r.choice(["a", "b", "c", "d", "é", None, "a", "a"])) for i in range(500)]
    frame = docs(spark, *(t for _, t, _ in rows), ids=[i for i, _, _ in rows], sources=[s for _, _, s in rows])
    got = mixing.mix_sources(frame).collect()
    taken, target = brute_mix(rows)
    assert sorted((x["doc_id"], x["_size"], x["_taken"]) for x in got) == taken
    assert all(abs(x["_target"] - target[x["source"]]) < 1e-6 for x in got)
    for s, t in target.items():
        assert sum(x["_taken"] for x in got if x["source"] == s) == math.floor(t + 0.5)
    mixed = mixing.mixed_documents(frame.withColumn("_size", F.lit("mine"))).collect()
    words = Counter()
    for x in mixed:
        words[x["doc_id"]] += len(x["text"].split())
        assert x["_size"] == "mine" and x["n_chars"] == len(x["text"])
        assert next(t for i, t, _ in rows if i == x["doc_id"]).startswith(x["text"])
    assert sorted((i, n) for i, _, n in taken if n) == sorted(words.items())


# ---- 8 ---------------------------------------------------------------------------------------------------------------


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 30):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
        assert all(1 in c and -1 in c for c in code.T.tolist())
    assert langid.codewords(1).shape == (1, 0)


def test_held_out_accuracy(spark):
    r = random.Random(6)
    stems = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 6))) for _ in range(60)] for k, v in {"x": "aeioubcd", "y": "aeoulmnr", "z": "uyöäkts", "v": "жзийклмн"}.items()}
    rows = [(i, " ".join(r.choice(stems[k]) for _ in range(40)), k, "s", 0) for i in range(400) for k in [r.choice("xyzv")]]
    frame = table(spark, [*rows, (900, None, "x", "s", 0), (901, "12 34 !?", "x", "s", 0), (902, "unlabelled", None, "s", 0)])
    got = {x["doc_id"]: x for x in langid.identify(frame, langid.learn(frame)).withColumn("h", langid.held_out(F.col("doc_id"))).collect()}
    assert sum(got[i]["h"] for i, *_ in rows) > 50
    assert all(got[i]["lang_pred"] == k for i, _, k, *_ in rows if got[i]["h"])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0.0
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert got[0]["h"] == (zlib.crc32(b"0") % 4 == 2)


def test_mixture_is_ambiguous():
    x = np.array([langid.features(t) for t in ["aba bab abab " * 9, "cdc dcd cdcd " * 9] * 20])
    model = langid.fit(x, ["a", "c"] * 20)
    first, second, odds = model.decode(np.array([langid.features("aba bab cdc dcd " * 20), langid.features("aba bab " * 9)]))
    assert abs(odds[0, 0] - odds[0, 1]) < langid.MARGIN < odds[1].max() - odds[1].min()


def test_features_of_blocks(monkeypatch):
    text = "some words in a row, " * 400
    whole = langid.features(text)
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert (langid.features(text) == whole).all()


# ---- 9 ---------------------------------------------------------------------------------------------------------------

_EMAIL, _IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD, _PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in _EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_plain_patterns():
    r = random.Random(8)
    for _ in range(8000):
        t = "".join(r.choice("0123.@+a- (2)5é_%") for _ in range(r.randint(0, 70)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1." * 200_000, "a@" * 200_000):
        pii.base_spans(t)


def test_masks(spark):
    text = "write a@b.co or 10.0.0.1, é"
    got = pii.personal_data(docs(spark, text, None), keep_masked=True).orderBy("doc_id").collect()
    assert got[0]["masked"] == "write [EMAIL] or [IP], é" and got[0]["spans"] == "email:6:12,ip:16:24"
    assert got[0]["base_sha256"] == hashlib.sha256(b"email:6:12,ip:16:24").hexdigest()
    assert (got[1]["masked"], got[1]["spans"], got[1]["n_email"]) == ("", "", 0)
    assert "masked" not in pii.personal_data(docs(spark, text)).columns
    fresh = pii.mask_documents(docs(spark, text, None)).orderBy("doc_id").collect()
    assert fresh[0]["n_chars"] == len(fresh[0]["text"]) == 24 and fresh[1]["text"] is None


# ---- 10 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_fullest(seed):
    r = random.Random(seed)
    available = sorted(((n, r.randint(1, 5)) for n in r.sample(range(1, 40), r.randint(0, 6))), reverse=True)
    room = r.randint(0, 60)
    sums = {0}
    for n, c in available:
        sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
    chosen = packing.fullest(available, room)
    assert sum(n * k for n, k in chosen) == max(sums)
    assert all(k <= dict(available)[n] for n, k in chosen)


def test_plan_uses_every_piece():
    r = random.Random(0)
    counts = {n: r.randint(1, 50) for n in r.sample(range(1, 101), 60)}
    plan, used = packing.plan_bins(counts, 100), Counter()
    for times, chosen in plan:
        assert sum(n * k for n, k in chosen) <= 100
        for n, k in chosen:
            used[n] += k * times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    least = max(math.ceil(total / 100), sum(c for n, c in counts.items() if n > 50))  # two pieces over half never share a bin
    assert sum(t for t, _ in plan) <= 1.02 * least + 3


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    r = random.Random(7)
    texts = [None, "", "Hello, World", " ".join("".join(r.choice("abcdeÉß'12,.") for _ in range(r.randint(1, 8))) for _ in range(5000)), "Hello, World", "a\x1cb 　c\x85d", "x <|endoftext|> y"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    got = packing.pack_documents(docs(spark, *texts), tokenizer_path()).collect()
    bins, seen = defaultdict(list), Counter()
    for x in got:
        part = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == x["ids_crc32"] and x["start"] == 2048 * x["piece"]
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
        seen[x["doc_id"]] += x["length"]
    assert seen == {i: len(v) for i, v in ids.items()}
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 2048
