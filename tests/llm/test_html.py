"""Windows of lines against a plain version, names of surroundings, markup of any shape in linear time."""

import itertools
import os
import random
import re
import time
from html import unescape

import pytest
from test_small import PARAGRAPH, table

from gneiss.llm import html

SMALL = "/root/testdata/sf0.001"


def windows_kept(weights, threshold):
    """By the definition: between two dives, from the line that the first surging window begins with, and back up its slope."""
    n = len(weights)
    sums = [sum(weights[i : i + html.WINDOW]) for i in range(n)]
    kept = set()
    for run in itertools.groupby(range(n), key=lambda i: sums[i] > 0):
        places = list(run[1])
        surge = [i for i in places if run[0] and sums[i] >= threshold]
        if surge:
            first = next(k for k in range(surge[0], n) if weights[k])
            while first and weights[first - 1]:
                first -= 1
            kept |= set(range(first, places[-1] + 1))
    return kept


@pytest.mark.parametrize("seed", range(40))
def test_stretches_as_by_brute_force(seed):
    r = random.Random(seed)
    weights = [r.choice([0, 0, 0, 5, 30, 90]) for _ in range(r.randint(0, 60))]
    for threshold in (1, 80):
        assert {i for a, b in html.surges(weights, threshold) for i in range(a, b)} == windows_kept(weights, threshold)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_windows_decide_on_every_page(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    decided = 0
    for page in pages:
        lines, weights, _, own = html.weighted_lines(page)
        kept = windows_kept(weights, 1)
        decided += bool(windows_kept(weights, html.SURGE))
        if len({*own} - {0}) == 1:  # else lighter parts may go
            assert html.main_text(page) == "\n".join(lines[i].text for i in sorted(kept) if own[i])
    assert decided >= 0.9 * len(pages) > 0


def plain_article(page):
    """The text of the one article element of a page without anything else in it, by its tags alone."""
    inner = re.sub(r"<br\s*/?>", " ", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
    texts = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_texts_of_whole_tables(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()} == want


def test_windows_drop_lists_of_links_in_an_article():
    links = "<p><a href=x>a line of links</a></p>"
    page = f"<article>{links * 3}<p>{PARAGRAPH}</p>{links * 40}<p>{PARAGRAPH}</p>{links}<p>End.</p>{links * 5}</article>"
    lines, weights, _, own = html.weighted_lines(page)
    assert len({*own}) == 1 and weights.count(0) == 49
    assert html.main_text(page) == f"{PARAGRAPH}\n{PARAGRAPH}\na line of links\nEnd."
    assert html.main_text(f"<article>{links}</article>") == ""


@pytest.mark.parametrize("teaser", ["<div><p>Teaser one is here</p><p>Teaser two is here</p><p>And a third</p></div>", "<section><h3>More</h3><p>Short words</p><p>And others</p></section>"])
def test_windows_drop_teasers_without_names(teaser):
    body = f"<div><h1>Head</h1><p>{PARAGRAPH}</p><p>Yes.</p><p>No.</p><p>So.</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>Bye.</p></div>"
    want = "\n".join(["Head", PARAGRAPH, "Yes.", "No.", "So.", PARAGRAPH, PARAGRAPH, "Bye."])
    assert html.main_text(f"<body>{body}</body>") == want
    for page in (f"<body>{teaser}{body}</body>", f"<body>{body}{teaser}</body>", f"<body>{teaser}{body}{teaser}</body>"):
        _, weights, _, own = html.weighted_lines(page)
        assert not own and len([w for w in weights if w]) > 8  # they weigh something, and the windows dive
        assert html.main_text(page) == want


def test_a_footer_is_no_page_beside_a_short_article():
    assert html.main_text("<nav><a href=a>a</a></nav><article><h1>Short.</h1><p>Short too.</article><footer>" + PARAGRAPH + "</footer>") == "Short.\nShort too."


@pytest.mark.parametrize("seed", range(60))
def test_pages_made_of_known_parts(seed):
    """Pages put together from articles and surroundings: the article's blocks come back, whatever is around them."""
    r = random.Random(seed)
    long = lambda: " ".join(r.choice(PARAGRAPH.split()) for _ in range(r.randint(30, 60)))
    blocks = [("h1", "A head")] + [("p", long()) if r.random() < 0.7 else (r.choice(["p", "li", "h2", "blockquote"]), r.choice(["Yes.", "A &amp; b", "Not so", "Well: &#233;"])) for _ in range(r.randint(2, 12))] + [("p", long())]
    links = "".join(f"<li><a href=x{i}>{r.choice(['Home', 'About us', 'More of it'])}</a></li>" for i in range(r.randint(3, 9)))
    around = [f"<nav><ul>{links}</ul></nav>", f"<footer>{long()}</footer>", f"<aside><p>{long()}</p></aside>", f"<div class='cookie-banner'>{long()}</div>", f"<form><label>Name</label><input><button>Go</button></form>", f"<script>{long()}</script>", f"<ul>{links}</ul>", f"<!-- {long()} -->", f"<section id=comments><p>{long()}</p></section>"]
    inner = "".join(f"<{t}>{x}</{t}>" + (r.choice(around) if r.random() < 0.2 else "") for t, x in blocks)
    page = "".join(r.sample(around, r.randint(0, 4))) + r.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<div><article>{}</article></div>"]).format(inner) + "".join(r.sample(around, r.randint(0, 4)))
    assert html.main_text(f"<!doctype html><html><head><title>t</title></head><body>{page}</body></html>") == "\n".join(unescape(x) for _, x in blocks)


def test_a_short_part_far_off_is_no_article():
    links = "<p><a href=a>one link</a></p>" * 5
    page = f"<article><p>{PARAGRAPH}</p></article>{links}<article class='card'><p>teaser</p></article>"
    assert html.main_text(page) == PARAGRAPH
    assert html.main_text("<article><p>a few</p><p>short</p><p>lines</p></article>") == "a few\nshort\nlines"


@pytest.mark.parametrize(
    ("names", "stays"),
    [
        ("form-factor", True), ("menu-history", True), ("search-theory", True), ("legal-analysis", True), ("banner-bearers", True), ("article-lead", True), ("adverse", True),
        ("cookie-banner", False), ("ad", False), ("ad-slot-3", False), ("site-nav", False), ("reader-comments", False), ("nav_main", False), ("SideBar sidebar", False), ("post-share-buttons", False), ("c-newsletter__signup", False), ("relatedArticles", False),
    ],
)
def test_names_of_surroundings(names, stays):
    for tag in ("p", "div", "section"):
        page = f"<article><p>{PARAGRAPH}</p><{tag} class='{names}'>held text</{tag}><p>end</p></article>"
        assert html.main_text(page) == "\n".join([PARAGRAPH, *["held text"] * stays, "end"])


def test_formulas_are_text():
    assert html.main_text(f"<article><p>{PARAGRAPH}</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == f"{PARAGRAPH}\nso x=2 holds"


def test_stray_and_open_tags_take_linear_time():
    """Four times the markup takes at most seven times the processor time: its square would take sixteen times."""

    def took(head, unit, n):
        began = time.process_time()
        html.main_text(head + unit * n + "</i>" * n)
        return time.process_time() - began

    for unit in ("<div></i>", "<i><hr>", "<b><hr>", "</script ", "<header><h1>x", "<p class='ad'>x", "<table><td>", "<div><div></p>", "<li><b>"):
        for head in ("", "<i>", "<script>", "<i>" + "<div>" * 2_000):
            assert any(took(head, unit, 12_000) < 7 * took(head, unit, 3_000) + 0.1 for _ in range(3)), (head[:10], unit)


def test_empty_table_and_repeats(spark):
    rows = table(spark, [(1, "u", f"<p>{PARAGRAPH}")] * 2, "page_id long, url string, html string")
    assert [(r["page_id"], r["text"]) for r in html.extract_pages(rows).collect()] == [(1, PARAGRAPH)] * 2
    empty = html.extract_pages(rows.where("false"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]
