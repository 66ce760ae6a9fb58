"""Main text of pages of many layouts; the scan against all runs."""

from __future__ import annotations

import random
import time

import pytest

from marketebb.llm import extract

WORDS = "The quick survey of rivers found that most of them had changed course within a century , and two had not moved".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * 7 + seed) % len(WORDS)] for i in range(n))


A, B, C = prose(40), prose(55, 3), prose(3, 5)
ARTICLE = f"<h1>On rivers</h1><p>{A}</p><p>{B}</p><ul><li>one</li><li>two</li></ul><p>{C}</p>"
TEXT = f"On rivers {A} {B} one two {C}"
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav>'
FOOT = f"<footer>&copy; 2020 site &middot; {prose(30)}</footer>"

LAYOUTS = {
    "article": f"<html><head><title>t {A}</title><style>p{{}}</style></head><body>{NAV}<div class='ad'>{prose(12)}</div><article>{ARTICLE}</article>{FOOT}</body></html>",
    "main": f"<body><header><a href=/>Site</a> {prose(9)}</header><main>{ARTICLE}</main><aside>{A}</aside>{FOOT}",
    "divs": f"<body><div id=top><a href=/>x</a> <a href=/y>y</a></div><div class='content'>{ARTICLE}</div><div class=sidebar><p>{A}</p></div><div id='comments'><p>{A}</p><p>{B}</p></div></body>",
    "body": f"<body>{NAV}{ARTICLE}<form>{A}<input name=q></form>{FOOT}</body>",
    "inside": f"<body><article><div class='cookie-notice'>{A}</div><h1>On rivers</h1><p>{A}</p><script>var a='</p>' + \"{B}\";</script><form><p>{B}</p></form><p>{B}</p><aside>{A}</aside>"
    f"<ul><li>one</li><li>two</li></ul><p>{C}</p><div class='share'>Share it</div><section class=comments><p>{A}</p></section></article></body>",
    "unclosed": f"<body><nav><a href=/>a</a> menu <article>{ARTICLE}</article><footer>{A}",
    "paragraphs": f"<body><article><h1>On rivers<p>{A}<p>{B}<ul><li>one<li>two</ul><p>{C}</article>{FOOT}",
    "roles": f"<body><div role=navigation>{A}</div><div role='main'><div>{ARTICLE}</div></div><div role='contentinfo'>{A}</div><div hidden>{A}</div><p style='display: none'>{A}</p>",
    "upper": f"<BODY>{NAV}<ARTICLE>{ARTICLE}</ARTICLE><!-- {A} --><NoScript>{A}</NoScript><div class='cookie banner'>{A}</div>",
}


@pytest.mark.parametrize("weights", [extract.DEFAULT, {"word": 1.0, "link": 0.0, "other": -5.0, "tag": -1.9, "p": -0.05, "h1": -0.05, "div": -5.0, "li": -5.0, "ul": -5.0, "a": -5.0}])
@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name, weights):
    assert extract.main_text(LAYOUTS[name], weights) == TEXT


def test_blocks_and_references():
    page = "<article><p>a<b>b</b>c &amp;amp; &lt;p&gt;&nbsp;x&#32;\n\t y&copy</p>one<br>two<div>th<wbr>ree</div><p> </p>&#x41;</article>"
    assert extract.main_text(page, extract.DEFAULT) == "abc &amp; <p> x y© one two three A"


@pytest.mark.parametrize("page", ["", " ", "<", "<>", "<p", "</p>", "<!--", "<script>", "<article></article>", "<nav>only a menu</nav>", "<a href='x", "<!doctype html>", "&", "<p><p></b></p></article>"])
def test_pages_without_content(page):
    assert extract.main_text(page, extract.DEFAULT) in ("", page.strip() if page in ("<", "<>", "&", "<p", "<a href='x") else "")


def test_time_grows_with_the_page():
    for piece in ("<a ", "<p>", "<p 'x ", '<p "x ', "<!x ", "<script ", "</p>", "<div><p>x", "<nav>", "&amp", "<a href=x>", "<article><p>x "):
        began = time.perf_counter()
        extract.main_text(piece * 20_000, extract.DEFAULT)
        assert time.perf_counter() - began < 8, piece


def test_best_run():
    rng = random.Random(4)
    weights = {"word": 0.7, "tag": -1.1, "b": -0.2, "link": 0.1, "other": -2.0}
    for _ in range(60):
        source = "".join(rng.choice(["<p>", "<b>x", "word two ", "</p>", "<nav>n", "</nav>", "<a>l ", "</a>", "<i>", "three four five "]) for _ in range(rng.randint(0, 40)))
        page = extract.parse(source)
        score = [weights.get(f, -1.1) * (1 if t is None else n) for f, n, _, t in page.tokens]
        best = max([sum(score[a:b]) for a in range(len(score)) for b in range(a, len(score) + 1)], default=0)
        begin, end = extract.best_run(page, weights)
        assert abs(sum(score[begin:end]) - max(best, 0)) < 1e-6


def test_weights_from_labelled_pages(spark):
    pages = spark.createDataFrame([(i, "u", LAYOUTS["article"]) for i in range(30)] + [(99, "u", LAYOUTS["divs"]), (100, None, None)], "page_id long, url string, html string").repartition(3)
    got = extract.fit(pages)
    inside = outside = 0
    for r in pages.collect():
        for (within, _), n in extract.counts(extract.parse(r.html or "")).items():
            inside, outside = inside + n * within, outside + n * (not within)
    assert inside and outside and got["word"] > 0
    assert all(v < 0 for k, v in got.items() if k not in ("word", "link"))
    assert got["nav"] < got["p"] and got["other"] < got["p"]
    assert extract.fit(pages.where("page_id > 98")) == extract.DEFAULT


def test_extract(spark):
    rows = [(i, f"u{i}", h, i, "x") for i, h in enumerate(LAYOUTS.values())] + [(50, None, None, 1, "x"), (None, "n", "", 1, "x"), (60, "l", f"<article><p>{prose(200_000)}</p></article>", 1, "x")]
    rows += [rows[0]] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string").repartition(4)
    got = sorted((tuple(r) for r in extract.extract(pages).collect()), key=str)
    want = [(i, u, TEXT if i is not None and i < 40 else prose(200_000) if i == 60 else "") for i, u, *_ in rows]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)


def test_extract_empty(spark):
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
