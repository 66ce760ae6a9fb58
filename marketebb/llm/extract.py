"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of tags and words. Words score above zero, tags below; words of links, and of elements that by tag, class or
role are no content (menus, forms, notices, adverts, comments and the like), have weights of their own. One linear scan finds the contiguous run
of the greatest score. The weights are log-odds learned from labelled pages: those that mark their content themselves, by a single
``article`` or ``main`` element. They are counted on pages whose hash falls under a share that gives about ``sample`` pages, in
one job without a shuffle of pages; without labelled pages fixed weights hold.

The run is then completed: it grows to the nearest ``article`` or ``main`` around it, else to the nearest container, so that short
paragraphs at its ends are not lost; elements that are no content are left out. Runs directly under ``body`` grow over neighbouring
paragraphs. Character references are decoded; each white space within a block becomes one blank, blocks are joined by one.

Scripts, styles and comments are skipped as a whole; an end tag closes what is open within; a boilerplate element that is never closed ends where
an ``article`` or ``main`` begins. White space is U+0009 to U+000D and U+0020.

Nulls: a null html is an empty page and gives an empty text; page_id and url pass through. Of runs with equal score the first counts.
Equal rows give equal rows. Pages are treated one by one and whole, however long.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, SMOOTH, LEAST = 4_000, 0.5, 0.05
#: Bounds of the learned weights, so that no single tag or word decides however many pages were counted.
MOST_WORD, MOST_TAG = 1.0, -5.0
#: Weights without labelled pages; other tags weigh ``tag``.
DEFAULT = {"word": 1.0, "link": -1.0, "other": -2.0, "tag": -1.0}

_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|select|button)\b{_ATTRIBUTES}(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*>"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>\"']*)(?P<rest>{_ATTRIBUTES})>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"[\x09-\x0D\x20]+")
PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr figure figcaption".split())
CONTENT = frozenset(("article", "main"))
#: Elements that hold no content, by tag, by a part of their class or id, by role.
NO_CONTENT = frozenset("head nav footer aside form dialog menu object audio video canvas fieldset".split())
NO_CONTENT_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs masthead topbar "
    "footer sidebar widget cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup comment comments disqus respond replies "
    "share sharing social related recommended recommendations login search".split()
)
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())


def no_content(name: str, rest: str, in_content: bool) -> bool:
    """Whether an element is no content; a header is one unless it stands in the content."""
    if name in NO_CONTENT or name == "header" and not in_content:
        return True
    if not rest or name in CONTENT or name in ("html", "body"):
        return False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and not NO_CONTENT_PARTS.isdisjoint(PART.findall(value)):
            return True
        if key == "role" and value in NO_CONTENT_ROLES or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$|=)", rest))


class Page:
    """Tokens of a page: (feature, words, element, text) with text for words and None for tags; element tree by parents."""

    def __init__(self, source: str) -> None:
        self.names, self.parents, self.other, self.closed = [""], [0], [False], [True]
        self.tokens: list[tuple[str, int, int, str | None]] = []
        self.spans: dict[int, list[int]] = {}
        self.links, self.contents, self.open = 0, 0, Counter()
        stack, at = [0], 0
        for m in TOKEN.finditer(source):
            self._text(source[at : m.start()], stack)
            at = m.end()
            if m["name"]:
                self._tag(m["name"].lower(), bool(m["end"]), m["rest"], stack)
        self._text(source[at:], stack)

    def _text(self, text: str, stack: list[int]) -> None:
        n = len(text.split())
        if not text:
            return
        top = stack[-1]
        self.tokens.append(("other" if self.other[top] else "link" if self.links else "word", n, top, text))

    def _tag(self, name: str, end: bool, rest: str, stack: list[int]) -> None:
        if end:
            if self.open[name]:
                found = next(i for i in range(len(stack) - 1, 0, -1) if self.names[stack[i]] == name)
                for e in stack[found:]:
                    self._leave(e)
                del stack[found:]
            self.tokens.append((name, 0, stack[-1], None))
            return
        if name in CONTENT:
            self._end_unclosed(stack)
        elif name in PARAGRAPHS or name in ("div", "section"):
            self._end_paragraph(stack)
        self.tokens.append((name, 0, stack[-1], None))
        if name in VOID or rest.endswith("/"):
            return
        e, parent = len(self.names), stack[-1]
        self.names.append(name)
        self.parents.append(parent)
        self.other.append(self.other[parent] or no_content(name, rest, self.contents > 0))
        self._count(name, 1)
        self.spans[e] = [len(self.tokens), -1]
        stack.append(e)

    def _count(self, name: str, n: int) -> None:
        self.open[name] += n
        self.links += n * (name == "a")
        self.contents += n * (name in CONTENT)

    def _leave(self, e: int) -> None:
        self._count(self.names[e], -1)
        self.spans[e][1] = len(self.tokens)

    def _end_paragraph(self, stack: list[int]) -> None:
        """A block ends an open paragraph (and inline elements in it)."""
        if not self.open["p"]:
            return
        for i in range(len(stack) - 1, 0, -1):
            name = self.names[stack[i]]
            if name == "p":
                for e in stack[i:]:
                    self._leave(e)
                del stack[i:]
                return
            if name not in INLINE:
                return

    def _end_unclosed(self, stack: list[int]) -> None:
        """Content may begin in an element that is no content only if that is closed later; ``unclosed`` names those that are not."""
        i = next((i for i, e in enumerate(stack) if e in self.unclosed), 0) if self.unclosed else 0
        if i:
            for e in stack[i:]:
                self._leave(e)
            del stack[i:]

    unclosed: frozenset[int] = frozenset()


def parse(source: str) -> Page:
    """The tokens; a second pass is made where content lies in a boilerplate element that is never closed."""
    page = Page(source)
    open_ = frozenset(e for e, (_, end) in page.spans.items() if end < 0 and page.other[e])
    if open_ and any(page.names[e] in CONTENT and page.other[page.parents[e]] for e in page.spans):
        again = Page.__new__(Page)
        again.unclosed = open_
        again.__init__(source)
        page = again
    for span in page.spans.values():
        if span[1] < 0:
            span[1] = len(page.tokens)
    return page


def counts(page: Page) -> Counter:
    """(inside, feature) -> tokens of a labelled page; empty if the page does not mark its content by one element."""
    marked = [e for e in page.spans if page.names[e] in CONTENT and not page.other[e]]
    outer = []
    for e in marked:  # in page order
        if not outer or page.spans[e][0] >= page.spans[outer[-1]][1]:
            outer.append(e)
    out: Counter = Counter()
    if len(outer) != 1:
        return out
    begin, end = page.spans[outer[0]]
    for i, (feature, n, e, text) in enumerate(page.tokens):
        if begin <= i < end and not page.other[e]:
            out[True, feature] += 1 if text is None else n
        else:
            out[False, feature] += 1 if text is None else n
    return out


def ancestors(page: Page, e: int) -> Iterator[int]:
    while e:
        yield e
        e = page.parents[e]


def log_odds(rows: list[tuple[bool, str, int]]) -> dict[str, float]:
    """Weights of features: words above zero, tags below."""
    inside, outside = Counter(), Counter()
    for within, feature, n in rows:
        (inside if within else outside)[feature] += n
    if not inside.total() or not outside.total():
        return DEFAULT
    kinds = set(inside) | set(outside)
    total = [c.total() + SMOOTH * (len(kinds) + 1) for c in (inside, outside)]
    raw = {k: math.log((inside[k] + SMOOTH) / total[0]) - math.log((outside[k] + SMOOTH) / total[1]) for k in (*kinds, "tag")}
    out = {k: min(max(v, MOST_TAG), -LEAST) for k, v in raw.items()}
    out["word"] = min(max(raw.get("word", LEAST), LEAST), MOST_WORD)
    out["link"] = min(max(raw.get("link", 0.0), MOST_TAG), out["word"] / 2)
    return out


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from about ``sample`` pages chosen by hash; the driver gets one number for each feature."""
    n = max(pages.count(), 1)
    chosen = pages.where(F.pmod(F.xxhash64(*[c for c in ("page_id", "url") if c in pages.columns], F.length("html")), F.lit(n)) < sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text in b["html"]:
                total += counts(parse(text.as_py() or ""))
        known = Counter()
        for (inside, feature), k in total.items():
            known[inside, feature if feature in KNOWN else "tag"] += k
        yield pa.RecordBatch.from_pydict(
            {"inside": pa.array([k[0] for k in known], pa.bool_()), "feature": pa.array([k[1] for k in known], pa.string()), "n": pa.array(list(known.values()), pa.int64())}
        )

    rows = chosen.select("html").mapInArrow(count, "inside boolean, feature string, n long").groupBy("inside", "feature").agg(F.sum("n").alias("n")).collect()
    return log_odds([tuple(r) for r in rows])


#: Features with weights of their own; the rest share one, so their number is bounded.
KNOWN = frozenset((*VOID, *INLINE, *PARAGRAPHS, *CONTENT, *NO_CONTENT, "word", "link", "other", "html", "body", "div", "section", "header", "center", "td", "th", "hgroup", "address"))


def best_run(page: Page, weights: dict[str, float]) -> tuple[int, int]:
    """Tokens from..to (end exclusive) of the run with the greatest score; (0, 0) if none is above zero."""
    best, run = (0.0, 0, 0), (0.0, 0)
    rest = weights["tag"]
    for i, (feature, n, _, text) in enumerate(page.tokens):
        w = weights.get(feature, rest)
        total = run[0] + (w if text is None else w * n)
        if total > best[0] + 1e-9:
            best = (total, run[1], i + 1)
        run = (total, run[1]) if total > 0 else (0.0, i + 1)
    return best[1], best[2]


def completed(page: Page, begin: int, end: int) -> tuple[int, int]:
    """The run, grown to the content element or container around it."""
    words = [t[2] for t in page.tokens[begin:end] if t[3] is not None and t[1] and not page.other[t[2]]]
    if not words:
        return begin, end
    last = set(ancestors(page, max(words)))  # elements are numbered in page order: the first and the last have the ancestors that all share
    common = [e for e in ancestors(page, min(words)) if e in last]
    marked = next((e for e in common if page.names[e] in CONTENT), None)
    if marked is None:
        marked = next((e for e in common if page.names[e] not in INLINE and page.names[e] not in PARAGRAPHS), 0)
    if marked and page.names[marked] not in ("html", "body"):
        return tuple(page.spans[marked])
    near = [False] * len(page.parents)  # within a paragraph of the container
    for e, p in enumerate(page.parents):
        near[e] = bool(e) and (page.names[e] in PARAGRAPHS | INLINE if p == marked else near[p])

    def outside(i: int) -> bool:
        _, n, e, text = page.tokens[i]
        if text is None or not n or e == marked:
            return False
        return page.other[e] or not near[e]

    while begin > 0 and not outside(begin - 1):
        begin -= 1
    while end < len(page.tokens) and not outside(end):
        end += 1
    return begin, end


def main_text(source: str, weights: dict[str, float]) -> str:
    page = parse(source)
    begin, end = best_run(page, weights)
    if begin == end:
        return ""
    begin, end = completed(page, begin, end)
    out = []
    for feature, _, e, text in page.tokens[begin:end]:
        if text is None:
            if feature not in INLINE:
                out.append(" ")
        elif page.other[e]:
            out.append(" ")
        else:
            out.append(entities.unescape(text))
    return SPACE.sub(" ", "".join(out)).strip(" ")


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = fit(pages, sample)
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "", weights) for h in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


#: On the given pages the content is the only article element, without boilerplate inside, and has two kinds of references.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(?:b|i|a|em|strong|span)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
