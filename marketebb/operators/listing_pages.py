"""Jobs over saved result pages: crawl plan, items of a page, page checks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketebb.functions import text

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CELL = "item-cell"
STICKER = "thumbnail-sticker"
NAME = "thumbnail-item-name"
# Fixed values
SOLD_LABEL = "売り切れ"
ALT_SUFFIX = "のサムネイル"

#: Cells that a task holds before it hands them on.
ROWS_AT_ONCE = 2_000
CELL_SCHEMA = "href string, name string, alt string, src string, sticker string, prices array<string>"


_TOKEN = re.compile(
    r"""<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|([^<]+)""", re.S | re.I
)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): html.unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(raw)}


def _price_rank(tag: str, test_id: str, classes: str) -> int | None:
    """Order in which price texts are tried; a number node inside a price node goes first."""
    if tag == "span" and classes.startswith("number"):
        return 0
    if "merPrice" in classes.split():
        return 1
    if tag == "span" and classes.startswith("merPrice"):
        return 2
    return 3 if test_id == "price" else None


def _cells_of(page: str) -> Iterator[dict]:
    """Raw pieces of each item cell of a page: first link, image, sticker, name, and price texts."""
    cell, boxes = None, []
    stack: list[tuple[str, list | None]] = []  # open tags inside the cell, with where their text goes
    for token in _TOKEN.finditer(page):
        closing, tag, raw, data = token.group(2, 3, 4, 5)
        if data is not None:
            for _, sink in stack:
                if sink is not None:
                    sink.append(data)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if cell is not None and any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                if not stack:
                    yield _finished(cell, boxes)
                    cell = None
            continue
        if cell is None and CELL not in raw:
            continue
        at = _attributes(raw)
        test_id, classes = at.get("data-testid", ""), at.get("class", "")
        if cell is None:
            if test_id != CELL:
                continue
            cell, boxes, stack = dict.fromkeys(("href", "name", "alt", "src", "sticker")), [], []
        sink = None
        if tag == "a" and cell["href"] is None:
            cell["href"] = at.get("href", "")
        elif tag == "img" and cell["alt"] is None and cell["src"] is None:
            cell["alt"], cell["src"] = at.get("alt"), at.get("src")
        if test_id == STICKER and cell["sticker"] is None:
            cell["sticker"] = at.get("aria-label", "")
        elif test_id == NAME and cell["name"] is None:
            sink = cell["name"] = []
        rank = _price_rank(tag, test_id, classes)
        if rank is not None:
            sink = []
            boxes.append((rank, sink))
        if tag not in VOID and not raw.endswith("/"):
            stack.append((tag, sink))
    if cell is not None:
        yield _finished(cell, boxes)


def _finished(cell: dict, boxes: list) -> dict:
    """Texts joined; number nodes count only inside a price node."""
    tried = sorted(boxes, key=lambda b: b[0]) if any(rank > 0 for rank, _ in boxes) else []
    cell["prices"] = [html.unescape("".join(parts)) for _, parts in tried]
    cell["name"] = None if cell["name"] is None else html.unescape("".join(cell["name"])).strip()
    return cell


def cells(pages: DataFrame) -> DataFrame:
    """One row per item cell of each page: link, name, image, sticker and price texts."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "pos", "href", "name", "alt", "src", "sticker", "prices"]
        for batch in batches:
            rows = []
            for page_id, page in zip(batch["page_id"], batch["html"], strict=True):
                rows += [(page_id, pos, c["href"], c["name"], c["alt"], c["src"], c["sticker"], c["prices"]) for pos, c in enumerate(_cells_of(page or ""))]
                if len(rows) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    marked = pages.select("page_id", "html").filter(F.contains("html", F.lit(CELL)))
    return marked.mapInPandas(parse, f"page_id long, pos int, {CELL_SCHEMA}")


def items(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of result pages: the first of each listing id on a page, with a ``limit`` at most so many per page.

    Cells without a link or a price are place holders and drop out.
    """
    raw = cells(pages).filter(F.col("href").isNotNull())
    prices = F.filter(F.transform("prices", text.price_value), lambda p: p.isNotNull())
    listing = text.listing_id(F.col("href"))
    title = F.coalesce("name", F.regexp_replace("alt", ALT_SUFFIX + "$", ""), F.lit(""))
    found = (
        raw.withColumn("source_id", listing)
        .withColumn("price", F.get(prices, F.lit(0)).cast("int"))
        .filter(F.col("price").isNotNull() & (F.col("source_id") != ""))
        .withColumn("title", title)
        .withColumn(
            "image_url",
            F.when(F.startswith("source_id", F.lit("m")), F.format_string(text.IMAGE_URL, "source_id")).otherwise(
                F.coalesce("src", F.lit(""))
            ),
        )
        .withColumn("item_url", text.absolute_url(F.col("href")))
        .withColumn(
            "status",
            F.when(F.contains(F.coalesce("sticker", F.lit("")), F.lit(SOLD_LABEL)), "sold").otherwise("on_sale"),
        )
    )
    return first_per_page(found, limit).select(
        "page_id", "pos", "source_id", "title", "price", "image_url", "item_url", "status"
    )


def first_per_page(found: DataFrame, limit: int | None = None) -> DataFrame:
    """First row of each source_id on a page, with a ``limit`` only the first ids of the page by position.

    Copies combine before the shuffle, and the per-page limit is applied on both sides of it.
    """
    fields = [c for c in found.columns if c not in ("page_id", "source_id")]
    first = found.groupBy("page_id", "source_id").agg(F.min_by(F.struct(*fields), "pos").alias("f"))
    flat = first.select("page_id", "source_id", "f.*")
    if limit is None:
        return flat
    w = Window.partitionBy("page_id").orderBy("pos", "source_id")
    return flat.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def merge_status_pages(on_sale: DataFrame, sold: DataFrame) -> DataFrame:
    """Items of on-sale and sold pages together, the status forced by the kind of page."""
    return on_sale.withColumn("status", F.lit("on_sale")).unionByName(sold.withColumn("status", F.lit("sold")))


def used_pages(page_counts: DataFrame) -> DataFrame:
    """Pages up to and including the first empty one, per task and status.

    Input: task_id, status, page, items (NULL for a failed page, which neither counts nor stops).
    """
    empty = page_counts.filter(F.col("items") == 0).groupBy("task_id", "status").agg(F.min("page").alias("stop"))
    kept = page_counts.join(empty, ["task_id", "status"], "left")
    return kept.filter(F.col("items").isNotNull() & (F.col("stop").isNull() | (F.col("page") <= F.col("stop")))).drop(
        "stop"
    )


def crawl_plan(entities: DataFrame, pages_on_sale: int = 5, pages_sold: int = 5) -> DataFrame:
    """Every result page to visit: active entity x status x page, with its URL.

    Entities without a name are left out.
    """
    wanted = F.array(
        F.struct(F.lit("on_sale").alias("status"), F.lit(pages_on_sale or 5).alias("pages")),
        F.struct(F.lit("sold").alias("status"), F.lit(pages_sold or 5).alias("pages")),
    )
    return (
        entities.filter((F.col("status") == "active") & (F.length("name") > 0))
        .select(F.col("id").alias("ip_id"), F.col("name").alias("keyword"), F.explode(wanted).alias("w"))
        .select("ip_id", "keyword", F.col("w.status").alias("status"), F.explode(F.sequence(F.lit(0), F.col("w.pages") - 1)).alias("page"))
        .withColumn("url", text.search_url(F.col("keyword"), F.col("status"), F.col("page")))
    )


def page_checks(pages: DataFrame) -> DataFrame:
    """Title, block type and the blocked / no-items flags of each page."""
    titled = pages.select(
        "page_id",
        "url",
        "html",
        text.page_title(F.col("html")).alias("title"),
        F.lower("html").alias("low_html"),
        text.body_text(F.col("html")).alias("body"),
    ).withColumn("low_title", F.lower("title"))
    return titled.select(
        "page_id",
        "title",
        text.block_type(F.col("title"), F.col("html"), F.col("low_title"), F.col("low_html")).alias("block_type"),
        text.is_blocked(F.col("title"), F.col("url"), F.col("body")).alias("is_blocked"),
        text.is_no_items(F.col("html"), F.col("body")).alias("is_no_items"),
    )
