"""Text functions: price text, page and error classification, result-page URLs.

All are built-in expressions. The word lists below are fixed values: they must equal the known
list for equal results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------

SITE = "https://jp.mercari.com"
SEARCH_URL = SITE + "/search"
IMAGE_URL = "https://static.mercdn.net/thumb/item/webp/%s_1.jpg"

NO_ITEMS = (
    "出品された商品がありません",
    "該当する商品はありません",
    "検索結果はありません",
    "商品が見つかりません",
    "見つかりませんでした",
    "検索結果がありません",
)
EMPTY_STATE = "merEmptyState"

BLOCKED_TITLE = (
    "just a moment",
    "attention required",
    "access denied",
    "403 forbidden",
    "429 too many",
    "blocked",
    "cloudflare",
)
BLOCKED_TEXT = (
    "cloudflare",
    "attention required",
    "verify you are human",
    "access denied",
    "temporarily unavailable",
    "just a moment",
    "checking your browser",
    "challenge-platform",
    "cf-browser-verification",
    "recaptcha",
    "hcaptcha",
    "captcha",
    "403 forbidden",
    "429 too many requests",
    "blocked",
    "rate limited",
    "too many requests",
    "err_connection",
    "err_proxy",
    "proxy error",
)

CLOUDFLARE = (
    "just a moment",
    "cloudflare",
    "cf-browser-verification",
    "challenge-platform",
    "challenges.cloudflare.com",
    'id="challenge-form"',
    'id="challenge-running"',
    'id="challenge-stage"',
    "turnstile",
    "cf-turnstile",
    "ray id:",
    "please wait",
    "しばらくお待ちください",
    "ブラウザを確認しています",
)
CAPTCHA = (
    "captcha",
    "recaptcha",
    "hcaptcha",
    "verify you are human",
    "私はロボットではありません",
    "認証が必要です",
    "ロボット",
)
FORBIDDEN = (
    "403",
    "forbidden",
    "access denied",
    "アクセスが拒否されました",
    "アクセスできません",
    "このページにアクセスする権限",
    "お探しのページは",
    "エラーが発生しました",
    "サーバーエラー",
    "リクエストを処理できません",
    "不正なアクセス",
    "blocked",
    "denied",
)
RATE_LIMITED = (
    "429",
    "too many requests",
    "rate limit",
    "リクエストが多すぎます",
    "しばらく時間をおいてから",
    "アクセスが集中しています",
    "混み合っています",
    "時間をおいて再度アクセス",
    "temporarily unavailable",
    "service unavailable",
)
SITE_ERROR = (
    "mererrorpage",
    "error-page",
    "page-not-found",
    "something went wrong",
    "問題が発生しました",
    "ページが見つかりません",
    "メンテナンス中",
    "サービスを一時停止",
)
CONNECTION = (
    "err_connection",
    "err_proxy",
    "err_tunnel",
    "err_name_not_resolved",
    "err_internet_disconnected",
    "err_ssl",
    "err_cert",
    "proxy error",
    "connection refused",
    "connection reset",
    "connection timed out",
    "ネットワークエラー",
    "接続できません",
)
NORMAL_MARKUP = ("<body", "meremptystate", "item-cell", "search")
EMPTY_DOCUMENT = "<html><head></head><body></body></html>"

ERROR_CONTEXT = ("context deadline exceeded", "context canceled")
ERROR_BLOCKED = (
    "blocked_page",
    "cloudflare",
    "attention required",
    "access denied",
    "403",
    "429",
    "forbidden",
    "too many requests",
)
ERROR_TIMEOUT = ("timeout", "deadline exceeded")
ERROR_NETWORK = ("net::", "connection", "navigate")
ERROR_PARSE = ("parse", "extract")
PROXY_WORTHY = ("blocked", "timeout", "network_error")

# ------------------------------------------------------------------------------------------------


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text contains one of the words (exact, so lower the text first where needed)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def price_value(text: Column) -> Column:
    """Price in a text, NULL when there is none.

    The first amount behind a currency sign counts; else the longest run of digits (commas left
    out), and of equally long runs the larger value.
    """
    behind_sign = F.replace(F.regexp_extract(text, r"[¥￥]\s*([0-9][0-9,]*)", 1), F.lit(","), F.lit(""))
    runs = F.regexp_extract_all(F.regexp_replace(text, "[¥￥,]", ""), F.lit("([0-9]+)"), F.lit(1))
    measured = F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.try_cast("long").alias("v")))
    best = F.array_max(F.filter(measured, lambda m: m["v"].isNotNull()))
    return F.coalesce(behind_sign.try_cast("long"), best["v"])


def absolute_url(url: Column) -> Column:
    return (
        F.when((url == "") | url.rlike("^https?://"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url))
        .otherwise(F.concat(F.lit(SITE), url))
    )


def listing_id(url: Column) -> Column:
    """Listing id in a link: ``/item/m...`` or ``/shops/product/...``; empty when it has none."""
    tail = F.element_at(F.split(url, "/"), -1)
    return (
        F.when(F.contains(url, F.lit("/item/")), F.when(F.startswith(tail, F.lit("m")), tail).otherwise(""))
        .when(F.contains(url, F.lit("/shops/product/")), F.concat(F.lit("shops_"), tail))
        .otherwise("")
    )


def status_param(status: Column) -> Column:
    return F.when(status == "sold", "sold_out|trading").otherwise("on_sale")


def param_status(param: Column) -> Column:
    return F.when(has_any(param, ("sold_out", "trading")), "sold").otherwise("on_sale")


def _query_escape(text: Column) -> Column:
    """Percent-encoding with %20 for a space; letters, digits and -_.~ stay."""
    encoded = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return encoded


def search_url(keyword: Column, status: Column, page: Column) -> Column:
    """Result-page URL: newest first, one status, pages from 0."""
    word = F.when(F.length(keyword) > 0, F.concat(F.lit("keyword="), _query_escape(keyword), F.lit("&"))).otherwise("")
    token = F.when(page > 0, F.concat(F.lit("&page_token=v1:"), page.cast("string"))).otherwise("")
    return F.concat(
        F.lit(SEARCH_URL + "?"),
        word,
        F.lit("order=desc&sort=created_time&status="),
        _query_escape(status_param(status)),
        token,
    )


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def body_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags removed, white space folded."""
    body = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")
    text = F.regexp_replace(body, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def block_type(title: Column, html: Column, low_title: Column, low_html: Column) -> Column:
    """What kind of blocked page this is; the first matching rule decides.

    The lowered forms are arguments so that a caller projects them once.
    """

    def either(words):
        return has_any(low_html, words) | has_any(low_title, words)

    untitled = (title == "") | (title == "about:blank")
    bare = (F.octet_length(html) < 100) | F.contains(html, F.lit(EMPTY_DOCUMENT))
    tiny = (F.octet_length(html) > 0) & (F.octet_length(html) < 200) & ~has_any(low_html, NORMAL_MARKUP)
    framed = F.contains(low_html, F.lit("iframe")) & F.contains(low_html, F.lit("cloudflare"))
    return (
        F.when(either(CLOUDFLARE) | framed, "cloudflare_challenge")
        .when(has_any(low_html, CAPTCHA), "captcha")
        .when(either(FORBIDDEN), "403_forbidden")
        .when(either(RATE_LIMITED), "429_rate_limited")
        .when(either(SITE_ERROR), "mercari_error_page")
        .when(untitled & bare, "blank_page")
        .when(untitled, "empty_title")
        .when(has_any(low_html, CONNECTION), "connection_error")
        .when(tiny, "suspicious_minimal_page")
        .otherwise("unknown")
    )


def is_no_items(html: Column, text: Column) -> Column:
    return F.contains(html, F.lit(EMPTY_STATE)) | has_any(text, NO_ITEMS)


def is_blocked(title: Column, url: Column, text: Column) -> Column:
    """Whether a loaded page is a block page: blank, tell-tale title, almost no text, or hints."""
    low = F.lower(title)
    blank = ((low == "") | (low == "about:blank")) & ((F.lower(url) == "") | (F.lower(url) == "about:blank"))
    return blank | has_any(low, BLOCKED_TITLE) | (F.octet_length(text) < 50) | has_any(F.lower(text), BLOCKED_TEXT)


def error_class(low_message: Column) -> Column:
    """timeout, blocked, network_error, parse_error or unknown from a lowered message."""
    return (
        F.when(has_any(low_message, ERROR_CONTEXT), "timeout")
        .when(has_any(low_message, ERROR_BLOCKED), "blocked")
        .when(has_any(low_message, ERROR_TIMEOUT), "timeout")
        .when(has_any(low_message, ERROR_NETWORK), "network_error")
        .when(has_any(low_message, ERROR_PARSE), "parse_error")
        .otherwise("unknown")
    )


def proxy_worthy(error: Column) -> Column:
    """Whether a failure of this class is worth another try through a proxy."""
    return error.isin(*PROXY_WORTHY)


def run_outcome(error: Column, items: Column) -> Column:
    """Outcome of a run from its error class (NULL for none) and item count."""
    return (
        F.when(error.isNull(), F.when(items == 0, "empty_result").otherwise("success"))
        .when(error == "blocked", "403_forbidden")
        .otherwise("error")
    )
