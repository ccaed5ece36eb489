"""Web-page corpus: noise removal, main content, text, metadata, links, dispatch.

All operators are row-local column work over a page table: no shuffle, no
Python except the JSON pretty-printer.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.text import WS, blank_to_null, extract_all, let, safe_url_decode, trim_ws

AMP_MARK = "\u0001"  # stands for a literal ampersand until every entity is decoded


def noise_patterns(whole_words: bool = False) -> list[str]:
    """Patterns of removed page parts, in order.

    By default a noise word matches anywhere inside a class or id (so "ad" also
    hits "shadow"); ``whole_words`` asks for word borders instead.
    """
    words = "|".join(fv.NOISE_DIV_WORDS)
    word = rf"\b(?:{words})\b" if whole_words else f"(?:{words})"
    tags = lambda names: [rf"(?i)<{t}[^>]*>[\s\S]*?</{t}>" for t in names]
    divs = [
        rf'(?i)<div[^>]*{attr}="[^"]*{word}[^"]*"[^>]*>[\s\S]*?</div>' for attr in ("class", "id")
    ]
    return tags(fv.NOISE_TAGS_HEAD) + [r"<!--[\s\S]*?-->"] + tags(fv.NOISE_TAGS_TAIL) + divs


def without_noise(html: Column, whole_words: bool = False) -> Column:
    for p in noise_patterns(whole_words):
        html = F.regexp_replace(html, p, "")
    return html


def strip_noise(pages: DataFrame, whole_words: bool = False) -> DataFrame:
    return pages.withColumn("html", without_noise(F.col("html"), whole_words))


def main_content(pages: DataFrame) -> DataFrame:
    """Add ``content``, ``score``, ``selector`` (null when the body or page is used)."""
    df = pages.withColumn("_clean", without_noise(F.col("html")))

    def rate(i: int, weight: int):
        def one(c: Column, pos: Column) -> Column:
            bare = F.regexp_replace(c, "<[^>]+>", "")
            n = F.length(bare)
            text_len = F.length(trim_ws(F.regexp_replace(bare, f"[{WS}]+", " ")))
            score = weight * (text_len / F.length(c)) * F.log(n + 1)
            return F.when(
                n > 100,
                F.struct(
                    F.round(score, 9).alias("score"),
                    F.lit(-i).alias("sel"),
                    (-pos).alias("pos"),
                    c.alias("content"),
                ),
            )

        return one

    rated = [
        F.transform(extract_all("_clean", f"(?i){p}", 1), rate(i, w))
        for i, (p, w) in enumerate(fv.CONTENT_SELECTORS)
    ]
    # the highest score wins, then the earlier selector, then the earlier match
    df = df.withColumn("_best", F.array_max(F.flatten(F.array(*rated))))
    good = F.col("_best").isNotNull() & (F.col("_best.score") >= 10)
    has_body = F.col("_clean").rlike(r"(?i)<body[^>]*>[\s\S]*</body>")
    body = F.regexp_extract("_clean", r"(?i)<body[^>]*>([\s\S]*)</body>", 1)
    rest = F.when(has_body, body).otherwise(F.col("_clean"))
    return (
        df.withColumn("content", F.when(good, F.col("_best.content")).otherwise(rest))
        .withColumn("score", F.when(good, F.col("_best.score")))
        .withColumn("selector", F.when(good, -F.col("_best.sel")))
        .drop("_clean", "_best")
    )


def _decode_numbers(text: Column, pattern: str, base: int) -> Column:
    """Replace every distinct numeric entity of a text by its character."""

    def swap(acc: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, pattern, 1)
        code = F.conv(digits, base, 10).cast("long")
        ok = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(32)), 8, "0")), "UTF-32")
        return F.replace(acc, entity, char)

    return let(
        text,
        lambda t: F.aggregate(F.array_distinct(extract_all(t, pattern)), t, swap),
    )


def decode_entities(text: Column) -> Column:
    """Named, decimal and hex entities; unknown names become blanks; '&amp;' decodes last."""
    out = F.regexp_replace(text, "(?i)&amp;", AMP_MARK)
    for name, char in fv.HTML_ENTITIES.items():
        if name != "amp":
            out = F.regexp_replace(out, f"(?i)&{name};", char)
    out = _decode_numbers(out, "&#([0-9]+);", 10)
    out = _decode_numbers(out, "(?i)&#x([0-9a-f]+);", 16)
    out = F.regexp_replace(out, "(?i)&[a-z0-9]+;", " ")
    return F.replace(out, F.lit(AMP_MARK), F.lit("&"))


BLOCK_BREAKS = [
    (r"(?i)</?(?:h[1-6])[^>]*>", "\n\n"),
    (r"(?i)</?(?:p|div|br|blockquote)[^>]*>", "\n"),
    (r"(?i)</?(?:li)[^>]*>", "\n• "),
    (r"(?i)</?(?:ul|ol|table|tbody|thead|tr)[^>]*>", "\n\n"),
    (r"(?i)<td[^>]*>", "\t"),
    (r"(?i)</td>", ""),
    (r"(?i)<a[^>]*>([^<]*)</a>", "$1"),
    (r"<[^>]+>", ""),
]


def text_of(html: Column) -> Column:
    out = html
    for p, r in BLOCK_BREAKS:
        out = F.regexp_replace(out, p, r)
    lines = F.filter(F.transform(F.split(decode_entities(out), "\n"), trim_ws), lambda s: s != "")
    return trim_ws(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]+", " "))


def html_to_text(df: DataFrame, col: str = "content", out: str = "text") -> DataFrame:
    return df.withColumn(out, text_of(F.col(col)))


def _meta(html: Column, key: str, reversed_too: bool = False) -> Column:
    q = "[\"']"
    val = f"content={q}([^\"']+){q}"
    out = F.regexp_extract(html, f"(?i)<meta[^>]*{key}[^>]*{val}", 1)
    if reversed_too:
        out = F.coalesce(
            blank_to_null(out), F.regexp_extract(html, f"(?i)<meta[^>]*{val}[^>]*{key}", 1)
        )
    return blank_to_null(out)


def attr(name: str, value: str) -> str:
    return f"{name}=[\"']{value}[\"']"


def page_meta(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add title, description, keywords, author, publish_date, og_image, site_name."""
    h = F.col(html_col)
    title = blank_to_null(decode_entities(trim_ws(F.regexp_extract(h, r"(?i)<title[^>]*>([^<]*)</title>", 1))))
    og = decode_entities(_meta(h, attr("property", "og:title")))
    words = F.split(_meta(h, attr("name", "keywords"), True), "[,，]")
    dated = f"(?:{attr('property', 'article:published_time')}|{attr('name', 'publishdate')})"
    time_tag = blank_to_null(F.regexp_extract(h, r"(?i)<time[^>]*datetime=[\"']([^\"']+)[\"']", 1))
    return (
        pages.withColumn("title", F.coalesce(title, og))
        .withColumn("description", decode_entities(trim_ws(_meta(h, attr("name", "description"), True))))
        .withColumn("keywords", F.filter(F.transform(words, trim_ws), lambda w: w != ""))
        .withColumn("author", decode_entities(trim_ws(_meta(h, attr("name", "author")))))
        .withColumn("publish_date", F.coalesce(_meta(h, dated), time_tag))
        .withColumn("og_image", _meta(h, attr("property", "og:image")))
        .withColumn("site_name", decode_entities(_meta(h, attr("property", "og:site_name"))))
    )


# ------------------------------------------------------------------- links


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))


def url_authority(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_host(u: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url_authority(u), r"^.*@", ""), r":[0-9]*\z", "")


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _resolve_dots(path: Column) -> Column:
    """Apply '.' and '..' path segments."""
    none = F.array().cast("array<string>")
    fold = lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    ).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    done = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), none, fold)
    tail = F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    fixed = F.concat(F.lit("/"), F.array_join(done, "/"), tail)
    return F.when(path.rlike(r"/\.\.?(?:/|\z)"), fixed).otherwise(path)


def percent_encode(u: Column) -> Column:
    """Percent-encode characters that may not stand in a URL."""
    bad = r'[^\x21-\x7E]|["<>`]'
    swap = lambda acc, ch: F.replace(
        acc, ch, F.when(ch == " ", F.lit("%20")).otherwise(F.url_encode(ch))
    )
    return let(u, lambda t: F.aggregate(F.array_distinct(extract_all(t, bad)), t, swap))


def absolute_url(href: Column, base: Column) -> Column:
    root = F.concat(url_scheme(base), F.lit("://"), url_authority(base))
    base_path = F.when(url_path(base) == "", F.lit("/")).otherwise(url_path(base))
    folder = F.regexp_replace(base_path, r"[^/]*\z", "")
    cut = r"^([^?]*)(.*)"
    path, rest = F.regexp_extract(href, cut, 1), F.regexp_extract(href, cut, 2)
    joined = (
        F.when(href.startswith("/"), F.concat(root, _resolve_dots(path), rest))
        .when(href.startswith("?"), F.concat(root, base_path, href))
        .otherwise(F.concat(root, _resolve_dots(F.concat(folder, path)), rest))
    )
    return percent_encode(
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(url_scheme(base), F.lit(":"), href))
        .otherwise(joined)
    )


def outlinks(pages: DataFrame, max_links: int | None = None) -> DataFrame:
    """(page_id, ord, url): distinct http(s) links in first-seen order; ``max_links`` may keep the first of a page only."""
    hrefs = F.transform(
        extract_all("html", r"(?i)<a[^>]*href=[\"']([^\"'#]+)[\"'][^>]*>", 1), trim_ws
    )
    wanted = F.filter(hrefs, lambda h: (h != "") & ~h.startswith("javascript:") & ~h.startswith("mailto:"))
    full = F.filter(
        F.transform(wanted, lambda h: absolute_url(h, F.col("url"))), lambda u: u.startswith("http")
    )
    first = F.array_distinct(full)
    if max_links is not None:
        first = F.slice(first, 1, max_links)
    usable = F.when(url_host(F.col("url")) != "", first).otherwise(F.array().cast("array<string>"))
    return pages.select("page_id", F.posexplode(usable).alias("ord", "url"))


def classify_urls(df: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Add host, reason ('ok', 'bad_url', 'scheme', 'host', 'not_allowed'), dynamic, wikipedia, raw_url."""
    u = F.col("url")
    host, path, scheme = url_host(u), url_path(u), url_scheme(u)
    ok_host = host.rlike(r"^([a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\z")
    granted = F.lit(not allowed)
    for suffix in allowed or []:
        granted = granted | host.endswith(suffix.lower())
    reason = (
        F.when(scheme == "", "bad_url")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(~ok_host, "host")
        .when(~granted, "not_allowed")
        .otherwise("ok")
    )
    dynamic = F.lit(False)
    for site in fv.DYNAMIC_HOSTS:
        dynamic = dynamic | host.contains(site)
    blob = r"^/([^/]+)/([^/]+)/blob/([^/]+)/(.+)\z"
    raw = F.when(
        (host == "github.com") & path.rlike(blob),
        F.concat(
            F.lit("https://raw.githubusercontent.com"), F.regexp_replace(path, blob, "/$1/$2/$3/$4")
        ),
    )
    return (
        df.withColumn("host", host)
        .withColumn("reason", reason)
        .withColumn("dynamic", dynamic)
        .withColumn("wikipedia", host.endswith("wikipedia.org") & path.startswith("/wiki/"))
        .withColumn("raw_url", raw)
    )


# ---------------------------------------------------------------- dispatch


def _pretty_json(raw: pd.Series) -> pd.Series:
    """Two-space JSON, null for null or malformed input."""

    def number(text: str):
        value = float(text)
        return int(value) if value.is_integer() and abs(value) < 1e21 else value

    def one(s):
        if s is None:
            return None
        try:
            return json.dumps(json.loads(s, parse_float=number), indent=2, ensure_ascii=False)
        except ValueError:
            return None

    return raw.map(one)


def pretty_json(raw: Column) -> Column:
    return F.pandas_udf(_pretty_json, T.StringType())(raw)


def url_title(u: Column) -> Column:
    tail = F.element_at(F.split(u, "/"), -1)
    return safe_url_decode(F.when(tail == "", u).otherwise(tail))


def extract_by_type(raw: DataFrame) -> DataFrame:
    """(url, content_type, body) -> adds kind, title, text; unsupported types are dropped."""
    ct, u, body = F.col("content_type"), F.col("url"), F.col("body")
    supported = F.lit(False)
    for t in fv.SUPPORTED_CONTENT_TYPES:
        supported = supported | ct.contains(t)
    kind = (
        F.when(ct.contains("application/json"), "json")
        .when(ct.contains("text/markdown") | u.endswith(".md"), "markdown")
        .when(ct.contains("application/xml") | ct.contains("text/xml"), "xml")
        .when(ct.contains("text/plain"), "plain")
        .otherwise("html")
    )
    df = raw.where(supported).withColumn("kind", kind)
    df = df.withColumn("_json", pretty_json(F.when(F.col("kind") == "json", body)))
    df = df.withColumn("html", F.when(F.col("kind") == "html", body))
    df = html_to_text(main_content(page_meta(df)), "content", "_html_text")
    xml = F.regexp_replace(body, r"(?i)<\?xml[^>]*\?>", "")
    xml = F.regexp_replace(xml, r"(?i)<!\[CDATA\[([\s\S]*?)\]\]>", "$1")
    xml = F.regexp_replace(F.regexp_replace(xml, r"<[^>]+>", "\n"), r"\n{2,}", "\n")
    k = F.col("kind")
    text = (
        F.when(k == "json", F.coalesce("_json", body))
        .when(k == "xml", trim_ws(xml))
        .when(k == "html", F.col("_html_text"))
        .otherwise(body)
    )
    title = (
        F.when((k == "json") & F.col("_json").isNotNull(), F.concat(F.lit("JSON: "), u))
        .when(k == "json", u)
        .when(k == "xml", F.concat(F.lit("XML: "), u))
        .when(k == "html", F.coalesce("title", F.lit("")))
        .otherwise(url_title(u))
    )
    return df.select(*raw.columns, "kind", title.alias("title"), text.alias("text"))


def markdown_to_text(df: DataFrame, col: str = "text", out: str = "plain") -> DataFrame:
    """Add ``title`` (first '# ' or underlined heading) and the text without markup."""
    c = F.col(col)
    line = "[^\\n\\r\\u2028\\u2029]"
    hashed = F.regexp_extract(c, rf"(?m)^#[{WS}]+({line}+)$", 1)
    ruled = F.regexp_extract(c, rf"(?m)^({line}+)\n={{3,}}$", 1)
    plain = F.regexp_replace(c, rf"(?m)^[{WS}]*[-*][{WS}]+", "• ")
    plain = F.regexp_replace(plain, r"\[([^\]]+)\]\([^)]+\)", "$1")
    plain = F.regexp_replace(plain, r"[*_]{1,2}([^*_]+)[*_]{1,2}", "$1")
    plain = F.regexp_replace(plain, rf"(?m)^#+[{WS}]+", "")
    plain = F.regexp_replace(plain, r"`{1,3}([^`]*)`{1,3}", "$1")
    return df.withColumn(
        "title", trim_ws(F.coalesce(blank_to_null(hashed), blank_to_null(ruled)))
    ).withColumn(out, trim_ws(plain))


MIN_PAGE_TEXT = 50


def pages_to_corpus(pages: DataFrame, allowed: list[str] | None = None, min_chars: int = MIN_PAGE_TEXT) -> DataFrame:
    """Admitted pages as documents: source, title, text and metadata. ``rejected_pages`` tells of the others."""
    ok = classify_urls(pages, allowed).where("reason = 'ok'")
    df = main_content(page_meta(ok))
    # a filter on the text would be pushed down and repeat the whole extraction;
    # exploding the kept text evaluates it once
    kept = F.filter(F.array(text_of(F.col("content"))), lambda t: F.length(t) >= min_chars)
    return df.select(
        "page_id",
        F.col("url").alias("source"),
        F.coalesce("title", "url").alias("title"),
        F.explode(kept).alias("text"),
        "description",
        "keywords",
        "author",
        "publish_date",
        "og_image",
        "site_name",
    )


def rejected_pages(pages: DataFrame, allowed: list[str] | None = None, min_chars: int = MIN_PAGE_TEXT) -> DataFrame:
    """(page_id, url, reason, n_chars) of the pages that ``pages_to_corpus`` leaves out.

    The reason is that of ``classify_urls``, or 'short'; texts of refused urls are not extracted.
    """
    judged = classify_urls(pages, allowed)
    refused = judged.where("reason <> 'ok'").select("page_id", "url", "reason", F.lit(None).cast("int").alias("n_chars"))
    # exploding the length evaluates the extraction once
    size = F.explode(F.array(F.coalesce(F.length(text_of(F.col("content"))), F.lit(0))))
    sized = main_content(judged.where("reason = 'ok'")).select("page_id", "url", size.alias("n_chars"))
    short = sized.where(F.col("n_chars") < min_chars)
    return refused.unionByName(short.select("page_id", "url", F.lit("short").alias("reason"), "n_chars"))
