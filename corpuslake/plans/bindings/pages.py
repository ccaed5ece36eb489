"""Web-page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.operators import pages as pg
from corpuslake.plans.bindings.inputs import sql_str, table


def pages(spark, sf):
    return table(spark, sf, "pages")


def rx(expr: str, pattern: str, rep: str) -> str:
    """SQL regexp_replace, all matches; inline (?i) flags work as they are."""
    return f"regexp_replace({expr}, {sql_str(pattern)}, {sql_str(rep)}, 'g')"


def noise_sql(expr: str) -> str:
    for p in pg.noise_patterns():
        expr = rx(expr, p, "")
    return expr


TRIM = r"^[\s\x{00a0}\x{3000}\x{feff}]+|[\s\x{00a0}\x{3000}\x{feff}]+$"


def trim_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '{TRIM}', '', 'g')"


def entities_sql(expr: str) -> str:
    out = f"replace({rx(expr, '(?i)&amp;', '@@AMP@@')}, '@@AMP@@', chr(1))"
    for name, char in fv.HTML_ENTITIES.items():
        if name != "amp":
            out = rx(out, f"(?i)&{name};", char)
    return f"replace({rx(out, '(?i)&[a-z0-9]+;', ' ')}, chr(1), '&')"


def html_text_sql(expr: str) -> str:
    for p, r in pg.BLOCK_BREAKS:
        expr = rx(expr, p, r.replace("$1", "\\1"))
    joined = (
        f"array_to_string(list_filter(list_transform(string_split({entities_sql(expr)}, chr(10)), "
        f"lambda s: {trim_sql('s')}), lambda s: s <> ''), chr(10))"
    )
    return trim_sql(rx(joined, r"[ \t]+", " "))


CLEAN = f"clean as (select page_id, url, html, {noise_sql('html')} as c from pages)"


def content_ctes() -> str:
    parts = []
    for i, (p, w) in enumerate(fv.CONTENT_SELECTORS):
        parts.append(
            f"select page_id, {i} as sel, {w} as w, unnest(m) as content, unnest(range(len(m))) as pos "
            f"from (select page_id, regexp_extract_all(c, {sql_str('(?i)' + p)}, 1) as m from clean)"
        )
    return f"""{CLEAN}, cand as ({' union all '.join(parts)}),
    rated as (select *, length(bare) as n,
        round(w * (length({trim_sql(rx('bare', r'[\s]+', ' '))}) / length(content)) * ln(length(bare) + 1), 9) as score
      from (select *, {rx('content', '<[^>]+>', '')} as bare from cand)),
    best as (select page_id, arg_max({{'content': content, 'score': score, 'sel': sel}}, {{'a': score, 'b': -sel, 'c': -pos}}) as b
      from rated where n > 100 group by page_id),
    main as (select c.page_id, url, html, case when b.score >= 10 then b.score end as score,
        case when b.score >= 10 then b.sel end as selector,
        case when b.score >= 10 then b.content when regexp_matches(c, '(?i)<body[^>]*>[\\s\\S]*</body>')
          then regexp_extract(c, '(?i)<body[^>]*>([\\s\\S]*)</body>', 1) else c end as content
      from clean c left join best on best.page_id = c.page_id)"""


def m1(pattern: str) -> str:
    return f"nullif(regexp_extract(html, {sql_str('(?i)' + pattern)}, 1), '')"


def meta_sql(key: str, both: bool = False) -> str:
    val = "content=[\"']([^\"']+)[\"']"
    out = m1(f"<meta[^>]*{key}[^>]*{val}")
    return f"coalesce({out}, {m1(f'<meta[^>]*{val}[^>]*{key}')})" if both else out


META = f"""meta as (select page_id,
  coalesce(nullif({entities_sql(trim_sql(m1('<title[^>]*>([^<]*)</title>')))}, ''), {entities_sql(meta_sql(pg.attr('property', 'og:title')))}) as title,
  {entities_sql(trim_sql(meta_sql(pg.attr('name', 'description'), True)))} as description,
  list_filter(list_transform(regexp_split_to_array({meta_sql(pg.attr('name', 'keywords'), True)}, '[,，]'), lambda w: {trim_sql('w')}), lambda w: w <> '') as keywords,
  {entities_sql(trim_sql(meta_sql(pg.attr('name', 'author'))))} as author,
  coalesce({meta_sql('(?:' + pg.attr('property', 'article:published_time') + '|' + pg.attr('name', 'publishdate') + ')')},
    {m1("<time[^>]*datetime=[\"']([^\"']+)[\"']")}) as publish_date,
  {meta_sql(pg.attr('property', 'og:image'))} as og_image,
  {entities_sql(meta_sql(pg.attr('property', 'og:site_name')))} as site_name
  from pages)"""

URLS = """urls as (
  select page_id, 0 as form, url from pages
  union all select page_id, 1, replace(url, 'http', 'ftp') from pages
  union all select page_id, 2, 'https://github.com/org/repo' || page_id || '/blob/main/docs/' || page_id || '.md' from pages
  union all select page_id, 3, regexp_replace(url, '^https?://[^/]*', 'https://en.wikipedia.org/wiki') from pages
  union all select page_id, 4, regexp_replace(url, '^https?://[^/]*', 'http://www.zhihu.com:8080') from pages
  union all select page_id, 5, regexp_replace(url, '^https?://', '') from pages
  union all select page_id, 6, regexp_replace(url, '^https?://[^/]*', 'http://localhost') from pages)"""

ALLOWED = ["example.com", "github.com", "WIKIPEDIA.org", "zhihu.com"]


def url_forms(spark, sf):
    p = pages(spark, sf).select("page_id", "url")
    u = F.col("url")
    host = r"^https?://[^/]*"
    forms = [
        u,
        F.replace(u, F.lit("http"), F.lit("ftp")),
        F.concat(F.lit("https://github.com/org/repo"), "page_id", F.lit("/blob/main/docs/"), "page_id", F.lit(".md")),
        F.regexp_replace(u, host, "https://en.wikipedia.org/wiki"),
        F.regexp_replace(u, host, "http://www.zhihu.com:8080"),
        F.regexp_replace(u, "^https?://", ""),
        F.regexp_replace(u, host, "http://localhost"),
    ]
    return p.select("page_id", F.posexplode(F.array(*forms)).alias("form", "url"))


def raw_bodies(spark, sf):
    """Pages as HTML, event properties as JSON, benchmark texts as XML, documents as text or Markdown."""
    cols = lambda u, ct, b: [u.alias("url"), F.lit(ct).alias("content_type"), b.alias("body")]
    p = pages(spark, sf).select(*cols(F.col("url"), "text/html; charset=utf-8", F.col("html")))
    e = table(spark, sf, "events").select(
        *cols(F.concat(F.lit("http://api.example.com/e/"), "event_id"), "application/json", F.col("props"))
    )
    b = table(spark, sf, "benchmark")
    xml = F.concat(F.lit('<?xml version="1.0"?><doc><id>'), "item_id", F.lit("</id><![CDATA["), "text", F.lit("]]></doc>"))
    x = b.select(*cols(F.concat(F.lit("http://x.example.com/"), "item_id"), "text/xml", xml))
    g = b.select(*cols(F.concat(F.lit("http://x.example.com/"), "item_id"), "image/png", F.col("text")))
    d = table(spark, sf, "documents")
    t = d.select(*cols(F.concat(F.lit("http://t.example.com/a%20b%E4%B8%AD/"), "doc_id", F.lit("%20f.txt")), "text/plain", F.col("text")))
    m = d.select(*cols(F.concat(F.lit("http://t.example.com/"), "doc_id", F.lit(".md")), "text/html", F.col("text")))
    return p.union(e).union(x).union(g).union(t).union(m)


def markdown_docs(spark, sf):
    d = table(spark, sf, "documents")
    head = F.when(F.col("lang") == "en", F.concat(F.lit("# Doc "), "doc_id")).otherwise(
        F.concat(F.lit("Doc "), "doc_id", F.lit("\n====="))
    )
    return d.select(
        "doc_id",
        F.concat(
            head, F.lit("\n\n- [**"), "source", F.lit("**](http://x/"), "doc_id", F.lit(") and `code`\n* _"), "lang", F.lit("_\n"), "text"
        ).alias("text"),
    )


MARKDOWN = """md as (select doc_id, (case when lang = 'en' then '# Doc ' || doc_id else 'Doc ' || doc_id || chr(10) || '=====' end)
  || chr(10) || chr(10) || '- [**' || source || '**](http://x/' || doc_id || ') and `code`' || chr(10) || '* _' || lang || '_' || chr(10) || text as text
  from documents)"""


def strip_noise(spark, sf):
    return pg.strip_noise(pages(spark, sf)).select("page_id", F.length("html").cast("long").alias("n"), F.md5("html").alias("h"))


def main_content(spark, sf):
    return pg.main_content(pages(spark, sf)).select("page_id", F.round("score", 6).alias("score"), "selector", F.md5("content").alias("h"))


def html_to_text(spark, sf):
    df = pg.html_to_text(pages(spark, sf), "html")
    return df.select("page_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("h"))


def page_meta(spark, sf):
    return pg.page_meta(pages(spark, sf)).select(
        "page_id", "title", "description", F.array_join("keywords", "|").alias("keywords"), "author", "publish_date", "og_image", "site_name"
    )


def extract_by_type(spark, sf):
    return pg.extract_by_type(raw_bodies(spark, sf)).select("url", "kind", "title", F.md5("text").alias("h"))


def markdown(spark, sf):
    return pg.markdown_to_text(markdown_docs(spark, sf)).select("doc_id", "title", F.md5("plain").alias("h"))


def classify(spark, sf):
    return pg.classify_urls(url_forms(spark, sf), ALLOWED).select("page_id", "form", "host", "reason", "dynamic", "wikipedia", "raw_url")


def corpus_from_pages(spark, sf):
    return pg.pages_to_corpus(pages(spark, sf)).select("page_id", "source", "title", "author", "site_name", F.md5("text").alias("h"))


def rejected(spark, sf):
    """Every fifth page has another scheme, every seventh hardly any text."""
    p = pages(spark, sf).select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://host.org/"), "page_id")).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 7 == 0, "<p>tiny</p>").otherwise(F.col("html")).alias("html"),
    )
    return pg.rejected_pages(p).select("page_id", "reason", F.col("n_chars").cast("long").alias("n_chars"))


QUERIES = {
    "w1_strip_noise": strip_noise,
    "w2_main_content": main_content,
    "w3_html_to_text": html_to_text,
    "w4_page_meta": page_meta,
    "w5_outlinks": lambda spark, sf: pg.outlinks(pages(spark, sf)),
    "w6_extract_by_type": extract_by_type,
    "w7_markdown_to_text": markdown,
    "w8_classify_urls": classify,
    "w9_pages_to_corpus": corpus_from_pages,
    "w9_rejected_pages": rejected,
}

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '')"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_BLOB = "^/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$"
_granted = " or ".join(f"ends_with(host, '{a.lower()}')" for a in ALLOWED)
_dynamic = " or ".join(f"contains(host, '{s}')" for s in fv.DYNAMIC_HOSTS)

ORACLES = {
    "w1_strip_noise": f"with {CLEAN} select page_id, cast(length(c) as bigint) as n, md5(c) as h from clean",
    "w2_main_content": f"with {content_ctes()} select page_id, round(score, 6) as score, selector, md5(content) as h from main",
    "w3_html_to_text": f"select page_id, cast(length(t) as bigint) as n, md5(t) as h from (select page_id, {html_text_sql('html')} as t from pages)",
    "w4_page_meta": f"with {META} select page_id, title, description, array_to_string(keywords, '|') as keywords, author, publish_date, og_image, site_name from meta",
    "w5_outlinks": r"""with h as (select page_id, url, unnest(m) as href, unnest(range(len(m))) as pos from (
        select page_id, url, regexp_extract_all(html, '(?i)<a[^>]*href=["'']([^"''#]+)["''][^>]*>', 1) as m from pages)),
      r as (select page_id, pos, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href
          when starts_with(href, '//') then regexp_extract(url, '^([a-z]+):', 1) || ':' || href
          when starts_with(href, '/') then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href
          else regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || href end as u
        from (select page_id, url, pos, trim(href) as href from h) where href <> '' and not starts_with(href, 'javascript:') and not starts_with(href, 'mailto:')),
      e as (select page_id, pos, list_reduce(list_concat([u], list_distinct(regexp_extract_all(u, '[^\x21-\x7E]|["<>`]'))),
          lambda a, ch: replace(a, ch, url_encode(ch))) as u from r),
      d as (select page_id, u, min(pos) as p from e where starts_with(u, 'http') group by 1, 2)
      select page_id, cast(o - 1 as integer) as ord, u as url from (select *, row_number() over (partition by page_id order by p) as o from d)""",
    "w6_extract_by_type": f"""with {content_ctes()}, {META},
      a as (select url, 'html' as kind, coalesce(title, '') as title, {html_text_sql('content')} as t from main join meta on meta.page_id = main.page_id
        union all select 'http://api.example.com/e/' || event_id, 'json', 'JSON: http://api.example.com/e/' || event_id,
          '{{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}}' from events
        union all select 'http://x.example.com/' || item_id, 'xml', 'XML: http://x.example.com/' || item_id,
          {trim_sql(rx(rx("chr(10) || chr(10) || item_id || chr(10) || text || chr(10)", '<[^>]+>', chr(10)), chr(10) + '{2,}', chr(10)))} from benchmark
        union all select 'http://t.example.com/a%20b%E4%B8%AD/' || doc_id || '%20f.txt', 'plain', doc_id || ' f.txt', text from documents
        union all select 'http://t.example.com/' || doc_id || '.md', 'markdown', doc_id || '.md', text from documents)
      select url, kind, title, md5(t) as h from a""",
    "w7_markdown_to_text": f"""with {MARKDOWN} select doc_id, case when starts_with(text, '#') then regexp_extract(text, '(?m)^#\\s+([^\\n]+)$', 1)
        else regexp_extract(text, '(?m)^([^\\n]+)\\n={{3,}}$', 1) end as title,
      md5({trim_sql(rx(rx(rx(rx(rx('text', r'(?m)^[\s\x{00a0}\x{3000}\x{feff}]*[-*][\s\x{00a0}\x{3000}\x{feff}]+', '• '), r'\[([^\]]+)\]\([^)]+\)', r'\1'), r'[*_]{1,2}([^*_]+)[*_]{1,2}', r'\1'), r'(?m)^#+\s+', ''), r'`{1,3}([^`]*)`{1,3}', r'\1'))}) as h from md""",
    "w8_classify_urls": f"""with {URLS}, p as (select page_id, form, url, {_HOST} as host, {_PATH} as path,
        lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as scheme from urls)
      select page_id, form, host, case when scheme = '' then 'bad_url' when scheme not in ('http', 'https') then 'scheme'
        when not regexp_matches(host, '^([a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}$') then 'host'
        when not ({_granted}) then 'not_allowed' else 'ok' end as reason, ({_dynamic}) as dynamic,
        ends_with(host, 'wikipedia.org') and starts_with(path, '/wiki/') as wikipedia,
        case when host = 'github.com' and regexp_matches(path, '{_BLOB}') then 'https://raw.githubusercontent.com' ||
          regexp_replace(path, '{_BLOB}', '/\\1/\\2/\\3/\\4') end as raw_url from p""",
    "w9_rejected_pages": """select page_id, case when page_id % 5 = 0 then 'scheme' else 'short' end as reason,
        case when page_id % 5 <> 0 then 4::bigint end as n_chars from pages where page_id % 5 = 0 or page_id % 7 = 0""",
    "w9_pages_to_corpus": f"""with {content_ctes()}, {META}, t as (select main.page_id, url, {html_text_sql('content')} as t,
        coalesce(title, url) as title, author, site_name from main join meta on meta.page_id = main.page_id
        where regexp_matches({_HOST}, '^([a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}$'))
      select page_id, url as source, title, author, site_name, md5(t) as h from t where length(t) >= 50""",
}
