"""Text analytics: scripts, garbled text, keywords, profiles, summaries, list items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.text import CJK, as_col, clip, count_chars, extract_all, let, script_of, trim_ws

MEANINGFUL = f"{CJK}a-zA-Z0-9"
PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~！（）【】、，。；：？《》"
GARBLED_RUNS = [
    r"[!\"#$%&'()*]{5,}",
    r"[!\"][#$][!\"][%&]",
    r"(?:![\"#$%&]){3,}",
]
WORDS = f"[{CJK}]{{2,4}}|[a-zA-Z]{{3,10}}"


def detect_script(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("script", script_of(col))


def is_garbled(c: Column) -> Column:
    n = F.length(c)
    run = F.lit(False)
    for p in GARBLED_RUNS:
        run = run | c.rlike(p)
    thin = (count_chars(c, MEANINGFUL) / n < 0.3) & (count_chars(c, PUNCTUATION) / n > 0.4)
    return F.coalesce((n >= 50) & (thin | run), F.lit(False))


def garbled(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("garbled", is_garbled(F.col(col)))


def quality_gate(parts: DataFrame, max_garbled: float = 0.2, min_meaningful: float = 0.4) -> DataFrame:
    """(doc_id, garbled_ratio, meaningful_ratio, keep) from page or paragraph rows."""
    flagged = parts.select(
        "doc_id",
        is_garbled(F.col("text")).cast("int").alias("_g"),
        count_chars("text", MEANINGFUL).alias("_m"),
        F.length("text").alias("_n"),
    )
    out = flagged.groupBy("doc_id").agg(
        F.avg("_g").alias("garbled_ratio"),
        F.when(F.sum("_n") > 0, F.sum("_m") / F.sum("_n")).otherwise(F.lit(0.0)).alias("meaningful_ratio"),
    )
    return out.withColumn(
        "keep", ~((F.col("garbled_ratio") > max_garbled) | (F.col("meaningful_ratio") < min_meaningful))
    )


def keyword_list(c: Column | str, k: int = 8) -> Column:
    """The ``k`` most frequent words of a text as structs (term, n), first seen on a tie; row-local.

    Words are sorted with their places once; runs of equal words give the counts and first places.
    """
    words = extract_all(F.lower(as_col(c)), WORDS)
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))

    def counted(rows: Column) -> Column:
        places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 0) | (rows[i]["term"] != rows[F.greatest(i - 1, F.lit(0))]["term"]))

        def ranked(starts: Column) -> Column:
            n = lambda j: F.coalesce(F.get(starts, j + 1), F.size(rows)) - F.get(starts, j)
            runs = F.transform(starts, lambda s, j: F.struct((-n(j)).alias("less"), rows[s]["pos"].alias("pos"), rows[s]["term"].alias("term")))
            return F.slice(F.sort_array(runs), 1, k)

        return let(first, ranked)

    top = let(placed, counted)
    return F.coalesce(F.transform(top, lambda x: F.struct(x["term"].alias("term"), (-x["less"]).cast("long").alias("n"))), F.array().cast("array<struct<term:string,n:bigint>>"))


def keywords(docs: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, term, n, rank): most frequent words of each row's text, first seen on a tie. Nothing is shuffled."""
    top = docs.select("doc_id", F.posexplode(keyword_list("text", k)).alias("place", "x"))
    return top.select("doc_id", "x.term", "x.n", (F.col("place") + 1).alias("rank"))


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, topic, keywords, entities, complexity, questions), row by row."""
    entities = extract_all("text", "[A-Z][a-zA-Z]+")
    size = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.length("text") / 100)))
    words = F.transform(keyword_list("text", 8), lambda x: x["term"])
    df = docs.select("doc_id", entities.alias("entities"), size.cast("int").alias("complexity"), words.alias("keywords"))
    topic = F.array_join(F.slice("keywords", 1, 2), "、")
    return df.select(
        "doc_id",
        F.when(topic == "", "未知主题").otherwise(topic).alias("topic"),
        "keywords",
        "entities",
        "complexity",
        F.transform(F.slice("keywords", 1, 3), lambda w: F.concat(F.lit("关于"), w, F.lit("有什么信息？"))).alias("questions"),
    )


SUMMARY_CHARS = {"short": 200, "medium": 500, "long": 800}


def key_points_of(c: Column) -> Column:
    return F.slice(F.filter(F.split(c, "[。！？.!?]"), lambda s: trim_ws(s) != ""), 1, 3)


def summarize(docs: DataFrame, length: str = "medium") -> DataFrame:
    """Add summary, key_points (first 3 sentences), tags (first 5 distinct words)."""
    c = F.col("text")
    return (
        docs.withColumn("summary", clip(c, SUMMARY_CHARS[length]))
        .withColumn("key_points", key_points_of(c))
        .withColumn("tags", F.slice(F.array_distinct(extract_all(c, WORDS)), 1, 5))
    )


def analysis_fn(kind: str):
    """Default piece analysis for the long-document job, text to text."""
    if kind == "summary":
        return lambda c: clip(c, SUMMARY_CHARS["short"])
    if kind == "entity_extraction":
        return lambda c: F.array_join(F.array_distinct(extract_all(c, "[A-Z][a-zA-Z]+")), ", ")
    if kind == "key_points":
        return lambda c: F.array_join(F.transform(key_points_of(c), trim_ws), "\n")
    return lambda c: F.concat(clip(c, SUMMARY_CHARS["medium"]), F.lit("\n"), F.array_join(F.transform(key_points_of(c), trim_ws), "\n"))


def feedback_terms(docs: DataFrame, labels: DataFrame, limit: int = 20) -> DataFrame:
    """(label, term, first_doc, n_docs): words of relevant, phrases of irrelevant documents.

    ``labels``: doc_id, quality (1 relevant, 0 irrelevant). Relevant documents
    give the first ``limit`` distinct words (CJK before Latin within a
    document), irrelevant ones every distinct CJK phrase of 3 to 6 characters.
    """
    low = F.lower("text")
    stop = fv.FEEDBACK_STOP_WORDS
    words = F.filter(
        F.concat(extract_all(low, f"[{CJK}]{{2,4}}"), extract_all(low, "[a-zA-Z]{3,}")),
        lambda w: ~w.isin(*stop),
    )
    phrases = F.filter(extract_all(low, f"[{CJK}]{{2,6}}"), lambda p: F.length(p) > 2)
    marked = docs.join(labels.select("doc_id", "quality"), "doc_id")
    rel = F.col("quality") == 1
    terms = marked.select(
        "doc_id",
        F.when(rel, "relevant").otherwise("irrelevant").alias("label"),
        F.posexplode(F.when(rel, words).otherwise(phrases)).alias("pos", "term"),
    )
    seen = terms.groupBy("label", "term").agg(
        F.min(F.struct("doc_id", "pos")).alias("_at"), F.countDistinct("doc_id").alias("n_docs")
    )
    flat = seen.select("label", "term", F.col("_at.doc_id").alias("first_doc"), F.col("_at.pos").alias("first_pos"), "n_docs")
    good = flat.where("label = 'relevant'").orderBy("first_doc", "first_pos").limit(limit)
    return good.union(flat.where("label = 'irrelevant'"))


def list_items(df: DataFrame, col: str = "text", id_col: str = "doc_id", stop_prefix: str = "生成") -> DataFrame:
    """(id, ord, item): numbered lines give their text, other lines pass unless headed by # or the stop prefix."""
    numbered = r"^[0-9]+[.)]"

    def item(line: Column) -> Column:
        body = trim_ws(F.regexp_replace(line, numbered, ""))
        plain = (line != "") & ~line.startswith("#") & ~line.startswith(stop_prefix)
        return F.when(line.rlike(numbered), F.nullif(body, F.lit(""))).when(plain, line)

    items = F.filter(
        F.transform(F.transform(F.split(F.col(col), "\n"), trim_ws), item), lambda x: x.isNotNull()
    )
    return df.select(id_col, F.posexplode(items).alias("ord", "item"))


THINK = r"(?s)<think>(.*?)(?:</think>|\z)"
STEP = r"\[STEP:([^:]+):([^:]+):([^:]+):([^\]]*)\]([\s\S]*?)\[/STEP\]"


def split_reasoning(msgs: DataFrame, col: str = "text") -> DataFrame:
    """Add reasoning (all think parts, null when none) and answer (the rest)."""
    think = trim_ws(F.array_join(extract_all(col, THINK, 1), "\n"))
    return msgs.withColumn("reasoning", F.nullif(think, F.lit(""))).withColumn(
        "answer", F.regexp_replace(F.col(col), THINK, "")
    )


def steps(msgs: DataFrame, col: str = "reasoning", keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """(keys, ord, id, title, status, icon, content): last version of each step at its first place."""
    part = lambda m, i: F.regexp_extract(m, STEP, i)
    found = F.transform(
        extract_all(col, STEP),
        lambda m: F.struct(
            part(m, 1).alias("id"),
            part(m, 2).alias("title"),
            part(m, 3).alias("status"),
            part(m, 4).alias("icon"),
            trim_ws(part(m, 5)).alias("content"),
        ),
    )
    df = msgs.withColumn("_f", found)
    last = F.transform(
        F.array_distinct(F.transform("_f", lambda s: s["id"])),
        lambda i: F.element_at(F.filter("_f", lambda s: s["id"] == i), -1),
    )
    return df.select(*keys, F.posexplode(last).alias("ord", "s")).select(*keys, "ord", "s.*")
