"""Vector retrieval queries. Every vector is also a query."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpuslake.functions.vectors import cosine
from corpuslake.operators import vectors as vx
from corpuslake.plans.bindings.inputs import CORPUS, QUERIES_CTE, corpus, queries, table
from corpuslake.plans.bindings.lexical import tokens_sql

DIM = 64


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id",
        "embedding",
        F.concat(F.lit("Set\\label-"), F.col("label").cast("string")).alias("source"),
        F.array(
            F.when(F.col("label") < 5, "low").otherwise("high"),
            F.concat(F.lit("t"), F.col("label").cast("string")),
        ).alias("tags"),
    )


def self_queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


EMB = """emb as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
pairs as (select a.vec_id as query_id, b.vec_id, b.label,
  round(1 - list_cosine_similarity(a.v, b.v), 9) as distance from emb a, emb b)"""


def knn_sql(k: int, where: str = "true") -> str:
    return f"""with {EMB} select query_id, vec_id, round(distance, 6) as distance,
      round(least(1, greatest(0, 1 / (1 + distance))), 6) as score, rank from (
      select *, row_number() over (partition by query_id order by distance, vec_id) as rank
      from pairs where {where}) where rank <= {k}"""


def _knn_out(df):
    return df.select(
        "query_id", "vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank"
    )


def embed_docs(spark, sf):
    v = vx.embed(corpus(spark, sf).select("doc_id", "text"))
    return (
        v.select("doc_id", F.posexplode(F.transform("embedding", lambda x: F.round(x, 6))).alias("cell", "value"))
        .where("value <> 0")
        .select("doc_id", "cell", "value")
    )


def cell_sql(source: str, id_col: str, name: str) -> str:
    """CTE ``name`` (id, cell, v): the default encoder as a sparse table."""
    return f"""{name}_t as (select {id_col}, unnest({tokens_sql('text')}) as t from {source}),
    {name}_c as (select {id_col}, cast('0x' || substr(md5(t), 1, 6) as integer) % {DIM} as cell,
      cast(count(*) as double) as n from {name}_t group by all),
    {name} as (select {id_col}, cell, n / sqrt(sum(n * n) over (partition by {id_col})) as v from {name}_c)"""


def vector_list_sql(name: str, k: str) -> str:
    """CTE ``name`` (query_id, doc_id, distance, rank): nearest documents under the default encoder."""
    return f"""{cell_sql('corpus', 'doc_id', name + '_d')}, {cell_sql('queries', 'query_id', name + '_q')},
    {name}_s as (select query_id, doc_id, sum(q.v * d.v) as dot from {name}_q q join {name}_d d on d.cell = q.cell group by 1, 2),
    {name}_p as (select q.query_id, c.doc_id, round(1 - coalesce(dot, 0), 9) as distance
      from queries q cross join corpus c left join {name}_s s on s.query_id = q.query_id and s.doc_id = c.doc_id),
    {name} as (select * from (select *, row_number() over (partition by query_id order by distance, doc_id) as rank
      from {name}_p) z where rank <= {k})"""


def vector_list(spark, sf, k):
    q = vx.embed(queries(spark, sf)).select("query_id", "embedding")
    return vx.knn(corpus(spark, sf).select("doc_id", "text"), q, k, id_col="doc_id", text_col="text")


def neighbour_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine("embedding", "other"), 6).alias("cosine"))


def knn(spark, sf):
    return _knn_out(vx.knn(vectors(spark, sf), self_queries(spark, sf), 10))


def knn_filtered(spark, sf):
    sources = ["set/LABEL-1", "Set\\label-3 ", "set/label-7"]
    return _knn_out(vx.knn(vectors(spark, sf), self_queries(spark, sf), 10, sources=sources, tags=["low", "t9"]))


def ann(spark, sf, share=0.75):
    """A saved cell layout of which each query reads its nearest cells: three in four, as these vectors have random directions."""
    model = vx.ann_fit(vectors(spark, sf))
    return _knn_out(vx.ann(model, self_queries(spark, sf), 10, math.ceil(share * len(model.centroids))))


def ann_full(spark, sf):
    """All cells probed: the exact result."""
    return ann(spark, sf, share=1)


def ann_recall(spark, sf):
    """Is at least nine tenths of the exact result found by the query of few probes?"""
    exact = vx.knn(vectors(spark, sf), self_queries(spark, sf), 10)
    return vx.recall(ann(spark, sf), exact).select((F.col("recall") >= 0.9).alias("recall_ok"))


def knn_multi(spark, sf):
    q = self_queries(spark, sf)
    prev = q.select((F.col("query_id") + 1).alias("query_id"), F.lit(1).alias("ord"), "embedding")
    variants = q.select("query_id", F.lit(0).alias("ord"), "embedding").union(
        prev.join(q.select("query_id"), "query_id", "left_semi")
    )
    out = vx.knn_multi(vectors(spark, sf), variants, 10)
    return out.select(
        "query_id", "vec_id", "rank", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance")
    )


QUERIES = {
    "v1_embed": embed_docs,
    "v2_cosine": neighbour_cosine,
    "v3_knn": knn,
    "v4_knn_filtered": knn_filtered,
    "v5_ann": ann,
    "v5_ann_full": ann_full,
    "v5_ann_recall": ann_recall,
    "v6_knn_multi": knn_multi,
}

ORACLES = {
    "v1_embed": f"""with {CORPUS}, {cell_sql('corpus', 'doc_id', 'e')}
      select doc_id, cell, round(v, 6) as value from e""",
    "v2_cosine": """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)
      select a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from e a join e b on b.vec_id = a.vec_id + 1""",
    "v3_knn": knn_sql(10),
    "v4_knn_filtered": knn_sql(10, "label in (1, 3, 7) and (label < 5 or label = 9)"),
    "v5_ann_full": knn_sql(10),
    "v5_ann_recall": "select count(*) > 0 as recall_ok from embeddings",
    "v6_knn_multi": f"""with {EMB}, r as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs),
      l as (select query_id, 0 as list, vec_id, rank from r where rank <= 10
        union all select query_id + 1, 1, vec_id, rank from r where rank <= 10 and query_id + 1 in (select vec_id from emb)),
      f as (select query_id, vec_id, sum(1.0 / (50 + rank)) as score, min(list * 1000000 + rank) as seen from l group by 1, 2)
      select query_id, vec_id, rank, round(score, 6) as score, round(1 / (1 + score), 6) as distance from (
        select *, row_number() over (partition by query_id order by round(score, 9) desc, seen, vec_id) as rank from f)
      where rank <= 10""",
}
