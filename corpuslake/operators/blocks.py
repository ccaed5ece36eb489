"""Stored keyword index in blocks: upper bounds, statistics, vocabulary grams, delta segments and deletions.

An index is a folder of segments and a small versioned list of those in use. A segment holds

* ``docs``: shard, doc_id, doc_len, counts (the terms of a document): a shard is some ``SHARD`` neighbouring documents;
* ``blocks``: the postings of a term in a shard as one row (ids, tfs, lens), with the largest tf and least length as its upper
  bound; files are sorted by term, so a search reads the row groups of its terms;
* ``terms``: term, df; ``grams``: gram, term, for substring look-ups; ``stats``: number and length of documents;
* ``dead``: segment, shard, doc_id of documents of earlier segments that this one replaces or deletes.

Statistics are sums over segments: a segment that deletes documents counts them and their terms negatively. So a search after any
refreshes scores as over an index that was built anew, and ``merge`` makes one segment of all without the texts.

A search deals the blocks of its terms by shard. In a shard a query's terms are ordered by their bounds; documents that occur only in
terms whose bounds together stay below the k-th best score known cannot be among the first k, so these terms are
looked up for candidates only, and a shard or block that stays below it altogether is not decoded. The
score to beat comes from a first search for each query's rarest terms, and rises within a task. Results do not depend on it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import fixed_values as fv
from corpuslake.functions.scale import MAX_BROADCAST_ROWS, arrow_rows, delete_folder, discard, hint_small, is_small, materialise, shared_dir
from corpuslake.functions.text import flat_tokens
from corpuslake.operators import lexical as lx
from corpuslake.sources.versions import current_version, publish, read_current

#: Documents of a shard; rows of query terms of one pass.
SHARD, ASKED = 2048, 200_000
#: From so many shards on, the rarest terms are searched first, for a score to beat.
SEED = 16
#: A partial search in which shards may hand on more rows than this is run over one shard of ``FEW`` first, for the same.
HANDED, FEW = 1 << 23, 16
#: Scores are compared to nine places, so bounds are widened by this.
SLACK = 1e-7
TEXTS_AT_ONCE = 256  # texts whose tokens are held at the same time
#: Cells of query terms x documents that are marked, and postings that are looked at, at the same time.
MARKS, AT_ONCE = 1 << 24, 1 << 21
STOP_WORDS = pa.array(fv.INDEX_STOP_WORDS)

BLOCKS = "shard long, term string, ids array<{id}>, tfs array<int>, lens array<int>, max_tf int, min_len int"


# ---------------------------------------------------------------- building


def forward(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """(shard, doc_id, doc_len, counts), without a shuffle; body, blank and source are indexed."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    if source_col:
        body = F.concat(body, F.lit(" "), F.coalesce(F.col(source_col), F.lit("")))
    tok = docs.select(F.col(id_col).alias("doc_id"), F.lower(body).alias("low"))
    schema = f"doc_id {dict(tok.dtypes)['doc_id']}, doc_len long, counts array<struct<term:string,tf:bigint>>"
    return _sharded(tok.mapInArrow(_counted, schema))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text in lower case) -> (doc_id, doc_len, counts): how often each term occurs in each document."""
    for whole in batches:
        for start in range(0, len(whole), TEXTS_AT_ONCE):
            batch = whole.slice(start, TEXTS_AT_ONCE)
            tokens, doc = flat_tokens(batch.column("low"))
            coded = tokens.dictionary_encode()
            code = coded.indices.to_numpy()
            term = ~pc.is_in(coded.dictionary, value_set=STOP_WORDS).to_numpy(zero_copy_only=False)[code]
            code, doc = code[term], doc[term]
            sizes = np.bincount(doc, minlength=len(batch))
            n = max(1, len(coded.dictionary))
            key, tf = np.unique(doc * n + code, return_counts=True)
            offsets = np.searchsorted(key, np.arange(len(batch) + 1) * n)
            counts = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % n)), pa.array(tf)], names=["term", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), lists], names=["doc_id", "doc_len", "counts"])


def _sharded(rows: DataFrame) -> DataFrame:
    place = F.monotonically_increasing_id()
    return rows.select((place - F.pmod(place, F.lit(SHARD))).alias("shard"), "doc_id", "doc_len", "counts")


def _to_blocks(terms: frozenset | None = None):
    """Documents in order of their shards -> blocks; a shard that two tasks read gives two rows a term."""

    def blocks(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, counts = table["doc_id"].combine_chunks(), table["counts"].combine_chunks()
        sizes = np.diff(counts.offsets.to_numpy())
        flat = counts.flatten()
        coded = flat.field("term").dictionary_encode()
        code, tf = coded.indices.to_numpy(), flat.field("tf").to_numpy()
        doc = np.repeat(np.arange(len(ids)), sizes)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
        order = np.lexsort((rank[doc], code))
        code, tf, doc = code[order], tf[order], doc[order]
        lens = table["doc_len"].to_numpy()[doc]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        offsets = pa.array(np.r_[starts, len(code)].astype(np.int32))
        arrays = [
            pa.array(np.full(len(starts), shard)),
            coded.dictionary.take(pa.array(code[starts])),
            pa.ListArray.from_arrays(offsets, ids.take(pa.array(doc))),
            pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(lens.astype(np.int32))),
            pa.array((np.maximum.reduceat(tf, starts) if len(starts) else tf).astype(np.int32)),
            pa.array((np.minimum.reduceat(lens, starts) if len(starts) else lens).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "term", "ids", "tfs", "lens", "max_tf", "min_len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if stop > start:
                    if held and shard[start] != now:
                        yield blocks(now, held)
                        held = []
                    now = int(shard[start])
                    held.append(batch.slice(start, stop - start))
        if held:
            yield blocks(now, held)

    return run


def _write_segment(rows: DataFrame, root: str, name: str, dead: DataFrame | None = None, less: DataFrame | None = None) -> None:
    """rows: (shard, doc_id, doc_len, counts); less: the same of the documents that are dead from now on."""
    spark, at = rows.sparkSession, f"{root}/segments/{name}"
    with arrow_rows(spark, SHARD):
        rows.write.mode("overwrite").parquet(f"{at}/docs")
    docs = spark.read.schema(rows.schema).parquet(f"{at}/docs")
    schema = BLOCKS.format(id=dict(docs.dtypes)["doc_id"])
    with arrow_rows(spark, SHARD):
        docs.mapInArrow(_to_blocks(), schema).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{at}/blocks")
    df = blocks.select("term", F.size("ids").cast("long").alias("df"))
    size = docs.select(F.lit(1).alias("n"), F.col("doc_len").alias("len"))
    if less is not None:
        df = df.union(less.select(F.explode("counts.term").alias("term"), F.lit(-1).cast("long").alias("df")))
        size = size.union(less.select(F.lit(-1), -F.col("doc_len")))
    df.groupBy("term").agg(F.sum("df").alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/terms")
    terms = spark.read.parquet(f"{at}/terms")
    grams = terms.where("df > 0").select(F.explode(_grams(F.col("term"))).alias("gram"), "term")
    grams.repartition("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{at}/grams")
    shards = docs.select("shard").distinct().count()
    size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len")).withColumn("shards", F.lit(shards).cast("long")).write.mode("overwrite").parquet(f"{at}/stats")
    dead = spark.createDataFrame([], f"segment string, shard long, doc_id {dict(docs.dtypes)['doc_id']}") if dead is None else dead
    dead.write.mode("overwrite").parquet(f"{at}/dead")


def _grams(term):
    """Distinct pairs and triples of neighbouring characters."""
    of = lambda n: F.when(F.length(term) >= n, F.transform(F.sequence(F.lit(1), F.length(term) - (n - 1)), lambda i: F.substring(term, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(2), of(3)))


def build(docs: DataFrame, root: str | None = None, **columns) -> "BlockIndex":
    """Index of documents (doc_id, text, source) as the first segment below ``root`` (a fresh shared folder by default)."""
    root = root or f"{shared_dir(docs.sparkSession)}/index"
    name = uuid.uuid4().hex
    _write_segment(forward(docs, **columns), root, name)
    publish({"segments": docs.sparkSession.createDataFrame([(0, name)], "place int, name string")}, root)
    return BlockIndex(docs.sparkSession, root)


@dataclass(frozen=True)
class BlockIndex:
    """A stored index as of the version in use when it was opened."""

    spark: SparkSession
    root: str
    names: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.names:
            rows = read_current(self.spark, self.root, "segments").orderBy("place").collect()
            object.__setattr__(self, "names", tuple(r["name"] for r in rows))

    def table(self, kind: str) -> DataFrame:
        """A table of all segments, with the segment's name."""
        out = None
        for name in self.names:
            one = self.spark.read.parquet(f"{self.root}/segments/{name}/{kind}").withColumn("segment_of", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs, avg_len."""
        total = self.table("stats").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_docs", "n_docs"), ("total_len", "len"), ("shards", "shards"))])
        return total.select("n_docs", (F.col("len") / F.greatest("n_docs", F.lit(1))).alias("avg_len"), "shards")

    @property
    def terms(self) -> DataFrame:
        """term, df, idf of the documents that are live."""
        merged = self.table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return merged.withColumn("idf", lx.idf(self.stats.select("n_docs").scalar(), F.col("df")))

    @property
    def dead(self) -> DataFrame:
        """segment, shard, doc_id that no longer count."""
        return self.table("dead").select("segment", "shard", "doc_id")

    def live(self) -> DataFrame:
        """segment, shard, doc_id, doc_len, counts of the documents that count."""
        docs = self.table("docs").withColumnRenamed("segment_of", "segment")
        if len(self.names) == 1:
            return docs
        gone = self.dead.select("segment", "doc_id").distinct()
        return docs.join(hint_small(gone, is_small(gone)), ["segment", "doc_id"], "left_anti")

    # ------------------------------------------------------------ upkeep

    def refresh(self, docs: DataFrame | None = None, deletes: DataFrame | None = None, id_col: str = "doc_id", **columns) -> "BlockIndex":
        """One more segment: ``docs`` replace those of the same id, ``deletes`` (ids) go. Only these documents are read and written."""
        some = docs if docs is not None else deletes
        ids = None
        for frame in (docs, deletes):
            if frame is not None:
                one = frame.select(F.col(id_col).alias("doc_id"))
                ids = one if ids is None else ids.union(one)
        ids = materialise(ids.distinct(), "ids")
        gone = materialise(self.live().join(hint_small(ids, is_small(ids)), "doc_id", "left_semi"), "gone")
        added = forward(docs, id_col, **columns) if docs is not None else forward(some.limit(0).select(F.col(id_col).alias("doc_id"), F.lit("").alias("text"), F.lit("").alias("source")))
        name = uuid.uuid4().hex
        _write_segment(added, self.root, name, gone.select("segment", "shard", "doc_id"), gone.select("shard", "doc_id", "doc_len", "counts"))
        return self._publish([*self.names, name])

    def merge(self) -> "BlockIndex":
        """All live documents as one segment, from their stored counts."""
        name = uuid.uuid4().hex
        _write_segment(_sharded(self.live().select("doc_id", "doc_len", "counts")), self.root, name)
        return self._publish([name])

    def _publish(self, names: list[str]) -> "BlockIndex":
        rows = self.spark.createDataFrame(list(enumerate(names)), "place int, name string")
        publish({"segments": rows}, self.root)
        return BlockIndex(self.spark, self.root, tuple(names))

    def discard(self) -> None:
        """Delete an index that was built for one job, once nothing will read it again."""
        delete_folder(self.spark, self.root)

    @property
    def version(self) -> int:
        return current_version(self.spark, self.root)

    # ------------------------------------------------------------ vocabulary

    def partial_pairs(self, asked: DataFrame) -> DataFrame:
        """(qterm, term): query term and index term, one a substring of the other.

        Index terms around a query term are looked up by its rarest triple (or by itself, if it has two characters); those
        inside it are among its own substrings. Neither reads postings.
        """
        return self._look_up(asked)[0]

    def _look_up(self, asked: DataFrame) -> tuple[DataFrame, ...]:
        """The pairs, and the stored tables that they are read from."""
        q = materialise(asked.select(F.col("term").alias("qterm")).distinct(), "qterms")
        small = is_small(q)
        parts = q.where("length(qterm) = 2").select("qterm", F.col("qterm").alias("gram")).union(
            q.where("length(qterm) > 2").select("qterm", F.explode(F.filter(_grams(F.col("qterm")), lambda g: F.length(g) == 3)).alias("gram"))
        )
        parts = materialise(parts, "grams")
        wanted = hint_small(parts.select("gram").distinct(), small)
        grams = materialise(self.table("grams").select("gram", "term").join(wanted, "gram", "left_semi"), "found")
        count = grams.groupBy("gram").agg(F.count("*").alias("n"))
        rare = parts.join(count, "gram").groupBy("qterm").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("known"), F.max(F.length("qterm")).alias("size"))
        around = grams.join(hint_small(rare.select("qterm", "gram"), small), "gram").where(F.col("term").contains(F.col("qterm")))
        starts, sizes = F.sequence(F.lit(1), F.length("qterm") - 1), F.length("qterm")
        inside = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), sizes - i + 1), lambda n: F.substring("qterm", i, n))))
        subs = q.where("length(qterm) > 2").select("qterm", F.explode(F.array_distinct(inside)).alias("term"))
        known = self.table("terms").select("term").join(hint_small(subs, small), "term").select("qterm", "term")
        return around.select("qterm", "term").union(known).distinct(), q, parts, grams

    # ------------------------------------------------------------ search

    def search(self, queries: DataFrame, k: int, partial: bool = False, id_cols: list[str] | None = None, keep: DataFrame | None = None) -> DataFrame:
        """(id columns, doc_id, score), the best ``k`` of each query and possibly some more. ``keep``: the only ids that count, in statistics too."""
        id_cols = id_cols or ["query_id"]
        wanted = materialise(lx.query_terms(queries, id_cols), "wanted")
        rows = wanted.count()
        pairs = None
        if partial:
            found, *used = self._look_up(wanted.select("term"))
            pairs = materialise(found, "pairs")
            discard(*used)
        passes = max(1, -(-rows // ASKED))
        out = None
        for i in range(passes):
            mine = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64(*id_cols), F.lit(passes)) == i)
            found = self._pass(mine, id_cols, k, pairs, keep)
            out = found if out is None else out.unionByName(found)
        discard(pairs)  # each pass has stored its share by index term
        return out

    def _filters(self, keep: DataFrame | None) -> DataFrame | None:
        """(segment, shard, ids, keep): the dead of each shard, and the documents that are kept."""
        out = None
        if len(self.names) > 1:
            out = self.dead.groupBy("segment", "shard").agg(F.collect_set("doc_id").alias("ids")).withColumn("keep", F.lit(False))  # at most a shard
        if keep is not None:
            ids = keep.select("doc_id").distinct()
            docs = self.table("docs").select(F.col("segment_of").alias("segment"), "shard", "doc_id")
            mine = docs.join(ids, "doc_id", "left_semi").groupBy("segment", "shard").agg(F.collect_set("doc_id").alias("ids")).withColumn("keep", F.lit(True))
            out = mine if out is None else out.unionByName(mine)
        return out

    def _input(self, terms: DataFrame, small: bool, keep: DataFrame | None) -> DataFrame:
        """The blocks of the terms and the filters, dealt by shard; filters first. A column ``asked`` of the terms stays with their blocks."""
        more = [c for c in terms.columns if c == "asked"]
        blocks = self.table("blocks").withColumnRenamed("segment_of", "segment").join(hint_small(terms, small), "term", "inner" if more else "left_semi")
        rows = blocks.select("segment", "shard", F.lit(2).alias("kind"), "term", "ids", "tfs", "lens", "max_tf", "min_len", *more)
        filters = self._filters(keep)
        if filters is not None:
            none = F.array().cast("array<int>")
            filters = filters.select("segment", "shard", F.col("keep").cast("int").alias("kind"), F.lit("").alias("term"), "ids", none.alias("tfs"), none.alias("lens"), F.lit(0).alias("max_tf"), F.lit(0).alias("min_len"), *[none.alias(c) for c in more])
            rows = rows.unionByName(filters)
        return rows.repartition("segment", "shard").sortWithinPartitions("segment", "shard", "kind")

    def _pass(self, wanted: DataFrame, id_cols: list[str], k: int, pairs: DataFrame | None, keep: DataFrame | None) -> DataFrame:
        asked = wanted.toArrow().to_pandas()  # about ASKED rows
        id_type = dict(self.table("blocks").dtypes)["ids"].removeprefix("array<").removesuffix(">")
        ids = asked[id_cols].drop_duplicates().reset_index(drop=True)
        ids["q"] = np.arange(len(ids))
        asked = asked.merge(ids, on=id_cols)
        query_terms = np.unique(asked["term"].to_numpy(dtype=object)) if len(asked) else np.zeros(0, object)
        terms = self.spark.createDataFrame([(t,) for t in query_terms], "term string")
        small = len(query_terms) <= MAX_BROADCAST_ROWS
        about, partial_asked = self.stats.first(), pairs is not None
        if pairs is not None:
            # pairs grow with the vocabulary: they stay on the cluster, and an index term's blocks carry the query terms it matches
            coded = self.spark.createDataFrame([(t, i) for i, t in enumerate(query_terms)], "qterm string, code int")
            both = pairs.select("qterm", "term").union(terms.select(F.col("term").alias("qterm"), "term"))
            matched = both.join(hint_small(coded, small), "qterm").groupBy("term").agg(F.collect_set("code").alias("asked"))
            matched = materialise(matched, "matched")
            given = self._input(matched, is_small(matched), keep)
        else:
            given = self._input(terms, small, keep)
        if keep is not None:
            given = materialise(given, "given").repartition("segment", "shard").sortWithinPartitions("segment", "shard", "kind")
            size = self.live().select("doc_id", "doc_len").join(keep.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count("*"), F.sum("doc_len")).first()
            n_docs, avg_len = size[0], (size[1] or 0) / max(1, size[0])
            counted = given.mapInArrow(_count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
            known = counted.join(hint_small(terms, small), "term", "left_semi").collect()
        else:
            n_docs, avg_len = about["n_docs"], about["avg_len"]
            known = self.table("terms").join(hint_small(terms, small), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()
        df = {r["term"]: r["df"] for r in known}
        idf = np.array([np.log((n_docs - df[t] + 0.5) / (df[t] + 0.5) + 1) if t in df else np.log(n_docs + 1) for t in query_terms])
        asked["code"] = np.searchsorted(query_terms, asked["term"].to_numpy(dtype=object)) if len(asked) else np.zeros(0, np.int64)
        asked["weight"] = asked["qtf"].to_numpy(dtype=float) * idf[asked["code"].to_numpy(dtype=np.int64)]
        asked["df"] = [df.get(t, 0) for t in asked["term"]]
        plan = {"terms": query_terms.tolist(), "avg": avg_len or 1.0, "k": k, "partial": partial_asked, "id_type": id_type, "kept": keep is not None}
        schema = f"q int, doc_id {id_type}, score double"
        least = np.zeros(len(ids))
        if about["shards"] >= SEED and not partial_asked:
            # a first search for some of the rarest terms: what it finds is scored in part, so the k-th score is a bound from below
            rare = asked[asked["df"] > 0].sort_values(["q", "df", "code"])
            before = rare.groupby("q")["df"].cumsum() - rare["df"]
            several = rare.groupby("q")["code"].transform("size") > 1
            rare = rare[(before < 2 * k) & several]
            if len(rare):
                few = self.spark.createDataFrame([(t,) for t in sorted(set(rare["term"]))], "term string")
                first = given.join(F.broadcast(few.union(self.spark.createDataFrame([("",)], "term string"))), "term", "left_semi").repartition("segment", "shard").sortWithinPartitions("segment", "shard", "kind") if keep is not None else self._input(few, True, None)
                best = first.mapInArrow(_score(self.spark, plan | _asked(rare, len(ids)), least), schema).where("q >= 0")
                for r in lx.top_k(best, ["q"], k, [F.desc("score")]).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect():
                    least[r["q"]] = r["least"] - SLACK
        elif partial_asked and len(ids) * k * about["shards"] > HANDED:
            # the k-th score within some shards is a bound from below: tasks hand on what may beat it, not k rows a query each
            some = given.where(F.pmod(F.xxhash64("segment", "shard"), F.lit(FEW)) == 0).repartition("segment", "shard").sortWithinPartitions("segment", "shard", "kind")
            best = some.mapInArrow(_score(self.spark, plan | _asked(asked, len(ids)), least), schema).where("q >= 0")
            for r in lx.top_k(best, ["q"], k, [F.desc("score")]).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect():
                least[r["q"]] = r["least"] - SLACK
        found = given.mapInArrow(_score(self.spark, plan | _asked(asked, len(ids)), least), schema).where("q >= 0")
        named = self.spark.createDataFrame(ids.astype({"q": "int32"}) if len(ids) else [], schema=self._id_schema(wanted, id_cols))
        return found.join(F.broadcast(named), "q").select(*id_cols, "doc_id", "score")

    @staticmethod
    def _id_schema(wanted: DataFrame, id_cols: list[str]) -> str:
        kinds = dict(wanted.dtypes)
        return ", ".join([*(f"{c} {kinds[c]}" for c in id_cols), "q int"])


class AdHocIndex(BlockIndex):
    """Blocks of the terms that one table of queries asks for, made in one pass and written once; no vocabulary, no upkeep."""

    def table(self, kind: str) -> DataFrame:
        rows = self.spark.read.parquet(self.root)
        if kind == "stats":  # a row per shard: documents and their length
            rows = rows.where("term = ''").select(F.col("max_tf").cast("long").alias("n_docs"), F.col("min_len").cast("long").alias("total_len"), F.lit(1).alias("shards"))
        else:
            rows = rows.where("term <> ''")
            rows = rows.select("term", F.size("ids").cast("long").alias("df")) if kind == "terms" else rows
        return rows.withColumn("segment_of", F.lit(""))


def ad_hoc(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> AdHocIndex | None:
    """Index of the query terms only, in one pass over the documents; None where these are more than a pass of ``ASKED``."""
    terms = queries.select(F.explode(lx.index_tokens("text")).alias("term")).distinct().limit(ASKED + 1).toArrow()["term"]
    if len(terms) > ASKED:
        return None
    terms = pa.chunked_array(terms).combine_chunks() if not isinstance(terms, pa.ChunkedArray) else terms.combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    body = F.coalesce(F.col(text_col), F.lit(""))
    if source_col:
        body = F.concat(body, F.lit(" "), F.coalesce(F.col(source_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(body).alias("low"), F.monotonically_increasing_id().alias("place"))
    schema = BLOCKS.format(id=dict(texts.dtypes)["doc_id"])
    root = f"{shared_dir(docs.sparkSession)}/asked"
    with arrow_rows(docs.sparkSession, SHARD):
        texts.mapInArrow(_asked_blocks(shared), schema).write.mode("overwrite").parquet(root)
    return AdHocIndex(docs.sparkSession, root, ("",))


def _asked_blocks(shared):
    """Blocks of the wanted terms, and a row with the empty term: number (max_tf) and length (min_len) of a batch's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for whole in batches:
            for start in range(0, len(whole), SHARD):
                batch = whole.slice(start, SHARD)
                ids, parts = batch.column("doc_id"), []
                sizes = np.zeros(len(ids), np.int64)
                for first in range(0, len(ids), TEXTS_AT_ONCE):
                    tokens, at = flat_tokens(batch.column("low").slice(first, TEXTS_AT_ONCE))
                    coded = tokens.dictionary_encode()
                    code = pc.index_in(coded.dictionary, value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
                    term = ~pc.is_in(coded.dictionary, value_set=STOP_WORDS).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
                    sizes += np.bincount(at[term] + first, minlength=len(ids))
                    parts.append((code[code >= 0].astype(np.int64), at[code >= 0] + first))
                code, doc = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                rank = np.empty(len(ids), np.int64)
                by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
                rank[by_id] = np.arange(len(ids))
                key, tf = np.unique(code * len(ids) + rank[doc], return_counts=True)
                term, doc = key // max(1, len(ids)), by_id[key % max(1, len(ids))]
                starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
                offsets = pa.array(np.r_[starts, len(term), len(term)].astype(np.int32))  # the last list, of the row of sums, is empty
                lens = sizes[doc]
                most = np.maximum.reduceat(tf, starts) if len(starts) else tf
                least = np.minimum.reduceat(lens, starts) if len(starts) else lens
                arrays = [
                    pa.array(np.full(len(starts) + 1, batch.column("place")[0].as_py())),
                    pa.concat_arrays([wanted.take(pa.array(term[starts])), pa.array([""])]),
                    pa.ListArray.from_arrays(offsets, ids.take(pa.array(doc))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(lens.astype(np.int32))),
                    pa.array(np.r_[most, len(ids)].astype(np.int32)),
                    pa.array(np.r_[least, sizes.sum()].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "term", "ids", "tfs", "lens", "max_tf", "min_len"])

    return run


def _asked(rows, n: int) -> dict:
    """Terms and weights of the queries 0 to n - 1, one after the other."""
    rows = rows.sort_values("q", kind="stable")
    counts = np.bincount(rows["q"].to_numpy(dtype=np.int64), minlength=n)
    return {"offsets": np.r_[0, np.cumsum(counts)].astype(np.int64), "codes": rows["code"].to_numpy(dtype=np.int64), "weights": rows["weight"].to_numpy(dtype=float)}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(filters, block rows) of each shard; a block row is (term, lists, place in these, max_tf, min_len); the lists are undecoded: ids, tfs, lens[, asked]."""
    now, filters, rows = None, [], []
    for batch in batches:
        segment, shard, kind, term = (batch.column(i).to_pylist() for i in range(4))
        lists = [_Lists(batch.column(i)) for i in (4, 5, 6, *range(9, batch.num_columns))]
        most, least = batch.column(7).to_numpy(), batch.column(8).to_numpy()
        for i in range(len(batch)):
            key = (segment[i], shard[i])
            if key != now:
                if rows:
                    yield filters, rows
                now, filters, rows = key, [], []
            if kind[i] < 2:
                filters.append((bool(kind[i]), _decoded(lists[0], i)))
            else:
                rows.append((term[i], lists, i, most[i], least[i]))
    if rows:
        yield filters, rows


class _Lists:
    """A batch's lists; offsets are read once, and values are numbers at once or decoded list by list."""

    def __init__(self, column: pa.ListArray):
        self.offsets = column.offsets.to_numpy().tolist()
        plain = pa.types.is_integer(column.type.value_type) and not column.values.null_count
        self.values = column.values.to_numpy() if plain else column.values


def _decoded(lists: _Lists, i: int) -> np.ndarray:
    some = lists.values[lists.offsets[i] : lists.offsets[i + 1]]
    return some if isinstance(some, np.ndarray) else some.to_numpy(zero_copy_only=False)


def _allowed(ids: np.ndarray, filters: list) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for keeps, named in filters:
        ok &= np.isin(ids, named) == keeps
    return ok


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents of each block that count; a shard without kept documents has no keep row, so it counts none."""
    for filters, rows in _shards(batches):
        if not any(keeps for keeps, _ in filters):
            continue
        found = [(r[0], int(_allowed(_decoded(r[1][0], r[2]), filters).sum())) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["term", "n"])


def _impact(tf: np.ndarray, lens: np.ndarray, avg: float) -> np.ndarray:
    return tf * (fv.BM25_K1 + 1) / (tf + fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * lens / avg))


class _Shard:
    """The decoded postings of a shard by term code: places (in order of the ids) and impacts."""

    def __init__(self, rows: list, codes: dict, filters: list, avg: float):
        parts = [(codes[r[0]], *(_decoded(c, r[2]) for c in r[1][:3])) for r in rows]
        sizes = [len(p[1]) for p in parts]
        code = np.repeat(np.array([p[0] for p in parts], np.int64), sizes)
        ids, tf, lens = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        if filters:
            ok = _allowed(ids, filters)
            code, ids, tf, lens = code[ok], ids[ok], tf[ok], lens[ok]
        self.ids, place = np.unique(ids, return_inverse=True)
        order = np.lexsort((place, code))
        self.place, self.tf = place[order], tf[order].astype(float)
        self.length = np.ones(len(self.ids))
        self.length[place] = lens
        self._group(code[order], avg)

    def _group(self, code: np.ndarray, avg: float) -> None:
        self.impact = _impact(self.tf, self.length[self.place], avg)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        self.span = {int(c): (int(s), int(e)) for c, s, e in zip(code[starts], starts, np.r_[starts[1:], len(code)][: len(starts)], strict=True)}
        self.most = {c: float(self.impact[s:e].max()) for c, (s, e) in self.span.items()}
        self.code = code

    def spread(self, q: np.ndarray, t: np.ndarray, n_query_terms: int, avg: float) -> None:
        """Postings of query terms from those of the index terms around or inside them (codes from ``n_query_terms`` on); a part counts once.

        Documents are marked for some query terms at a time, so memory depends on neither their number nor that of the pairs.
        """
        n = max(1, len(self.ids))
        first = np.zeros(max([*self.span, *([int(t.max())] if len(t) else [])], default=0) + 1, np.int64)
        size = np.zeros_like(first)
        for c, (s, e) in self.span.items():
            first[c], size[c] = s, e - s
        here = np.flatnonzero(size[t] > 0)
        here = here[np.argsort(q[here], kind="stable")]
        q, t = q[here].astype(np.int64), t[here]
        exact = self.code < n_query_terms
        own = self.code[exact] * n + self.place[exact]  # ascending
        keys, step = [np.zeros(0, np.int64)], max(1, MARKS // n)
        for low in range(0, n_query_terms, step):
            mine = slice(*np.searchsorted(q, (low, low + step)))
            mine_own = slice(*np.searchsorted(own, (low * n, (low + step) * n)))
            if mine.start == mine.stop and mine_own.start == mine_own.stop:
                continue
            marks = np.zeros(min(step, n_query_terms - low) * n, bool)
            marks[own[mine_own] - low * n] = True
            terms, asked = t[mine], q[mine] - low
            total = np.cumsum(size[terms])
            cuts = np.searchsorted(total, np.arange(AT_ONCE, (total[-1] if len(total) else 0) + AT_ONCE, AT_ONCE))
            for part in np.split(np.arange(len(terms)), np.unique(cuts)):
                if len(part):
                    sizes = size[terms[part]]
                    at = np.repeat(first[terms[part]] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                    marks[np.repeat(asked[part] * n, sizes) + self.place[at]] = True
            keys.append(np.flatnonzero(marks) + low * n)
        key = np.concatenate(keys)
        tf = np.ones(len(key))
        tf[np.searchsorted(key, own)] = self.tf[exact]
        self.place, self.tf = key % n, tf
        self._group(key // n, avg)


def _score(spark: SparkSession, plan: dict, least: np.ndarray):
    """(q, doc_id, score): what may be among the first k of each query. A task's last row has q = -1 and the number of postings it scored."""
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        k, avg, offsets, codes, weights = p["k"], p["avg"], p["offsets"], p["codes"], p["weights"]
        n_terms = len(p["terms"])
        code_of = {t: i for i, t in enumerate(p["terms"])}
        theta, scored, best_of = least.copy(), 0, {}
        by_term = [np.zeros(0, np.int64)] * n_terms
        if len(codes):
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            order = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[order], np.arange(n_terms + 1))
            by_term = [owner[order[s:e]] for s, e in zip(starts[:-1], starts[1:], strict=True)]
        id_type = pa.int64() if p["id_type"] == "bigint" else None

        for filters, rows in _shards(batches):
            if p["kept"] and not any(keeps for keeps, _ in filters):
                continue
            if not p["partial"]:
                # bounds alone first: which queries can still gain from this shard, and which blocks these need
                top = np.zeros(n_terms)
                for term, _, _, most, shortest in rows:
                    c = code_of[term]
                    top[c] = max(top[c], _impact(float(most), float(shortest), avg))
                reach = np.add.reduceat(np.r_[weights * top[codes], 0.0], offsets[:-1]) if len(codes) else np.zeros(0)
                alive = np.flatnonzero((reach > 0) & (reach >= theta))
                if not len(alive):
                    continue
                needed = np.zeros(n_terms, bool)
                for q in alive:
                    needed[codes[offsets[q] : offsets[q + 1]]] = True
                rows = [r for r in rows if needed[code_of[r[0]]]]
                shard = _Shard(rows, code_of, filters, avg)
            else:
                # an index term that is no query term gets a code behind them, within this shard
                codes_here: dict[str, int] = {}
                for r in rows:
                    codes_here.setdefault(r[0], code_of.get(r[0], n_terms + len(codes_here)))
                shard = _Shard(rows, codes_here, filters, avg)
                asked = [_decoded(r[1][3], r[2]) for r in rows]
                of = np.repeat(np.array([codes_here[r[0]] for r in rows], np.int64), [len(a) for a in asked])
                shard.spread(np.concatenate(asked), of, n_terms, avg)
                present = [by_term[c] for c in shard.span if c < n_terms]
                alive = np.unique(np.concatenate(present)) if present else np.zeros(0, np.int64)
            if not len(shard.ids):
                continue
            out_q, out_at, out_s = [], [], []
            for q in alive:
                mine = [(weights[i] * shard.most[codes[i]], weights[i], codes[i]) for i in range(offsets[q], offsets[q + 1]) if codes[i] in shard.span]
                if not mine:
                    continue
                mine.sort(reverse=True)
                rest = np.r_[np.cumsum([m[0] for m in mine][::-1])[::-1], 0.0]
                if rest[0] < theta[q]:
                    continue
                acc, cand = None, None
                for i, (_, w, c) in enumerate(mine):
                    s, e = shard.span[c]
                    if cand is None and i and rest[i] < theta[q]:
                        cand = np.flatnonzero(acc)
                    if cand is None:
                        if acc is None:
                            acc = np.zeros(len(shard.ids))
                        acc[shard.place[s:e]] += w * shard.impact[s:e]
                        scored += e - s
                    else:
                        cand = cand[acc[cand] + rest[i] >= theta[q]]
                        if not len(cand):
                            break
                        at = np.minimum(np.searchsorted(shard.place[s:e], cand), e - s - 1) + s
                        hit = shard.place[at] == cand
                        acc[cand[hit]] += w * shard.impact[at[hit]]
                        scored += int(hit.sum())
                if cand is None:
                    cand = np.flatnonzero(acc)
                score = acc[cand]
                good = score >= theta[q]
                cand, score = cand[good], score[good]
                if len(cand) > k:
                    best = np.lexsort((cand, -np.round(score, 9)))[:k]
                    cand, score = cand[best], score[best]
                if len(score):
                    top_so_far = np.sort(np.r_[best_of.get(q, np.zeros(0)), score])[::-1][:k]
                    best_of[q] = top_so_far
                    if len(top_so_far) == k:
                        theta[q] = max(theta[q], top_so_far[-1] - SLACK)
                out_q.append(np.full(len(cand), q))
                out_at.append(cand)
                out_s.append(score)
            if out_q:
                at = np.concatenate(out_at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q), pa.int32()), pa.array(shard.ids[at], id_type), pa.array(np.concatenate(out_s))], names=["q", "doc_id", "score"]
                )
        ids = pa.array([None], id_type or pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), ids, pa.array([float(scored)])], names=["q", "doc_id", "score"])

    return run
