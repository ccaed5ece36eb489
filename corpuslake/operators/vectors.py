"""Vector retrieval: embedding, exact and approximate nearest neighbours.

Exact search compares every query with every vector, which is what the
operator means, but no row pairs are formed: vectors stream through
``mapInArrow`` against a query matrix and each task keeps ``k`` rows per query.
Query sets beyond a checked bound are split into blocks instead and meet the
vectors block by block (``cogroup``), again keeping ``k`` rows per block. Approximate
search does the same with blocks of whole cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.scale import broadcast_if_small, is_small, materialise, shared_dir
from corpuslake.functions.text import norm_path
from corpuslake.functions.vectors import bag_of, hashed_bag_encoder
from corpuslake.operators.ranking import rrf

MAX_LOCAL_QUERIES = 20_000  # query vectors one task may hold
#: Rows of a block side. Every vector is shuffled once per query block and every query once per vector block.
QUERY_BLOCK, LEAST_BLOCK = 16_384, 2_048
VECTOR_BLOCK = 32_768
QUERIES_AT_ONCE = 64  # rows of a distance matrix
#: Rows that a query's first bound is taken from, at least; products in double precision at once. They decide speed, not results.
BOUND_ROWS, EXACT_AT_ONCE = 2_048, 1 << 16
DIST_DIGITS = 9  # distances are compared after rounding, ties go to the lower id


def embed(df: DataFrame, col: str = "text", encoder=None, out: str = "embedding") -> DataFrame:
    """Add an embedding column. ``encoder``: Column -> Column of array<double|float>."""
    encoder = encoder or hashed_bag_encoder()
    return df.withColumn(out, encoder(F.col(col)))


def unit_rows(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1, keepdims=True)
    return np.divide(mat, n, out=np.zeros_like(mat), where=n > 0)


def nearest_rows(qmat: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int, probed: np.ndarray | None = None, cell: np.ndarray | None = None):
    """Per query the ``k`` nearest rows by (rounded distance, id): index, id and distance arrays. All rows have unit length or zero.

    ``probed`` (queries x cells) with ``cell`` (of each row): only rows of a query's own cells count. Products in single precision, with
    their greatest possible error, only rule rows out: the k-th best of some rows is a bound from below for all. What is left is compared in double precision.
    """
    none = np.zeros(0, np.int64)
    out_q, out_id, out_d = [none], [none], [np.zeros(0)]
    sound = np.isfinite(mat).all(axis=1)
    if not sound.all():
        ids, mat, cell = ids[sound], mat[sound], None if cell is None else cell[sound]
    single, slack = mat.astype(np.float32), (mat.shape[1] + 4) * 2.0**-22 + 1e-8
    for start in range(0, len(qmat), QUERIES_AT_ONCE):
        some = qmat[start : start + QUERIES_AT_ONCE]
        own = None if probed is None else probed[start : start + QUERIES_AT_ONCE]
        rows = np.arange(len(mat)) if own is None else np.flatnonzero(own.any(axis=0)[cell])
        if not len(rows):
            continue
        near = some.astype(np.float32) @ (single.T if len(rows) == len(mat) else single[rows].T)
        step = max(1, len(rows) // max(BOUND_ROWS, 4 * k))
        part = near[:, ::step]
        if own is not None:
            part = np.where(own[:, cell[rows[::step]]], part, -np.inf)
        kk = min(k, part.shape[1])
        least = np.partition(part, part.shape[1] - kk, axis=1)[:, part.shape[1] - kk] - slack
        q, at = np.divmod(np.flatnonzero(near >= least[:, None]), len(rows))
        if own is not None:
            mine = own[q, cell[rows[at]]]
            q, at = q[mine], at[mine]
        # the k-th best of these is that of all rows
        value = near[q, at]
        order = np.lexsort((-value, q))
        q, at, value = q[order], at[order], value[order]
        first = np.searchsorted(q, np.arange(len(some) + 1))
        last = np.minimum(first[:-1] + k, first[1:]) - 1
        left = value >= value[last][q] - slack if len(value) else np.zeros(0, bool)
        q, at = q[left], rows[at[left]]
        exact = [np.einsum("ij,ij->i", some[q[i : i + EXACT_AT_ONCE]], mat[at[i : i + EXACT_AT_ONCE]]) for i in range(0, len(q), EXACT_AT_ONCE)]
        dist = np.round(1.0 - np.concatenate([np.zeros(0), *exact]), DIST_DIGITS)
        order = np.lexsort((ids[at], dist, q))
        q, at, dist = q[order], at[order], dist[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out_q.append(start + q[best])
        out_id.append(ids[at[best]])
        out_d.append(dist[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_d)


def keep_best(parts, k: int) -> pd.DataFrame:
    """Merge (q, id, d) candidate frames, best ``k`` per query."""
    df = pd.concat(parts, ignore_index=True)
    df = df.sort_values(["q", "d", "id"], kind="stable")
    return df[df.groupby("q").cumcount() < k].reset_index(drop=True)


def list_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _frame(q, ids, d) -> pd.DataFrame:
    return pd.DataFrame({"q": q, "id": ids, "d": d})


def _candidates(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, query_id: str, order: list[int] | None = None, text_col: str | None = None
) -> DataFrame:
    """(query_id, id, distance) with at most ``k`` rows per query and task.

    ``vectors`` carry ``_cell``; a query meets the cells whose bits are set in its ``_cells``. ``text_col``: texts in place of vectors.
    """
    qtype = queries.schema[query_id].dataType
    schema = T.StructType(
        [
            T.StructField(query_id, qtype),
            T.StructField(id_col, T.LongType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    small = is_small(queries, MAX_LOCAL_QUERIES)
    if text_col and not small:
        vectors, text_col = embed(vectors, text_col, out=vec_col), None
    vectors = vectors.select(F.col(id_col).cast("long"), F.lower(text_col) if text_col else vec_col, F.col("_cell").cast("int"))
    if small:
        return _map_side(vectors, queries, k, query_id, schema, bag_of() if text_col else None)
    return _block_side(vectors, queries, k, query_id, schema, order)


def _bits(column, n: int) -> np.ndarray:
    """Packed bits of ``n`` cells -> queries x cells."""
    rows = [np.frombuffer(b, np.uint8) for b in column]
    return np.unpackbits(np.stack(rows), axis=1)[:, :n].astype(bool) if rows else np.zeros((0, n), bool)


def _limits(probed: np.ndarray, cell: np.ndarray) -> np.ndarray | None:
    """None where all queries ask for all of these rows' cells."""
    return None if probed[:, np.unique(cell)].all() else probed


def _map_side(vectors, queries, k, query_id, schema, encode=None) -> DataFrame:
    # queries of like cells lie together, so that few other cells are looked at with them; bound checked by the caller
    small = queries.select(query_id, "embedding", "_cells").toArrow().sort_by("_cells")
    qids = small.column(0).combine_chunks()
    qmat = unit_rows(list_matrix(small.column(1)))
    bits = small.column(2).to_pylist()
    probed = _bits(bits, 8 * max(map(len, bits), default=0))

    def run(batches):
        best = None
        for batch in batches:
            if not len(batch) or not len(qmat):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            mat = unit_rows(list_matrix(encode(batch.column(1)) if encode else batch.column(1)))
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            found = _frame(*nearest_rows(qmat, ids, mat, k, _limits(probed, cells), cells))
            best = keep_best([found] if best is None else [best, found], k)
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays(
                [qids.take(pa.array(best["q"].to_numpy())), pa.array(best["id"]), pa.array(best["d"])],
                names=schema.names,
            )

    return vectors.mapInArrow(run, schema)


def _cell_blocks(sizes: dict[int, int], order: list[int]) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks): neighbouring cells share a block of about VECTOR_BLOCK rows, a larger cell takes several."""
    out, block, held = [], 0, 0
    for cell in order:
        n = sizes.get(cell, 0)
        if n and held and held + n > VECTOR_BLOCK:
            block, held = block + 1, 0
        parts = -(-n // VECTOR_BLOCK)
        if parts:
            out.append((cell, block, parts))
            held += n
        if parts > 1:
            block, held = block + parts, 0
    return out


def _block_side(vectors, queries, k, query_id, schema, order=None) -> DataFrame:
    """Blocks of at most about VECTOR_BLOCK x QUERY_BLOCK rows meet in one task each.

    A block holds whole cells. A query goes once to each block with a cell of its own, however many of them it holds.
    """
    n_q = queries.count()
    spark = queries.sparkSession
    # smaller blocks than QUERY_BLOCK only as long as they give the cores work
    cores = spark.sparkContext.defaultParallelism
    q_blocks = max(1, -(-n_q // QUERY_BLOCK), min(-(-n_q // LEAST_BLOCK), 2 * cores))
    # one row per cell, as many as the model holds on the driver
    sizes = {r["_cell"]: r["count"] for r in vectors.groupBy("_cell").count().collect()}
    places = _cell_blocks(sizes, sorted(sizes) if order is None else order)
    c = (
        vectors.join(F.broadcast(spark.createDataFrame(places, "_cell int, _first int, _parts int")), "_cell")
        .withColumn("_block", F.col("_first") + F.pmod(F.xxhash64(vectors.columns[0]), "_parts").cast("int"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        .drop("_first", "_parts")
    )
    blocks = max((first + parts for _, first, parts in places), default=0)
    n_cells = 8 * -(-(max(sizes, default=0) + 1) // 8)
    of_block = np.zeros((n_cells, blocks), bool)
    for cell, first, parts in places:
        of_block[cell, first : first + parts] = True

    @F.pandas_udf("array<int>")
    def wanted(bits: pd.Series) -> pd.Series:
        asked = _bits(bits, n_cells)
        meets = asked.astype(np.float32) @ of_block[: asked.shape[1]].astype(np.float32) > 0
        return pd.Series([np.flatnonzero(m).astype(np.int32) for m in meets], dtype=object)

    q = (
        queries.withColumn("_qb", F.pmod(F.xxhash64(query_id), F.lit(q_blocks)).cast("int"))
        .withColumn("_block", F.explode(wanted("_cells")))
        # fresh attributes: both sides may stem from one table
        .select("_block", "_qb", F.col(query_id).alias("_qid"), F.col("embedding").alias("_qvec"), F.col("_cells").alias("_bits"))
    )
    id_col, vec_col = vectors.columns[0], vectors.columns[1]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in schema.names})
        right = right.sort_values("_bits", kind="stable")  # queries of like cells together
        cell = left["_cell"].to_numpy()
        qi, ids, d = nearest_rows(
            unit_rows(np.stack(right["_qvec"].to_numpy()).astype(np.float64)),
            left[id_col].to_numpy(),
            unit_rows(np.stack(left[vec_col].to_numpy()).astype(np.float64)),
            k,
            _limits(_bits(right["_bits"], n_cells), cell),
            cell,
        )
        return pd.DataFrame(
            {query_id: right["_qid"].to_numpy()[qi], id_col: ids, "distance": d}
        )

    key = ["_block", "_qb"]
    return c.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(run, schema)


def distance_score(d: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + d)))


def _final_rank(cands: DataFrame, k: int, id_col: str, query_id: str) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy("distance", id_col)
    return (
        cands.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("score", distance_score(F.col("distance")))
    )


#: Column of the normalised source.
NORM = "source_norm"


def with_norm(vectors: DataFrame) -> DataFrame:
    """Vectors with their normalised source, to be stored in its order."""
    return vectors.withColumn(NORM, norm_path("source")).repartitionByRange(NORM).sortWithinPartitions(NORM)


def filter_vectors(
    vectors: DataFrame, sources: list[str] | None = None, tags: list[str] | None = None
) -> DataFrame:
    """Source in list and any tag in list, applied below the search.

    Vectors that are stored with their normalised source (``with_norm``) are filtered by that column, so the scan skips row groups.
    """
    if sources:
        wanted = [s.strip().lower().replace("\\", "/") for s in sources]
        stored = F.col(NORM) if NORM in vectors.columns else norm_path("source")
        vectors = vectors.where(stored.isin(*wanted))
    if tags:
        vectors = vectors.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return vectors


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    sources: list[str] | None = None,
    tags: list[str] | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    text_col: str | None = None,
) -> DataFrame:
    """Exact cosine k-NN: (query_id, id, distance, rank, score = 1/(1+distance)).

    With ``text_col`` the default encoder turns these texts into vectors in the worker that compares them.
    """
    v = filter_vectors(vectors, sources, tags).withColumn("_cell", F.lit(0))
    q = queries.select(query_id, "embedding").withColumn("_cells", F.unhex(F.lit("80")))
    return _final_rank(_candidates(v, q, k, id_col, vec_col, query_id, text_col=text_col), k, id_col, query_id)


@dataclass(frozen=True)
class CellModel:
    """Coarse cells of a vector table: centroids, and the folder that holds the vectors by cell."""

    centroids: np.ndarray
    path: str


#: Rows that the cells are fitted on at most; every row is indexed.
ANN_FIT_ROWS = 200_000


def ann_cells(n_rows: int) -> int:
    """The square root of the table's rows, so cells grow in number as they do in size."""
    return max(1, round(n_rows**0.5))


def ann_fit(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 7,
    path: str | None = None,
    fit_rows: int = ANN_FIT_ROWS,
) -> CellModel:
    """K-means cells, fitted on at most ``fit_rows`` rows, and the whole table written by cell (a folder each)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    path = path or f"{shared_dir(vectors.sparkSession)}/cells"
    n = vectors.count()
    sample = vectors.select(id_col, vec_col)
    if n > fit_rows:
        sample = sample.orderBy(F.xxhash64(id_col)).limit(fit_rows)
    feats = materialise(sample.select(F.col(vec_col).cast("array<double>").alias("v")), "sample")
    feats = feats.select(array_to_vector("v").alias("features")).persist()
    cells = min(ann_cells(n), max(1, feats.count()))
    if n:
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(feats)
        centroids = np.array(model.clusterCenters())
    else:
        centroids = np.ones((1, 1))
    feats.unpersist()
    placed = vectors.withColumn("_cell", _nearest(centroids)(F.col(vec_col)))
    placed.repartition("_cell", F.pmod(F.xxhash64(id_col), F.lit(16))).write.mode("overwrite").partitionBy("_cell").parquet(path)
    return CellModel(centroids, path)


def _cells_of(centroids: np.ndarray, vecs: pd.Series, n: int) -> np.ndarray:
    mat = unit_rows(np.stack(vecs.to_numpy()).astype(np.float64))
    near = mat @ unit_rows(centroids).T
    return near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]


def _nearest(centroids: np.ndarray):
    """Column function: vector -> its nearest cell."""

    @F.pandas_udf("int")
    def nearest_cell(vecs: pd.Series) -> pd.Series:
        return pd.Series(_cells_of(centroids, vecs, 1)[:, 0].astype(np.int32)) if len(vecs) else pd.Series([], dtype="int32")

    return nearest_cell


def _probes(centroids: np.ndarray, n: int):
    """Column function: vector -> its ``n`` nearest cells as packed bits."""

    @F.pandas_udf("binary")
    def probes(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype=object)
        asked = np.zeros((len(vecs), len(centroids)), bool)
        np.put_along_axis(asked, _cells_of(centroids, vecs, n), True, axis=1)
        return pd.Series([row.tobytes() for row in np.packbits(asked, axis=1)], dtype=object)

    return probes


def _asked_cells(queries: DataFrame) -> list[int]:
    """Cells that at least one query asks for."""

    def run(batches):
        bits = [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in x.column(0).to_pylist()]) for x in batches if len(x)]
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array([np.bitwise_or.reduce(bits).tobytes()], pa.binary())], names=["bits"])

    rows = queries.select("_cells").mapInArrow(run, "bits binary").collect()  # one row a task
    return np.flatnonzero(_bits([r["bits"] for r in rows], 8 * len(rows[0]["bits"])).any(axis=0)).tolist() if rows else []


def _chain(centroids: np.ndarray) -> list[int]:
    """Cells in an order in which neighbours are alike: from each to the nearest that is left."""
    cents = unit_rows(centroids)
    left, at, out = np.ones(len(cents), bool), 0, []
    while left.any():
        left[at] = False
        out.append(at)
        at = int(np.argmax(np.where(left, cents @ cents[at], -np.inf)))
    return out


def ann(
    model: CellModel,
    queries: DataFrame,
    k: int,
    nprobe: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
) -> DataFrame:
    """Approximate k-NN: only the folders of probed cells are read; distances are exact.

    With ``nprobe`` of at least the number of cells the result is exact.
    """
    probes = _probes(model.centroids, nprobe)(F.col("embedding"))
    q = materialise(queries.select(query_id, "embedding").withColumn("_cells", probes), "probes")
    vectors = queries.sparkSession.read.parquet(model.path).where(F.col("_cell").isin(_asked_cells(q)))
    found = _candidates(vectors, q, k, id_col, vec_col, query_id, _chain(model.centroids))
    return _final_rank(found, k, id_col, query_id)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row: share of the exact neighbours that were found."""
    hit = found.select("query_id", id_col, F.lit(1).alias("_f"))
    return exact.join(hit, ["query_id", id_col], "left").agg(
        (F.count("_f") / F.count("*")).alias("recall")
    )


def knn_multi(vectors: DataFrame, variants: DataFrame, k: int, rrf_k: int = 50, id_col: str = "vec_id") -> DataFrame:
    """One ranked list per query variant, fused by reciprocal rank.

    ``variants``: query_id, ord, embedding. Result distance is 1/(1+fused score).
    """
    # variants of one vector are searched once and dealt to their queries
    asked = variants.select(F.col("query_id").cast("long").alias("query_id"), F.col("ord").cast("long").alias("list"), "embedding", F.xxhash64("embedding").alias("_hash"))
    forms = asked.groupBy("embedding").agg(F.min("_hash").alias("_hash")).withColumn("_form", F.monotonically_increasing_id())
    forms = materialise(forms, "forms")
    same = (F.col("a._hash") == F.col("f._hash")) & F.col("a.embedding").eqNullSafe(F.col("f.embedding"))
    dealt = asked.alias("a").join(forms.alias("f"), same).select("query_id", "list", "_form")
    found = knn(vectors, forms.select("_form", "embedding"), k, id_col=id_col, query_id="_form").select("_form", F.col(id_col).alias("key"), "rank")
    lists = found.join(dealt, "_form").select("query_id", "list", "key", "rank")
    fused = rrf(lists, rrf_k).where(F.col("rank") <= k)
    return fused.select(
        "query_id", F.col("key").alias(id_col), "score", "rank", (1 / (1 + F.col("score"))).alias("distance")
    )
