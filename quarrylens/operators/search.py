"""Exact filtered vector search, re-ranking and de-duplication, for one query or for a table of jobs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions.scalars import cosine
from quarrylens.functions.vectors import cosine_to
from quarrylens.session import staged

CANDIDATES_PER_HIT = 30
VECTOR_BLOCK, JOB_BLOCK, TILE = 16_384, 32_768, 256  # vectors and questions of one task's product, and questions at once in it
FEW_GROUPS = 100_000  # sizes of groups that are broadcast, at most; more are joined by a shuffle


def unit(v: Column) -> Column:
    """The vector over its norm, in double precision; null for a zero vector."""
    x = v.cast("array<double>")
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    return F.when(n > 0, F.transform(x, lambda y: y / n))


def scored(vectors: DataFrame, query: list[float], vec: str = "embedding") -> DataFrame:
    """vectors with cosine and score = (1 + cosine) / 2; rows without a cosine (null, zero or other length) are left out."""
    return vectors.withColumn("cosine", cosine_to(F.col(vec), query)).filter("cosine IS NOT NULL").withColumn("score", (1 + F.col("cosine")) / 2)


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """The k most similar rows, ties by id: TakeOrderedAndProject keeps k rows a task and never sorts the table."""
    return scored(vectors, query, vec).orderBy(F.desc("score"), id_col).limit(k)


def filtered_top_k(vectors: DataFrame, query: list[float], k: int, condition: Column, mode: str = "post", candidates: int | None = None, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """post: the nearest candidates (30 k unless given) are taken first and filtered then, so there may be fewer than k.
    pre: filtered first."""
    if mode == "pre":
        return top_k(vectors.filter(condition), query, k, id_col, vec)
    if mode != "post":
        raise ValueError(f"unknown mode: {mode}")
    near = top_k(vectors, query, candidates or k * CANDIDATES_PER_HIT, id_col, vec)
    return near.filter(condition).orderBy(F.desc("score"), id_col).limit(k)


def allowed_top_k(vectors: DataFrame, allowed: DataFrame, query: list[float], k: int, candidates: int | None = None, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Post-filtered search where the filter is a table of ids with what they carry. The candidates are few by their limit, so
    they are the broadcast side, however large the allowed set is."""
    near = top_k(vectors, query, candidates or k * CANDIDATES_PER_HIT, id_col, vec)
    return allowed.join(F.broadcast(near), id_col).orderBy(F.desc("score"), id_col).limit(k)


def jobs_top_k(vectors: DataFrame, jobs: DataFrame, condition: Column, k: int, id_col: str = "id", vec: str = "embedding", job_vec: str = "q_vec") -> DataFrame:
    """job_id, id, score, rank: the k best rows of each job among those that meet the job's own condition (over columns of both).

    jobs is a small table of questions, checked to hold at most 10,000; vectors are scanned once for all jobs. Each task keeps
    k rows a job before the shuffle, as row_number() <= k is pushed below it.
    """
    if jobs.limit(10_001).count() > 10_000:
        raise ValueError("search at most 10,000 questions at a time")
    pairs = vectors.join(F.broadcast(jobs), condition)
    s = pairs.withColumn("score", (1 + cosine(F.col(vec), F.col(job_vec))) / 2).filter("score IS NOT NULL")
    w = Window.partitionBy("job_id").orderBy(F.desc("score"), id_col)
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the columns, summed in order as cosine() does, so that equal vectors have equal scores."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b):
        total += x * y
    return total


def _nearest(ids: pa.ChunkedArray, vectors: np.ndarray, asks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, score) of the k best rows of each question. Equal vectors are compared once; what a product of matrices puts
    within its error of the k best is scored again in order."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    rows = np.lexsort((place, group))
    start = np.searchsorted(group[rows], np.arange(len(first)))
    size = np.minimum(np.diff(np.append(start, len(rows))), k)
    x, q = vectors[first].astype(np.float64).T.copy(), asks.astype(np.float64).T.copy()
    nx, nq = np.sqrt(_dots(x, x)), np.sqrt(_dots(q, q))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, q.shape[1], TILE):
        norm = nq[lo : lo + TILE, None] * nx
        near = np.where(norm == 0, -np.inf, np.nan_to_num(q[:, lo : lo + TILE].T @ x / np.where(norm == 0, 1, norm), nan=np.inf))
        least = np.partition(near, len(first) - min(k, len(first)), axis=1)[:, -min(k, len(first))]
        j, u = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
        j += lo
        c = [_dots(x[:, u[a : a + 20_000]], q[:, j[a : a + 20_000]]) for a in range(0, len(j), 20_000)]
        score = (1 + np.concatenate([np.zeros(0), *c]) / (nx[u] * nq[j])) / 2
        n = size[u]
        r = rows[np.repeat(start[u], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        j, score = np.repeat(j, n), np.repeat(score, n)
        o = np.lexsort((place[r], -np.nan_to_num(score, nan=np.inf), j))
        j, r, score = j[o], r[o], score[o]
        best = np.arange(len(j)) - np.searchsorted(j, j) < k
        out.append((j[best], r[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def grouped_top_k(vectors: DataFrame, jobs: DataFrame, by: str, job_by: str, k: int, id_col: str = "id", vec: str = "embedding", job_vec: str = "q_vec", carry: list[str] | None = None) -> DataFrame:
    """job_id, the id, the columns in carry, score, rank: jobs_top_k() where the condition is that by (of vectors) equals job_by,
    for any number of jobs.

    Vectors and jobs of one group are cut into blocks by hash, every block of one meets every block of the other in a product of
    matrices, and each gives k rows a job, so that no task grows with the group. A vector is sent once for every JOB_BLOCK jobs.
    """
    carry = carry or []
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    v = vectors.filter(whole(vec)).select(F.col(by).alias("_g"), F.col(id_col).alias("_id"), *carry, F.col(vec).alias("_v"))
    j = jobs.filter(whole(job_vec)).select(F.col(job_by).alias("_g"), "job_id", F.col(job_vec).alias("_q"))
    blocks = lambda df, most, name: df.groupBy("_g").agg(F.ceil(F.count("*") / most).alias(name))
    sizes = staged(blocks(v, VECTOR_BLOCK, "_nv").join(blocks(j, JOB_BLOCK, "_nj"), "_g"), "search-blocks")
    s = F.broadcast(sizes) if sizes.count() <= FEW_GROUPS else sizes
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    v = v.join(s, "_g").withColumn("_vb", F.pmod(F.xxhash64("_id", *carry), F.col("_nv"))).withColumn("_jb", every("_nj")).drop("_nv", "_nj")
    j = j.join(s, "_g").withColumn("_jb", F.pmod(F.xxhash64("job_id"), F.col("_nj"))).withColumn("_vb", every("_nv")).drop("_nv", "_nj")

    def matrix(t: pa.Table, c: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(pc.list_value_length(t[c]).to_numpy() == n)
        return at, pc.list_flatten(t[c].take(pa.array(at))).to_numpy().reshape(len(at), n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for n in np.unique(pc.list_value_length(right["_q"]).to_numpy()).tolist():
            (rows, x), (asks, q) = matrix(left, "_v", n), matrix(right, "_q", n)
            if n and len(rows):
                got = left.take(pa.array(rows))
                a, r, score = _nearest(got["_id"], x, q, k)
                got = got.select(["_id", *carry]).take(pa.array(r))
                out.append(got.add_column(0, "job_id", right["job_id"].take(pa.array(asks[a]))).append_column("score", pa.array(score)))
        none = left.select(["_id", *carry]).slice(0, 0).add_column(0, "job_id", right["job_id"].slice(0, 0)).append_column("score", pa.array([], pa.float64()))
        return pa.concat_tables([none, *out])

    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(j, "job_id"), kind(v, "_id"), *(kind(v, c) for c in carry), "score double"])
    got = v.groupBy("_g", "_vb", "_jb").cogroup(j.groupBy("_g", "_vb", "_jb")).applyInArrow(run, schema).withColumnRenamed("_id", id_col)
    w = Window.partitionBy("job_id").orderBy(F.desc("score"), id_col, *carry)
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keep_first(df: DataFrame, id_col: str, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """The first row of each id in `order`; rows with a null or empty id are dropped."""
    w = Window.partitionBy(*(by or []), id_col).orderBy(*order)
    rows = df.filter(F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != ""))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def words_of(text: Column) -> Column:
    """Distinct words of a-z and 0-9 of three letters or more, in lower case."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 3))


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has: the offline stand-in for a cross-encoder."""
    q = words_of(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words_of(text))) / F.size(q)).otherwise(0.0)


def rerank(hits: DataFrame, k: int, query: str = "q", text: str = "parent_text", by: list[str] | None = None, order: list[Column | str] | None = None, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """The k best hits of each group by rerank_score, ties in the former order. scorer may be any column function or pandas UDF
    over (query, text); no hits give none. If there is no scorer to be had (it raises), the first k in the former order are taken
    unchanged, with a null score. Without groups the k best are found by partial top-k; nothing is sorted as a whole."""
    order = order or [F.desc("score"), "id"]
    try:
        rows = hits.withColumn("rerank_score", scorer(F.col(query), F.col(text)))
    except Exception:
        rows = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    if not by:
        rows = rows.orderBy(F.desc("rerank_score"), *order).limit(k)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("rerank_score"), *order)
    return rows.withColumn("rerank", F.row_number().over(w)).filter(F.col("rerank") <= k)


def hashed_embedding(text: Column, dim: int = 128) -> Column:
    """Offline stand-in for an embedding model: unit counts of hashed words, counted in Arrow batches; null for no words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))

    @F.pandas_udf("array<double>")
    def counted(s: pd.Series) -> pd.Series:
        rows = []
        for v in s:
            n = np.bincount(v, minlength=dim).astype(float) if v is not None and len(v) else np.zeros(dim)
            rows.append(n / np.linalg.norm(n) if n.any() else None)
        return pd.Series(rows)

    return counted(slots)


def build_index(vectors: DataFrame, path: str, dim: int, id_col: str = "id", vec: str = "embedding") -> bool:
    """Writes (id, vector of norm 1) unless the index is there already; wrong lengths and zero vectors are left out. Says whether
    it has written."""
    jvm = vectors.sparkSession.sparkContext
    p = jvm._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(jvm._jsc.hadoopConfiguration()).exists(p):
        return False
    rows = vectors.filter(F.col(id_col).isNotNull() & (F.size(vec) == dim)).select(F.col(id_col).alias("id"), unit(F.col(vec)).alias("embedding"))
    rows.filter("embedding IS NOT NULL").write.parquet(path)
    return True


def index_top_k(spark: SparkSession, path: str, query: list[float], k: int) -> DataFrame:
    """top_k() over an index that build_index() has written."""
    return top_k(spark.read.parquet(path), query, k)
