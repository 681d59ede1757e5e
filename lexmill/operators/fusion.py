"""Dense search, reciprocal rank fusion, diversity selection, unions of branches, rerank fallback and relevance gate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.sources.shared import keep

from .bm25 import top
from .ranking import NO_SCORE, best_of

RRF_K, LAMBDA, LOW_RELEVANCE = 60, 0.5, -6.8
#: Queries of a block that is compared with every vector: a broadcast of this size at most. Vectors of a group.
QUERY_BLOCK, VECTOR_GROUP = 4096, 20_000
#: Queries and vectors whose products stand in memory at once: some 8 MB a table of them.
TILE = (512, 2048)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 0 where either has no length; arrays of unequal size raise."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal size")).cast("double"))
        .when(norm == 0, F.lit(0.0))
        .otherwise(dot(a, b) / norm)
    )


def _best(keys: np.ndarray, q: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int, digits: int) -> tuple[np.ndarray, ...]:
    """The k best vectors of batches (ids, matrix) for each query (row of q): query keys, ids and scores, flat. Ties go to
    the smallest id. Products are made of TILE queries and vectors at once, so memory doesn't grow with either."""
    unit = 10**digits
    norms = np.linalg.norm(q, axis=1)
    best, best_id = np.full((len(keys), k), NO_SCORE), np.zeros((len(keys), k), np.int64)
    for ids, v in batches:
        if not len(ids):
            continue
        if v.shape[1] != q.shape[1]:
            raise ValueError("vectors of unequal size")
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        lengths = np.linalg.norm(v, axis=1)
        for i in range(0, len(keys), TILE[0]):
            rows = slice(i, i + TILE[0])
            for j in range(0, len(ids), TILE[1]):
                cols = slice(j, j + TILE[1])
                norm = norms[rows, None] * lengths[None, cols]
                scores = np.divide(q[rows] @ v[cols].T, norm, out=np.zeros_like(norm), where=norm != 0)
                scores *= unit
                best[rows], best_id[rows] = best_of(best[rows], best_id[rows], np.rint(scores, out=scores).astype(np.int64), ids[cols], k)
    here = best != NO_SCORE
    return np.repeat(keys, here.sum(1)), best_id[here], best[here] / unit


def dense_search(vectors: DataFrame, doc: str, queries: DataFrame, query: str, k: int, digits: int = 6) -> DataFrame:
    """(query, doc, score, rank) by cosine over column vec of both sides.

    Up to QUERY_BLOCK queries, which are counted first, are broadcast: each partition of vectors multiplies matrices where
    it stands and keeps k hits per query, so what is shuffled is k rows per query and partition. More queries are dealt
    into blocks of that size, vectors into groups of VECTOR_GROUP, and each pair of both is one task's work.
    """
    as_array = lambda df: F.col("vec") if dict(df.dtypes)["vec"] == "array<float>" else F.col("vec").cast("array<double>")
    asked = queries.select(F.col(query).cast("long").alias(query), as_array(queries).alias("vec"))
    known = vectors.select(F.col(doc).cast("long").alias(doc), as_array(vectors).alias("vec"))
    schema = f"{query} long, {doc} long, score double"
    matrix = lambda pdf: np.array(pdf["vec"].tolist(), np.float64)
    n = asked.count()

    def hits(keys: np.ndarray, q: np.ndarray, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        found = _best(keys, q, ((pdf[doc].to_numpy(), matrix(pdf)) for pdf in batches if len(pdf)), k, digits)
        return pd.DataFrame(dict(zip((query, doc, "score"), found)))

    if n <= QUERY_BLOCK:
        rows = asked.collect()  # QUERY_BLOCK at most
        given = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, q = given.value
            if len(keys):
                yield hits(keys, q, batches)

        return top(known.mapInPandas(run, schema), query, "score", doc, k)

    blocks, groups = -(-n // QUERY_BLOCK), max(1, -(-known.count() // VECTOR_GROUP))
    block, group = F.pmod(F.xxhash64(query), F.lit(blocks)).alias("b"), F.pmod(F.xxhash64(doc), F.lit(groups)).alias("p")
    left = known.select(doc, "vec", group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    right = asked.select(query, "vec", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("p"))

    def pair(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({query: [], doc: [], "score": []})
        return hits(q[query].to_numpy(), matrix(q), iter([v]))

    met = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInPandas(pair, schema)
    return top(met, query, "score", doc, k)


def dense_search_once(vectors: DataFrame, doc: str, queries: DataFrame, query: str, k: int, digits: int = 6) -> DataFrame:
    """The rows of dense_search(), where many queries have equal vectors: each vector is searched once."""
    asked = keep(queries.select(F.col(query).cast("long").alias(query), "vec"))
    one = keep(asked.groupBy("vec").agg(F.min(query).alias("__of")))
    found = dense_search(vectors, doc, one.select(F.col("__of").alias(query), "vec"), query, k, digits).withColumnRenamed(query, "__of")
    return asked.join(one, "vec").select(query, "__of").join(found, "__of").select(query, doc, "score", "rank")


def fetch(hits: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of the table for the wanted keys; missing keys are absent."""
    return hits.select(key).distinct().join(table, key)


def fill_missing(candidates: DataFrame, table: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates with columns filled from the table where null, without those still unknown; and those dropped."""
    known = table.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__known"))
    joined = candidates.join(known, key, "left")
    filled = joined.select(
        *[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in candidates.columns], "__known"
    )
    here = F.col("__known").isNotNull()
    for c in columns:
        here = here | F.col(c).isNotNull()
    return filled.filter(here).drop("__known"), filled.filter(~here).drop("__known")


def rrf(dense: DataFrame, sparse: DataFrame, query: str, doc: str, k: int = RRF_K) -> DataFrame:
    """(query, doc, rrf_score, pos): sum of 1 / (k + rank), in the order of score, then dense before sparse-only hits."""
    both = dense.select(query, doc, "rank", F.col("rank").cast("long").alias("pos")).unionByName(
        sparse.select(query, doc, "rank", (F.col("rank") + 1_000_000).cast("long").alias("pos"))
    )
    merged = both.groupBy(query, doc).agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("rrf_score"), F.min("pos").alias("pos"))
    order = W.partitionBy(query).orderBy(F.col("rrf_score").desc(), "pos")
    return merged.withColumn("rank", F.row_number().over(order)).drop("pos")


def mmr(candidates: DataFrame, query: str, doc: str, n: int, lam: float = LAMBDA) -> DataFrame:
    """(query, doc, rank): greedy maximal marginal relevance over candidates (query, doc, pos, vec, qvec).

    At each step the candidate of greatest lam cos(d, q) - (1 - lam) max cos(d, picked) is taken, the first among
    equals; candidates without a vector are left out. A query's candidates are the few that fusion has kept.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["vec"].notna()].sort_values("pos")
        if not len(pdf):
            return pd.DataFrame({query: [], doc: [], "rank": []})
        v = np.array(pdf["vec"].tolist(), np.float64)
        q = np.array(pdf["qvec"].iloc[0], np.float64)
        v /= np.where((m := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, m)
        q /= np.linalg.norm(q) or 1
        relevance, alike = v @ q, v @ v.T
        picked: list[int] = []
        left = list(range(len(v)))
        while left and len(picked) < n:
            scores = [round(lam * relevance[i] - (1 - lam) * (max(alike[i][picked]) if picked else 0.0), 9) for i in left]
            picked.append(left.pop(int(np.argmax(scores))))
        return pd.DataFrame({query: pdf[query].iloc[0], doc: pdf[doc].to_numpy()[picked], "rank": range(1, len(picked) + 1)})

    kind = dict(candidates.dtypes)
    return candidates.groupBy(query).applyInPandas(pick, f"{query} {kind[query]}, {doc} {kind[doc]}, rank int")


def union_dedupe(branches: list[DataFrame], query: str, doc: str) -> DataFrame:
    """Rows of all branches, the first occurrence of each document by branch, then rank."""
    marked = [b.select(query, doc, F.lit(k).alias("branch"), F.col("rank").cast("int").alias("rank")) for k, b in enumerate(branches)]
    all_ = marked[0]
    for m in marked[1:]:
        all_ = all_.unionByName(m)
    first = W.partitionBy(query, doc).orderBy("branch", "rank")
    kept = all_.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
    return kept.withColumn("pos", F.row_number().over(W.partitionBy(query).orderBy("branch", "rank")))


def interleave(branches: list[DataFrame], query: str, doc: str, n: int) -> DataFrame:
    """Rank by rank through the branches, each document once: the order where no reranker answers."""
    marked = [b.select(query, doc, F.lit(k).alias("branch"), F.col("rank").cast("int").alias("rank")) for k, b in enumerate(branches)]
    all_ = marked[0]
    for m in marked[1:]:
        all_ = all_.unionByName(m)
    first = W.partitionBy(query, doc).orderBy("rank", "branch")
    kept = all_.withColumn("__k", F.row_number().over(first)).filter("__k = 1")
    order = W.partitionBy(query).orderBy("rank", "branch")
    return kept.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n).select(query, doc, "pos")


def rerank(candidates: DataFrame, query: str, doc: str, score: Column, n: int, fallback: DataFrame) -> DataFrame:
    """(query, doc, score, pos): the n best by score, ties in order of pos; where any score of a query is missing or not
    finite, the fallback's order with null scores."""
    good = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    scored = candidates.withColumn("score", score.cast("double")).withColumn(
        "__good", F.min(good.cast("int")).over(W.partitionBy(query)) == 1
    )
    order = W.partitionBy(query).orderBy(F.col("score").desc(), "pos")
    ranked = scored.withColumn("__r", F.row_number().over(order)).join(
        fallback.select(query, doc, F.col("pos").alias("__f")), [query, doc], "left"
    )
    place = F.when(F.col("__good"), F.col("__r")).otherwise(F.col("__f"))
    return ranked.select(query, doc, F.when(F.col("__good"), F.col("score")).alias("score"), place.alias("pos")).filter(F.col("pos") <= n)


def low_relevance(scores: Column, threshold: float = LOW_RELEVANCE) -> Column:
    """Whether the best score known lies below the threshold; without a score, no. An aggregate."""
    return F.coalesce(F.max(scores) < threshold, F.lit(False))
