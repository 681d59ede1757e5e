"""Queries of sparse, dense and hybrid search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import WHITE
from lexmill.operators import bm25, fusion
from lexmill.operators.ranking import global_row_number
from lexmill.registry import query
from lexmill.sources.shared import keep
from lexmill.sources.tables import read, read_dealt


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.terms(read_dealt(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.terms(read(spark, sf_dir, "benchmark"), "item_id", "text")


_TOKENS = f"list_filter(string_split_regex(lower(text), '{WHITE}+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))"
BM25_CTE = f"""
d AS (SELECT doc_id, {_TOKENS} AS terms FROM documents),
dt AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM dt GROUP BY doc_id, term),
st AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM d),
fit AS (SELECT term, count(*) AS df, ln(((SELECT n_docs FROM st) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY term),
dw AS (SELECT doc_id, term, tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (SELECT avgdl FROM st))) AS weight FROM tf),
q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark),
qw AS (SELECT item_id, q.term, idf AS weight FROM q JOIN fit ON q.term = fit.term),
hits AS (SELECT item_id, doc_id, round(sum(qw.weight * dw.weight), 6) AS score FROM qw JOIN dw ON qw.term = dw.term GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hits)
"""


def sparse_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    corpus, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    wanted = asked.select(F.explode("terms").alias("term"))
    fitted, weights = bm25.index_of(corpus, "doc_id", wanted)
    return bm25.search(weights, "doc_id", bm25.query_weights(asked, "item_id", fitted), "item_id", k)


@query("bm25_topk", f"WITH {BM25_CTE} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_hits(spark, sf_dir, 5)


def pruned_hits(spark: SparkSession, sf_dir: str, k: int) -> bm25.Pruned:
    corpus, asked = bm25.counted(_corpus(spark, sf_dir), "doc_id"), _questions(spark, sf_dir)
    fitted, weights = bm25.index_of(corpus, "doc_id", asked.select(F.explode("terms").alias("term")))
    postings, bounds = bm25.blocked(corpus, "doc_id", weights)
    return bm25.search_pruned(postings, bounds, "doc_id", bm25.query_weights(asked, "item_id", fitted), "item_id", k)


@query("bm25_topk_pruned", f"WITH {BM25_CTE} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with bounds on blocks of documents; pays where questions are few and documents many."""
    return pruned_hits(spark, sf_dir, 5).hits


@query("bm25_fit_terms", f"WITH {BM25_CTE} SELECT term, df, round(idf, 6) AS idf FROM fit")
def bm25_fit_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.fit(_corpus(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_term_ids", f"WITH {BM25_CTE} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM fit")
def bm25_term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all terms, sorted. Numbering is global, so it goes by ranges: ids within a range plus what lies before it."""
    return global_row_number(bm25.fit(_corpus(spark, sf_dir)).select("term"), ["term"], "term_id")


@query("bm25_stats", f"WITH {BM25_CTE} SELECT n_docs, round(avgdl, 6) AS avgdl FROM st")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.stats(_corpus(spark, sf_dir)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_doc_weights", f"WITH {BM25_CTE} SELECT doc_id, term, round(weight, 6) AS weight FROM dw")
def bm25_doc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.document_weights(_corpus(spark, sf_dir), "doc_id").withColumn("weight", F.round("weight", 6))


@query("bm25_query_weights", f"WITH {BM25_CTE} SELECT item_id, term, round(weight, 6) AS weight FROM qw")
def bm25_query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = bm25.fit(_corpus(spark, sf_dir))
    return bm25.query_weights(_questions(spark, sf_dir), "item_id", fitted).withColumn("weight", F.round("weight", 6))


@query(
    "bm25_sparse_vectors",
    f"""WITH {BM25_CTE} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, string_agg(term || ':' || CAST(CAST(round(weight * 1000) AS BIGINT) AS VARCHAR), ' ' ORDER BY term) AS vector
    FROM dw GROUP BY doc_id""",
)
def bm25_sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = bm25.document_weights(_corpus(spark, sf_dir), "doc_id")
    pair = F.struct("term", F.round(F.col("weight") * 1000).cast("long").cast("string").alias("w"))
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(x["term"], F.lit(":"), x["w"])), " ").alias("vector"),
    )


# Dense search: the first vectors are the queries.
_QVEC = "SELECT vec_id AS query_id, embedding AS vec FROM embeddings WHERE vec_id % 25 = 0"
DENSE_CTE = f"""
qv AS ({_QVEC}),
dh AS (SELECT query_id, e.vec_id, round(CASE WHEN list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) = 0 THEN 0 ELSE list_cosine_similarity(CAST(qv.vec AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) END, 6) AS score FROM qv, embeddings e),
dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM dh)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "vec")


def dense_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return fusion.dense_search(_vectors(spark, sf_dir), "vec_id", _query_vectors(spark, sf_dir), "query_id", k)


@query("dense_topk_cosine", f"WITH {DENSE_CTE} SELECT query_id, vec_id, score, rank FROM dense WHERE rank <= 20")
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir, 20)


# A second ranking for fusion: the same label first, then the nearest ids. It stands for the sparse list.
SPARSE_CTE = """
near AS (SELECT query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY abs(e.vec_id - query_id), e.vec_id) AS INTEGER) AS rank
  FROM qv JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.label = q.label),
sparse AS (SELECT * FROM near WHERE rank <= 20),
dense20 AS (SELECT * FROM dense WHERE rank <= 20),
lists AS (SELECT query_id, vec_id, rank, rank AS pos FROM dense20 UNION ALL SELECT query_id, vec_id, rank, rank + 1000000 FROM sparse),
merged AS (SELECT query_id, vec_id, round(sum(1e0 / (60 + rank)), 12) AS rrf_score, min(pos) AS pos FROM lists GROUP BY query_id, vec_id),
fused AS (SELECT query_id, vec_id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, pos) AS INTEGER) AS rank FROM merged)
"""


def label_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Numbered by label and id, a vector's k nearest of its label stand among the k before and the k after it."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", "label").filter("label IS NOT NULL")
    numbered = keep(global_row_number(table, ["label", "vec_id"], "n"))
    places = F.explode(F.sequence(F.col("n") - k, F.col("n") + k)).alias("n")
    asked = numbered.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), places)
    near = asked.join(numbered, "n").filter("own = label").select("query_id", "vec_id", (-F.abs(F.col("vec_id") - F.col("query_id"))).cast("double").alias("score"))
    return bm25.top(near, "query_id", "score", "vec_id", k)


def fused_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(dense_hits(spark, sf_dir, 20), label_hits(spark, sf_dir, 20), "query_id", "vec_id")


@query("rrf_fusion", f"WITH {DENSE_CTE}, {SPARSE_CTE} SELECT query_id, vec_id, rrf_score, rank FROM fused WHERE rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_hits(spark, sf_dir).filter("rank <= 20")


@query(
    "union_dedupe",
    f"""WITH {DENSE_CTE}, {SPARSE_CTE}, b AS (SELECT query_id, vec_id, 0 AS branch, rank FROM fused WHERE rank <= 10
      UNION ALL SELECT query_id, vec_id, 1, rank FROM dense WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, 2, rank FROM sparse WHERE rank <= 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY branch, rank) AS k FROM b)
    SELECT query_id, vec_id, branch, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY branch, rank) AS INTEGER) AS pos FROM k WHERE k = 1""",
)
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.union_dedupe(_branches(spark, sf_dir), "query_id", "vec_id")


def _branches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    dense, near = keep(dense_hits(spark, sf_dir, 20)), keep(label_hits(spark, sf_dir, 20))  # each read by two branches
    fused = keep(fusion.rrf(dense, near, "query_id", "vec_id").filter("rank <= 10"))
    return [fused, dense.filter("rank <= 10"), near.filter("rank <= 10")]


_INTERLEAVED = f"""WITH {DENSE_CTE}, {SPARSE_CTE}, b AS (SELECT query_id, vec_id, 0 AS branch, rank FROM fused WHERE rank <= 10
      UNION ALL SELECT query_id, vec_id, 1, rank FROM dense WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, 2, rank FROM sparse WHERE rank <= 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY rank, branch) AS k FROM b),
    woven AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, branch) AS INTEGER) AS pos FROM k WHERE k = 1)"""


@query("interleave_fallback", f"{_INTERLEAVED} SELECT query_id, vec_id, pos FROM woven WHERE pos <= 5")
def interleave_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.interleave(_branches(spark, sf_dir), "query_id", "vec_id", 5)


@query(
    "rerank_with_fallback",
    f"""{_INTERLEAVED}, c AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY branch, rank) AS pos,
          CASE WHEN query_id % 100 = 0 THEN NULL ELSE CAST((vec_id * 7919) % 1000 AS DOUBLE) / 100 END AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY branch, rank) AS first FROM b) WHERE first = 1),
    r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS INTEGER) AS pos FROM c WHERE score IS NOT NULL)
    SELECT query_id, vec_id, score, pos FROM r WHERE pos <= 5
    UNION ALL SELECT query_id, vec_id, NULL, pos FROM woven WHERE pos <= 5 AND query_id % 100 = 0""",
)
def rerank_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in scorer, which fails for some queries."""
    branches = _branches(spark, sf_dir)
    score = F.when(F.col("query_id") % 100 != 0, (F.col("vec_id") * 7919 % 1000).cast("double") / 100)
    united = fusion.union_dedupe(branches, "query_id", "vec_id")
    return fusion.rerank(united, "query_id", "vec_id", score, 5, fusion.interleave(branches, "query_id", "vec_id", 5))


@query(
    "fetch_fill_missing",
    f"""WITH {DENSE_CTE}, {SPARSE_CTE} SELECT query_id, f.vec_id, f.rank, label FROM fused f JOIN embeddings e USING (vec_id) WHERE f.rank <= 10 AND f.vec_id % 7 <> 0""",
)
def fetch_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits whose metadata is known for dense hits only, filled from a table that lacks every seventh vector."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    dense = keep(dense_hits(spark, sf_dir, 20))
    known = dense.filter("vec_id % 7 <> 0").select("query_id", "vec_id").join(table, "vec_id")
    candidates = fusion.rrf(dense, label_hits(spark, sf_dir, 20), "query_id", "vec_id").filter("rank <= 10").join(known, ["query_id", "vec_id"], "left")
    filled, _ = fusion.fill_missing(candidates.select("query_id", "vec_id", "rank", "label"), table.filter("vec_id % 7 <> 0"), "vec_id", ["label"])
    return filled


@query(
    "fetch_dropped",
    f"WITH {DENSE_CTE}, {SPARSE_CTE} SELECT query_id, vec_id FROM fused WHERE rank <= 10 AND vec_id % 7 = 0",
)
def fetch_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").filter("vec_id % 7 <> 0").select("vec_id", "label")
    candidates = fused_hits(spark, sf_dir).filter("rank <= 10").withColumn("label", F.lit(None).cast("int"))
    return fusion.fill_missing(candidates, table, "vec_id", ["label"])[1].select("query_id", "vec_id")


@query(
    "low_relevance_gate",
    f"WITH {DENSE_CTE} SELECT query_id, max(CASE WHEN vec_id % 3 = 0 THEN score * 20 - 10 END) AS best, coalesce(max(CASE WHEN vec_id % 3 = 0 THEN score * 20 - 10 END) < -6.8, false) AS low FROM dense WHERE rank BETWEEN 2 AND 6 GROUP BY query_id",
)
def low_relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = dense_hits(spark, sf_dir, 6).filter("rank >= 2").withColumn("s", F.when(F.col("vec_id") % 3 == 0, F.col("score") * 20 - 10))
    return hits.groupBy("query_id").agg(F.max("s").alias("best"), fusion.low_relevance(F.col("s")).alias("low"))


@query(
    "hybrid_topk",
    f"WITH {DENSE_CTE}, {SPARSE_CTE} SELECT query_id, f.vec_id, e.label, f.rrf_score, f.rank FROM fused f JOIN embeddings e USING (vec_id) WHERE f.rank <= 5",
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return fused_hits(spark, sf_dir).filter("rank <= 5").join(table, "vec_id").select("query_id", "vec_id", "label", "rrf_score", "rank")


@query(
    "mmr_select",
    f"""WITH RECURSIVE {DENSE_CTE}, {SPARSE_CTE},
    c AS (SELECT f.query_id, f.vec_id, f.rank, CAST(e.embedding AS DOUBLE[]) AS v, CAST(qv.vec AS DOUBLE[]) AS q FROM fused f JOIN embeddings e USING (vec_id) JOIN qv USING (query_id) WHERE f.rank <= 20),
    rel AS (SELECT query_id, vec_id, rank, list_cosine_similarity(v, q) AS rel FROM c),
    sim AS (SELECT a.query_id, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM c a JOIN c b USING (query_id)),
    picked(query_id, step, ids) AS (
      SELECT query_id, 0, CAST([] AS BIGINT[]) FROM qv
      UNION ALL
      SELECT query_id, step, ids FROM (
        SELECT p.query_id, p.step + 1 AS step, list_append(p.ids, r.vec_id) AS ids,
          row_number() OVER (PARTITION BY p.query_id ORDER BY round(0.5 * r.rel - 0.5 * coalesce((SELECT max(s.sim) FROM sim s WHERE s.query_id = p.query_id AND s.a = r.vec_id AND list_contains(p.ids, s.b)), 0), 9) DESC, r.rank) AS k
        FROM picked p JOIN rel r ON r.query_id = p.query_id AND NOT list_contains(p.ids, r.vec_id) WHERE p.step < 5) WHERE k = 1
    ), last AS (SELECT query_id, ids FROM picked WHERE step = 5)
    SELECT query_id, unnest(ids) AS vec_id, CAST(unnest(range(1, 6)) AS INTEGER) AS rank FROM last""",
)
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir).select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    asked = _query_vectors(spark, sf_dir).select("query_id", F.col("vec").cast("array<double>").alias("qvec"))
    pool = fused_hits(spark, sf_dir).filter("rank <= 20").select("query_id", "vec_id", F.col("rank").alias("pos"))
    return fusion.mmr(pool.join(vectors, "vec_id").join(asked, "query_id"), "query_id", "vec_id", 5)
