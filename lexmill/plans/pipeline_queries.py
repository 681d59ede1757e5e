"""Queries over composed plans: full retrieval, unit splitting, index records, streaming forms held against batch ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import bm25, chunking, citation, fusion, models, units
from lexmill.plans.chunking_queries import HEAD_CTE, clauses
from lexmill.operators.ranking import global_row_number
from lexmill.registry import query
from lexmill.sources import legal_view
from lexmill.sources.shared import keep, shared_folder
from lexmill.sources.tables import read
from lexmill.streaming import turns


def retrieve(
    chunks: DataFrame, questions: DataFrame, plugs: models.Plugs | None = None, use_mmr: bool = True, n: int = 5, index: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(query_id, chunk_id, source_document, breadcrumb, content, has_table, raw_table, score, pos): hybrid retrieval for
    many questions at once.

    chunks: chunk_id, source_document, breadcrumb, content, has_table, raw_table; questions: query_id, text, and
    hypothetical (null: that branch is left out). Chunks and questions carry structural terms. Each branch fuses dense and
    sparse hits and keeps ten, by diversity if wanted; the first sparse hits of a question that cites an article are a
    third branch. Branches are united in order and reranked, or woven where no score comes. index: postings (chunk_id,
    term, weight) and terms of a saved index; a hit that chunks don't have raises.
    """
    plugs = plugs or models.Plugs()
    # Chunks are numbered in the order of a digest of their ids: dense blocks and ties need a number, and two ids whose
    # digests agree are still two chunks.
    # What both branches read is written once, as an index would be; each step's plan stays short.
    fields = ["chunk_id", "source_document", "breadcrumb", "content", "has_table", "raw_table"]
    known = keep(global_row_number(chunks.select(*fields), [F.xxhash64("chunk_id"), "chunk_id"], "c").select("c", *fields))
    cited = questions.select(
        "query_id", "text", "hypothetical", citation.article_numbers(F.col("text")).alias("numbers"),
        citation.clause_numbers(F.col("text")).alias("parts"), citation.detect_document(F.col("text")).alias("named"),
    )
    questions = keep(cited.withColumns({"structural": citation.query_terms(F.col("numbers"), F.col("parts"), F.col("named")), "qvec": plugs.encoder(F.col("text"))}))
    if index is None:
        key = F.try_element_at(citation.document_keys(), F.col("source_document"))
        passage = plugs.segmenter(F.concat_ws(" ", "breadcrumb", "content"))
        found = bm25.index_of(bm25.terms(known, "c", passage, citation.document_terms(F.col("breadcrumb"), key)), "c")
        fitted, weights = keep(found[0]), found[1]  # weights are read off the documents' counts, which are written
    else:
        # A posting of a chunk that isn't known keeps its place below zero, so that its hit is found to have no metadata.
        numbers = index[0].join(known.select("chunk_id", "c"), "chunk_id", "left")
        fitted, weights = index[1], keep(numbers.select(F.coalesce("c", -F.abs(F.xxhash64("chunk_id")) - 1).alias("c"), "term", "weight"))
    vectors = keep(known.select("c", plugs.encoder(F.col("content")).alias("vec")))
    branches, none = [], F.array().cast("array<string>")
    for text in ("hypothetical", "text"):
        own = text == "text"
        vec = F.col("qvec") if own else plugs.encoder(F.col(text))
        asked = questions.filter(F.col(text).isNotNull()).select("query_id", F.col(text).alias("t"), F.col("structural") if own else none.alias("structural"), vec.alias("vec"))
        dense = fusion.dense_search_once(vectors, "c", asked.select("query_id", "vec"), "query_id", 20)
        qterms = bm25.query_weights(bm25.terms(asked, "query_id", plugs.segmenter(F.col("t")), F.col("structural")), "query_id", fitted)
        sparse = keep(bm25.search_shared(weights, "c", qterms, "query_id", 20))
        fused = keep(fusion.rrf(dense, sparse, "query_id", "c").filter("rank <= 20"))
        if use_mmr:
            pool = fused.select("query_id", "c", F.col("rank").alias("pos")).join(vectors, "c").join(questions.select("query_id", "qvec"), "query_id")
            branches.append(keep(fusion.mmr(pool, "query_id", "c", 10)))
        else:
            branches.append(fused.filter("rank <= 10").select("query_id", "c", "rank"))
    branches.append(citation.extras(sparse, questions, "query_id", "c"))  # of the question's own branch
    united = fusion.union_dedupe(branches, "query_id", "c")
    filled = united.join(known, "c", "left").withColumn(
        "chunk_id", F.when(F.col("chunk_id").isNull(), F.raise_error(F.concat(F.lit("no metadata of a hit: "), F.col("c").cast("string"))).cast("string")).otherwise(F.col("chunk_id"))
    )
    candidates = filled.join(questions.select("query_id", "text"), "query_id")
    scored = keep(candidates.withColumn("s", plugs.scorer(F.col("text"), F.concat_ws("\n", "breadcrumb", "content"))))
    best = fusion.rerank(scored.select("query_id", "c", "pos", "s"), "query_id", "c", F.col("s"), n, fusion.interleave(branches, "query_id", "c", n))
    return best.join(scored.select("query_id", "c", *fields), ["query_id", "c"]).select("query_id", *fields, F.round("score", 6).alias("score"), "pos")


def asked_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over the synthesised chunks: some cite an article and a clause, some name a document, half come with a
    hypothetical answer."""
    return read(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select(
        F.col("c_custkey").alias("query_id"),
        F.concat(
            "c_name", F.lit(" được hưởng bao nhiêu đồng"),
            F.when(F.col("c_custkey") % 150 == 0, F.concat(F.lit(" theo Điều "), F.col("c_custkey") % 97 + 1, F.lit(" khoản "), F.col("c_custkey") % 5 + 1)).otherwise(F.lit("")),
        ).alias("text"),
        F.when(F.col("c_custkey") % 100 == 0, F.concat("c_name", F.lit(" được hưởng mức lương theo quy định"))).alias("hypothetical"),
    )


def short_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(clauses(spark, sf_dir), 64).dropDuplicates(["chunk_id"])


@query("retrieve_hybrid")
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth customer's question over all synthesised chunks, with stand-in models. No SQL: hashed vectors; held
    against a brute-force version in tests."""
    return retrieve(short_chunks(spark, sf_dir), asked_of_chunks(spark, sf_dir)).select("query_id", "chunk_id", "score", "pos")


@query("unit_split")
def unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the legal documents, with small bounds; held against properties in tests."""
    return units.split_units(legal_view.texts(spark, sf_dir), "doc", 600, 3000)


@query(
    "unit_chapters",
    f"WITH t AS ({legal_view.TEXT_SQL}) SELECT doc, len(string_split_regex(text, '(^|\\n)## ')) AS n_chapters, length(text) AS n_chars FROM t",
)
def unit_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of each document, with the part before the first."""
    texts = legal_view.texts(spark, sf_dir)
    pieces = F.split("text", "(?m)(?=^## )")
    return texts.select("doc", F.size(pieces).cast("long").alias("n_chapters"), F.length("text").cast("long").alias("n_chars"))


@query("split_regions")
def split_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut by recursive separators to 50 words; held against properties in tests."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("prefix"), "text")
    return units.split_regions(docs, 50)


@query("index_records", f"WITH {HEAD_CTE} SELECT doc, CAST(clause AS BIGINT) AS clause, has_table, raw_table FROM clauses")
def index_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunks(clauses(spark, sf_dir), 1_000_000)
    return models.record(found).join(found.select("chunk_id", "doc", "clause"), "chunk_id").select("doc", "clause", "has_table", "raw_table")


@query(
    "embed_dimension",
    "SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS n_good FROM embeddings",
)
def embed_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") == models.DIMENSION).alias("n_good"))


@query(
    "kg_clusters",
    """WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem), p AS (SELECT b, count(*) AS n FROM e GROUP BY b) SELECT b AS entity, n AS n_nodes, n > 1 AS clustered FROM p""",
)
def kg_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a knowledge graph (edges part to supplier) that several nodes share."""
    edges = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("entity")).distinct()
    return edges.groupBy("entity").agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("clustered", F.col("n_nodes") > 1)


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # A file source watches a folder; the table is one file or a folder of files.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else f"{sf_dir}/{table}*")


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile())


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    return turns.run_to_table(stream, _checkpoint(spark))


@query(
    "stream_minute_limit",
    """SELECT CAST(user_id AS VARCHAR) AS user, date_trunc('minute', ts) AS start, count(*) AS n, greatest(count(*) - 1, 0) AS over FROM events GROUP BY 1, 2
    HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 MINUTE FROM events)""",
)
def stream_minute_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes that the watermark has closed, two minutes behind the newest event."""
    e = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = _run(spark, turns.minute_counts(e, "user_id", "ts", 1))
    return out.select("user", F.col("start").cast("timestamp_ntz").alias("start"), "n", "over")


@query(
    "stream_single_flight",
    """WITH RECURSIVE e AS (SELECT user_id % 20 AS k, event_id, epoch(date_trunc('second', ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS i FROM events),
    f(k, event_id, i, since, leads) AS (SELECT k, event_id, i, s, true FROM e WHERE i = 1
      UNION ALL SELECT e.k, e.event_id, e.i, CASE WHEN e.s - f.since >= 600 THEN e.s ELSE f.since END, e.s - f.since >= 600 FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1)
    SELECT k, event_id FROM f WHERE leads""",
)
def stream_single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaders of each key, whose locks expire after ten minutes."""
    e = _stream(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("k"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _run(spark, turns.leaders(e, "k", "ts", "event_id", 600))


@query(
    "stream_turn_fold",
    """WITH e AS (SELECT user_id AS turn, event_id AS seq, CASE event_type WHEN 'click' THEN 'token' WHEN 'view' THEN 'token' WHEN 'error' THEN 'error' ELSE 'done' END AS type, event_type || CAST(event_id % 7 AS VARCHAR) AS text FROM events)
    SELECT turn, coalesce(string_agg(text, '' ORDER BY seq) FILTER (type = 'token'), '') AS text, count(*) AS n_events, true AS done FROM e GROUP BY turn HAVING bool_or(type = 'done')""",
)
def stream_turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").selectExpr(
        "user_id AS turn", "event_id AS seq", "CAST(ts AS TIMESTAMP) AS ts",
        "CASE event_type WHEN 'click' THEN 'token' WHEN 'view' THEN 'token' WHEN 'error' THEN 'error' ELSE 'done' END AS type", "concat(event_type, event_id % 7) AS text",
    )
    return _run(spark, turns.fold_turns(e, "turn"))


@query(
    "stream_answer_cache",
    """WITH e AS (SELECT event_id, user_id % 50 AS k, ts, epoch(date_trunc('second', ts))::BIGINT AS s, CASE WHEN event_id % 3 = 0 THEN 'v' || event_id END AS value FROM events),
    p AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN ts END) OVER w AS stored_at, arg_max(value, CASE WHEN value IS NOT NULL THEN ts END) OVER w AS held FROM e WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT k, count(*) AS n, count(CASE WHEN epoch(ts) - epoch(stored_at) < 86400 THEN held END) AS n_hits FROM p WHERE value IS NULL GROUP BY k""",
)
def stream_answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").selectExpr("user_id % 50 AS k", "CAST(ts AS TIMESTAMP) AS ts", "IF(event_id % 3 = 0, concat('v', event_id), NULL) AS value")
    return _run(spark, turns.cached_answers(e, "k", "ts", 86400)).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_hits"))
