"""Queries of stages: prompts, pending cases, marks, embedding in two phases, faithfulness, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import stages
from lexmill.registry import query
from lexmill.sources import snapshots
from lexmill.sources.shared import shared_folder
from lexmill.sources.tables import read

SYSTEM = "Chỉ trả lời theo ngữ cảnh."


@query(
    "prompt_messages",
    f"""SELECT item_id, '{SYSTEM}' AS system, 'Ngữ cảnh:' || chr(10) || '[1] B' || CAST(item_id AS VARCHAR) || chr(10) || text || chr(10) || chr(10) || 'Câu hỏi: ' || text AS user FROM benchmark""",
)
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System and user message of each item, with the item as its own context."""
    context = F.concat(F.lit("[1] B"), F.col("item_id").cast("string"), F.lit("\n"), "text")
    found = stages.messages(SYSTEM, context, F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", found.alias("m")).select("item_id", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"))


@query(
    "prompt_repair",
    """WITH i AS (SELECT l_orderkey AS a, string_agg('{"code":"c' || CAST(l_linenumber AS VARCHAR) || '","quote":"' || l_linestatus || '"}', chr(10) ORDER BY l_linenumber, l_linestatus) AS issues FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS a, 'Ngữ cảnh:' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'Câu hỏi: ' || o_orderstatus || chr(10) || chr(10) || 'Bản nháp:' || chr(10) || CAST(o_custkey AS VARCHAR) || chr(10) || chr(10) || 'Lỗi cần sửa:' || chr(10) || issues AS user
    FROM orders JOIN i ON a = o_orderkey""",
)
def prompt_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user message of a repair: context, question, draft, and each issue as a line of JSON."""
    issue = F.struct(F.concat(F.lit("c"), "l_linenumber").alias("code"), F.col("l_linestatus").alias("quote"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", issue.alias("i")))).alias("found"))
    issues = F.transform("found", lambda x: x["i"])
    joined = read(spark, sf_dir, "orders").join(lines, F.col("a") == F.col("o_orderkey"))
    made = stages.repair_messages(SYSTEM, F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string"), issues)
    return joined.select("a", made[1]["content"].alias("user"))


@query(
    "stage_pending",
    """WITH log AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 3 AND l_returnflag <> 'R') SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT k FROM log)""",
)
def stage_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are cases; their third line is a record, an error where it was returned. Errors are tried again."""
    log = read(spark, sf_dir, "lineitem").filter("l_linenumber = 3").selectExpr("l_orderkey AS k", "IF(l_returnflag = 'R', 'failed', NULL) AS error")
    return stages.to_do(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), log, ["k"], retry_failed=True)


@query(
    "retrieval_marks",
    """WITH h AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_discount = 0) AS unscored FROM lineitem WHERE l_tax > 0.02 GROUP BY 1)
    SELECT o_orderkey AS k, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no_context' WHEN unscored THEN 'rerank_fallback' END AS error FROM orders LEFT JOIN h ON k = o_orderkey""",
)
def retrieval_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are cases; their lines with a tax are hits, without a score where there is no discount."""
    hits = read(spark, sf_dir, "lineitem").filter("l_tax > 0.02").selectExpr("l_orderkey AS k", "IF(l_discount = 0, NULL, CAST(l_discount AS DOUBLE)) AS score")
    return stages.retrieval_marks(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), hits, "k")


@query(
    "faithfulness_mean",
    "SELECT l_orderkey AS a, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS faithfulness FROM lineitem GROUP BY l_orderkey",
)
def faithfulness_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are statements, open ones supported."""
    verdicts = F.collect_list((F.col("l_linestatus") == "O").cast("int"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(verdicts.alias("v")).select("a", F.round(stages.faithfulness(F.col("v")), 6).alias("faithfulness"))


@query(
    "embed_phases",
    "SELECT count(*) AS total, count(*) FILTER (vec_id % 97 <> 0) AS embedded, count(*) FILTER (vec_id % 97 = 0) AS skipped, list(vec_id ORDER BY vec_id) FILTER (vec_id % 97 = 0) AS skipped_ids, count(*) FILTER (vec_id % 97 <> 0) AS indexed FROM embeddings",
)
def embed_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both phases over all vectors, some of which have failed: the summary, and how many the refreshed index holds."""
    made = read(spark, sf_dir, "embeddings").selectExpr("vec_id", "concat('label', label % 5) AS source", "IF(vec_id % 97 = 0, NULL, CAST(embedding AS ARRAY<DOUBLE>)) AS vec")
    folder = f"{shared_folder(spark).rstrip('/')}/embed-{uuid.uuid4().hex}"
    stages.checkpoint_embeddings(made, f"{folder}/checkpoints", "source")
    n = stages.refresh_snapshot(spark, f"{folder}/checkpoints", f"{folder}/index")
    return stages.embed_summary(made, "vec_id").withColumn("indexed", F.lit(n).cast("long"))


@query(
    "snapshot_index",
    """SELECT 1 AS number, 'documents' AS name, count(*) FILTER (doc_id % 2 = 0) AS n FROM documents UNION ALL SELECT 2, 'documents', count(*) FROM documents
    UNION ALL SELECT 1, 'labels', count(*) FROM labels UNION ALL SELECT 2, 'labels', count(*) FROM labels UNION ALL SELECT 2, 'counts', 1""",
)
def snapshot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table in two snapshots: the first of some documents, the second of all, with the labels carried over."""
    folder = f"{shared_folder(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    first = snapshots.commit(spark, folder, {"documents": docs.filter("doc_id % 2 = 0"), "labels": labels})
    second = snapshots.commit(spark, folder, {"documents": docs, "counts": docs.agg(F.count(F.lit(1)).alias("n"))}, base=first)
    found = [(s, name) for s in (first, second) for name in s.tables]
    rows = [s.read(spark, name).agg(F.lit(s.number).alias("number"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for s, name in found]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
