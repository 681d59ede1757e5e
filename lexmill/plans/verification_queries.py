"""Queries of citations and answer checks, over the legal view and answers made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import bm25, citation, turn_order, verification
from lexmill.plans.chunking_queries import HEAD_CTE, clauses
from lexmill.plans.retrieval_queries import BM25_CTE, sparse_hits
from lexmill.registry import query
from lexmill.sources.tables import read, read_dealt

# Questions: an order asks for articles by its keys, in forms that cite and forms that don't.
Q_CTE = """
qs AS (SELECT o_orderkey AS q, CASE o_orderkey % 8 WHEN 0 THEN 'Điều ' || o_custkey % 500 || ' khoản ' || o_orderkey % 9 || ' quy định gì' WHEN 1 THEN 'theo điều ' || o_custkey % 100 || ', ' || (o_custkey % 100 + 1) || ' và ' || (o_custkey % 100 + 2) || ' luật lao động'
  WHEN 2 THEN 'điều kiện hưởng trong ' || o_custkey % 12 || ' tháng' WHEN 3 THEN 'điều ' || o_custkey % 90 || ' tháng' WHEN 4 THEN 'Điều thứ ' || o_custkey % 30 || ' đến Điều ' || (o_custkey % 30 + 5) || ' khoản 1, khoản 2, khoản 1, khoản 3, khoản 4'
  WHEN 5 THEN 'chiều ' || o_custkey || ' và khoản 5' WHEN 6 THEN 'điều 3 và 5 ngày theo Nghị định hướng dẫn Bộ luật Lao động' ELSE 'Luật BHXH và luật bhyt điều36.2' END AS text FROM orders),
qn AS (SELECT *, CAST(CASE q % 8 WHEN 0 THEN [CAST(regexp_extract(text, 'Điều (\\d+)', 1) AS INTEGER)] WHEN 1 THEN [CAST(x AS INTEGER) FOR x IN regexp_extract_all(text, '(\\d+)', 1)] WHEN 4 THEN [CAST(x AS INTEGER) FOR x IN regexp_extract_all(text, '(?:thứ|Điều) (\\d+)', 1)]
  WHEN 6 THEN [3] WHEN 7 THEN [36] ELSE [] END AS INTEGER[]) AS numbers, CAST(CASE q % 8 WHEN 0 THEN [CAST(regexp_extract(text, 'khoản (\\d+)', 1) AS INTEGER)] WHEN 4 THEN [1, 2, 3] WHEN 5 THEN [5] ELSE [] END AS INTEGER[]) AS clauses,
  CASE q % 8 WHEN 1 THEN 'blld' WHEN 6 THEN 'nd_dkld' END AS doc FROM qs)
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey").selectExpr(
        "o_orderkey AS q",
        """CASE o_orderkey % 8 WHEN 0 THEN concat('Điều ', o_custkey % 500, ' khoản ', o_orderkey % 9, ' quy định gì')
        WHEN 1 THEN concat('theo điều ', o_custkey % 100, ', ', o_custkey % 100 + 1, ' và ', o_custkey % 100 + 2, ' luật lao động')
        WHEN 2 THEN concat('điều kiện hưởng trong ', o_custkey % 12, ' tháng') WHEN 3 THEN concat('điều ', o_custkey % 90, ' tháng')
        WHEN 4 THEN concat('Điều thứ ', o_custkey % 30, ' đến Điều ', o_custkey % 30 + 5, ' khoản 1, khoản 2, khoản 1, khoản 3, khoản 4')
        WHEN 5 THEN concat('chiều ', o_custkey, ' và khoản 5') WHEN 6 THEN 'điều 3 và 5 ngày theo Nghị định hướng dẫn Bộ luật Lao động'
        ELSE 'Luật BHXH và luật bhyt điều36.2' END AS text""",
    )


def _joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("citation_numbers", f"WITH {Q_CTE} SELECT q, array_to_string(numbers, ',') AS numbers FROM qn")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("q", _joined(citation.article_numbers(F.col("text"))).alias("numbers"))


@query("citation_clauses", f"WITH {Q_CTE} SELECT q, array_to_string(clauses, ',') AS clauses FROM qn")
def citation_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("q", _joined(citation.clause_numbers(F.col("text"))).alias("clauses"))


@query("detect_document", f"WITH {Q_CTE} SELECT q, doc FROM qn")
def detect_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("q", citation.detect_document(F.col("text")).alias("doc"))


@query(
    "structural_terms_query",
    f"""WITH {Q_CTE}, t AS (SELECT q, doc, [('điều_' || x) FOR x IN numbers] AS d, [('khoản_' || x) FOR x IN clauses] AS k, numbers, clauses FROM qn),
    p AS (SELECT *, flatten([[(x || '_' || y) FOR y IN k] FOR x IN d]) AS dk FROM t)
    SELECT q, CASE WHEN len(numbers) = 0 THEN '' WHEN doc IS NULL THEN array_to_string(d || k || dk, ' ') ELSE array_to_string(d || k || dk || ['vb_' || doc] || [('vb_' || doc || '_' || x) FOR x IN d || dk], ' ') END AS terms FROM p""",
)
def structural_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).select(
        "q", citation.article_numbers(F.col("text")).alias("a"), citation.clause_numbers(F.col("text")).alias("c"), citation.detect_document(F.col("text")).alias("d")
    )
    return q.select("q", F.array_join(citation.query_terms(F.col("a"), F.col("c"), F.col("d")), " ").alias("terms"))


_CRUMB = f"""{HEAD_CTE}, bc AS (SELECT doc, CAST(clause AS BIGINT) AS clause, breadcrumb || coalesce(' - Khoản ' || khoan_number, '') || CASE WHEN clause % 3 = 0 THEN ' (phần 1/2)' ELSE '' END AS b FROM clauses),
ref AS (SELECT *, CAST(nullif(regexp_extract(b, ' - Điều (\\d+)\\.', 1), '') AS INTEGER) AS dieu, CAST(nullif(regexp_extract(b, ' - Khoản (\\d+)(?: \\(phần 1/2\\))?$', 1), '') AS INTEGER) AS khoan FROM bc)"""


def crumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.concat("breadcrumb", F.coalesce(F.concat(F.lit(" - Khoản "), "khoan_number"), F.lit("")), F.when(F.col("clause") % 3 == 0, " (phần 1/2)").otherwise(""))
    return clauses(spark, sf_dir).select("doc", "clause", b.alias("b"))


@query("parse_breadcrumb", f"WITH {_CRUMB} SELECT doc, clause, dieu, khoan FROM ref")
def parse_breadcrumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crumbs(spark, sf_dir).select("doc", "clause", citation.breadcrumb_numbers(F.col("b")).alias("r")).select("doc", "clause", "r.*")


@query(
    "structural_terms_doc",
    f"""WITH {_CRUMB}, k AS (SELECT *, CASE WHEN doc % 2 = 0 THEN 'n' || doc END AS key, 'điều_' || dieu AS d, 'khoản_' || khoan AS k FROM ref)
    SELECT doc, clause, concat_ws(' ', d, k, d || '_' || k, 'vb_' || key, 'vb_' || key || '_' || d, 'vb_' || key || '_' || d || '_' || k) AS terms FROM k""",
)
def structural_terms_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("n"), "doc"))
    return crumbs(spark, sf_dir).select("doc", "clause", F.array_join(citation.document_terms(F.col("b"), key), " ").alias("terms"))


@query("unknown_documents", f"WITH {HEAD_CTE} SELECT DISTINCT source_document FROM clauses")
def unknown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of the synthesised documents: none is among the known ones."""
    return citation.unknown_documents(clauses(spark, sf_dir), citation.dimension(spark))


@query("citation_extras", f"WITH {BM25_CTE} SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 10 AND item_id % 3 = 0")
def citation_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sparse hits of the items that cite (here: every third)."""
    items = read(spark, sf_dir, "benchmark").select("item_id", citation.article_numbers(F.when(F.col("item_id") % 3 == 0, "theo Điều 5").otherwise(F.lit("không"))).alias("numbers"))
    return citation.extras(sparse_hits(spark, sf_dir, 20), items, "item_id", "doc_id")


@query(
    "fold_text",
    "SELECT n_nationkey, 'dieu kien huong luong ' || lower(n_name) || ' da nang uu dai y te' AS folded FROM nation",
)
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmill.functions.text import fold

    text = F.concat(F.lit("  Điều kiện  HƯỞNG lương "), "n_name", F.lit(" Đà Nẵng ưu đãi ý tế"))
    return read(spark, sf_dir, "nation").select("n_nationkey", fold(text).alias("folded"))


# Answers: an order's lines are its context, ranked by line number; the text cites and counts.
A_CTE = """
ctx AS (SELECT l_orderkey AS a, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank, 'c' || l_partkey AS chunk_id, 'Điều ' || l_suppkey % 50 || '. Mức' AS breadcrumb, 'Mức hưởng ' || l_partkey || ' đồng, ' || CAST(l_quantity AS INTEGER) || '%' AS content FROM lineitem),
c5 AS (SELECT * FROM ctx WHERE rank <= 5),
nc AS (SELECT a, count(*) AS n FROM c5 GROUP BY a),
ans AS (SELECT o_orderkey AS a, o_custkey AS x, o_orderkey % 6 + 1 AS y, 'Mức là ' || o_custkey || ' đồng [1]. Xem 1.234.567 đồng' || '【' || o_orderkey % 6 + 1 || '】 và [1], số ' || o_orderkey || '.' AS text FROM orders)
"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = read(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    return rows.selectExpr(
        "l_orderkey AS a", "rank", "concat('c', l_partkey) AS chunk_id", "concat('Điều ', l_suppkey % 50, '. Mức') AS breadcrumb",
        "concat('Mức hưởng ', l_partkey, ' đồng, ', CAST(l_quantity AS INT), '%') AS content",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey").selectExpr(
        "o_orderkey AS a",
        "concat('Mức là ', o_custkey, ' đồng [1]. Xem 1.234.567 đồng【', o_orderkey % 6 + 1, '】 và [1], số ', o_orderkey, '.') AS text",
    )


@query(
    "citations_valid_invalid",
    f"""WITH {A_CTE}, n AS (SELECT a, 0 AS pos, 1 AS n FROM ans UNION ALL SELECT a, 1, CAST(y AS INTEGER) FROM ans WHERE y <> 1)
    SELECT n.a, n.pos, n.n, chunk_id, chunk_id IS NOT NULL AS valid FROM n LEFT JOIN c5 ON c5.a = n.a AND c5.rank = n.n""",
)
def citations_valid_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.citations(answers(spark, sf_dir), contexts(spark, sf_dir), "a").select("a", "pos", "n", "chunk_id", "valid")


_LOOSE = f"""{A_CTE}, ev AS (SELECT a, list_concat(list(regexp_extract(breadcrumb, '\\d+')), list(regexp_extract(content, '\\d+')), list(regexp_extract(content, '(\\d+)%', 1))) AS known FROM c5 GROUP BY a),
cand AS (SELECT a, 1 AS k, CAST(x AS VARCHAR) AS value, true AS sensitive FROM ans UNION ALL SELECT a, 2, '1.234.567', true FROM ans UNION ALL SELECT a, 3, CAST(a AS VARCHAR), false FROM ans WHERE a >= 10 AND a <> x),
loose AS (SELECT cand.* FROM cand LEFT JOIN ev USING (a) WHERE NOT coalesce(list_contains(known, replace(value, '.', '')), false))"""


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, text, ranks of its context (null: none) and loose: each answer meets its context once, in one row."""
    evidence = contexts(spark, sf_dir).groupBy("a").agg(F.flatten(F.collect_list(F.array("breadcrumb", "content"))).alias("evidence"), F.collect_list("rank").alias("ranks"))
    return answers(spark, sf_dir).join(evidence, "a", "left").select("a", "text", "ranks", verification.unverified(F.col("text"), F.col("evidence")).alias("loose"))


@query("unverified_numbers", f"WITH {_LOOSE} SELECT a, value, sensitive FROM loose")
def unverified_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose(spark, sf_dir).select("a", F.explode_outer("loose").alias("x")).select("a", "x.*").filter("value IS NOT NULL")


@query(
    "hard_gate",
    f"""WITH {_LOOSE}, s AS (SELECT a, bool_or(sensitive) AS bad FROM loose GROUP BY a)
    SELECT a, concat_ws(',', CASE WHEN a % 10 = 0 THEN 'truncated' END, CASE WHEN y > coalesce(n, 0) OR n IS NULL THEN 'invalid_citation' END, CASE WHEN bad THEN 'unverified_sensitive_number' END) AS issues FROM ans LEFT JOIN nc USING (a) LEFT JOIN s USING (a)""",
)
def hard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    finish = F.when(F.col("a") % 10 == 0, "length").otherwise("stop")
    invalid = verification.n_invalid(F.col("text"), F.col("ranks"))
    return _loose(spark, sf_dir).select("a", F.array_join(verification.hard_issues(finish, invalid, F.col("loose")), ",").alias("issues"))


@query(
    "judge_policy",
    """WITH j AS (SELECT o_orderkey AS a, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'repair' WHEN 2 THEN 'insufficient_evidence' ELSE 'other' END AS verdict, o_orderkey % 3 AS n, CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE 2 END AS e FROM orders)
    SELECT a, CASE verdict WHEN 'pass' THEN n = 0 WHEN 'other' THEN false ELSE n > 0 END AND NOT (n > 0 AND e > 5) AS consistent FROM j""",
)
def judge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS a", "CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'repair' WHEN 2 THEN 'insufficient_evidence' ELSE 'other' END AS verdict",
        "o_orderkey % 3 AS n", "IF(o_orderkey % 3 > 0, array(IF(o_orderkey % 7 = 0, 9, 2)), array()) AS e",
    )
    return rows.select("a", verification.judge_consistent(F.col("verdict"), F.col("n"), F.col("e").cast("array<int>"), F.lit(5)).alias("consistent"))


@query(
    "verification_outcome",
    """WITH s AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS g0, CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'repair' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN 'pass' END AS j0,
      CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 4 = 0 END AS g1, CASE o_custkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'repair' WHEN 2 THEN 'insufficient_evidence' END AS j1 FROM orders),
    r AS (SELECT *, CASE WHEN g0 IS NULL THEN 'error' WHEN g0 THEN 'retry' WHEN j0 IS NULL THEN 'unable_to_verify' WHEN j0 = 'pass' THEN 'answered' WHEN j0 = 'repair' THEN 'retry' ELSE j0 END AS first,
      CASE WHEN g1 IS NULL THEN 'error' WHEN g1 OR j1 IS NULL OR j1 = 'repair' THEN 'unable_to_verify' WHEN j1 = 'pass' THEN 'answered' ELSE j1 END AS second FROM s)
    SELECT a, CASE WHEN first = 'retry' THEN second ELSE first END AS outcome FROM r""",
)
def verification_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS a", "IF(o_orderkey % 11 = 0, NULL, o_orderkey % 3 = 0) AS g0",
        "CASE o_orderkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'repair' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN 'pass' END AS j0",
        "IF(o_orderkey % 13 = 0, NULL, o_orderkey % 4 = 0) AS g1",
        "CASE o_custkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'repair' WHEN 2 THEN 'insufficient_evidence' END AS j1",
    )
    return rows.select("a", verification.outcome(F.col("g0"), F.col("j0"), F.col("g1"), F.col("j1")).alias("outcome"))


@query(
    "usage_merge",
    "SELECT l_orderkey AS a, sum(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END)::BIGINT AS tokens FROM lineitem GROUP BY l_orderkey",
)
def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of all calls of an answer; unknown parts count as nothing, all unknown stays unknown."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("a")).agg(F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("long"))).alias("tokens"))


@query(
    "guardrail_scope",
    """WITH q AS (SELECT o_orderkey AS a, CASE o_orderkey % 6 WHEN 0 THEN 'Xin chào!' WHEN 1 THEN 'dịch câu này' WHEN 2 THEN 'dịch câu này là gì' WHEN 3 THEN 'Hãy dịch đoạn văn ?' WHEN 4 THEN 'lương tối thiểu' ELSE 'kể chuyện vui.' END AS text, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'unsafe' ELSE 'out_of_scope' END AS verdict FROM orders)
    SELECT a, CASE WHEN verdict IS NULL THEN 'allow' WHEN verdict = 'out_of_scope' AND a % 6 IN (2, 4) THEN 'allow' ELSE verdict END AS verdict FROM q""",
)
def guardrail_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS a",
        "CASE o_orderkey % 6 WHEN 0 THEN 'Xin chào!' WHEN 1 THEN 'dịch câu này' WHEN 2 THEN 'dịch câu này là gì' WHEN 3 THEN 'Hãy dịch đoạn văn ?' WHEN 4 THEN 'lương tối thiểu' ELSE 'kể chuyện vui.' END AS text",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'unsafe' ELSE 'out_of_scope' END AS verdict",
    )
    return rows.select("a", verification.scope(F.col("verdict"), F.col("text")).alias("verdict"))


@query(
    "context_order",
    f"""WITH {A_CTE} SELECT a, string_agg('[' || rank || '] ' || breadcrumb || chr(10) || content, chr(10) || chr(10) ORDER BY CASE WHEN n = 5 THEN [1, 2, 4, 5, 3][rank] ELSE rank END) AS context FROM c5 JOIN nc USING (a) GROUP BY a""",
)
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.context_text(contexts(spark, sf_dir).withColumn("raw_table", F.lit(None).cast("string")), "a")


@query("strip_valid_citations", f"WITH {A_CTE} SELECT a, replace(text, '[1]', '') AS text FROM ans")
def strip_valid_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("a", verification.strip_valid(F.col("text"), F.array(F.lit(1))).alias("text"))


@query(
    "fragment_normalize",
    """SELECT conv_id, turn, CASE WHEN lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN '[1]' ELSE ' [1]' END || ' a [2][3]x' AS text FROM (SELECT DISTINCT conv_id, turn FROM conversations)""",
)
def fragment_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq")).distinct()
    rows = turns.withColumn("text", F.lit("【1】 a[2][3]x"))
    return verification.normalize_fragments(rows, "conv_id").select("conv_id", F.col("seq").alias("turn"), "text")


@query(
    "answer_flow",
    f"""WITH {A_CTE} SELECT o_orderkey AS a, CASE WHEN o_orderkey % 9 = 0 THEN 'refused' WHEN n IS NULL THEN 'no_context' WHEN o_orderkey % 10 = 0 THEN 'retrieval_error' ELSE 'generate' END AS step FROM orders LEFT JOIN nc ON a = o_orderkey""",
)
def answer_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a stand-alone answer stops: refused at the door, no context, failed retrieval, or goes on."""
    n = contexts(spark, sf_dir).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a")).join(n, "a", "left")
    verdict = F.when(F.col("a") % 9 == 0, "unsafe").when(F.col("a") % 7 == 0, "out_of_scope")
    failed = F.col("n").isNotNull() & (F.col("a") % 10 == 0)
    step = turn_order.stand_alone(verdict, F.lit("lương tối thiểu"), failed, F.col("n"), F.lit(None).cast("double"))
    return rows.select("a", step.alias("step"))


@query(
    "rate_limit_chain",
    "SELECT o_orderkey AS a, o_orderkey % 3 = 0 AS limited, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN CAST(o_custkey % 60 AS DOUBLE) END AS retry_after FROM orders",
)
def rate_limit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = F.expr("array(struct(500 AS status, CAST(NULL AS DOUBLE) AS retry_after), struct(IF(o_orderkey % 3 = 0, 429, 503) AS status, IF(o_orderkey % 2 = 0, CAST(o_custkey % 60 AS DOUBLE), NULL) AS retry_after))")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), verification.rate_limited(chain).alias("r")).select("a", "r.*")
