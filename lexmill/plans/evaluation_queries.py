"""Queries of evaluation: records synthesised from orders, their reports, and the planning of test sets.

A case is an order; its configuration is mmr_on or mmr_off, its outcome follows the status, its score the price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import planning, ranking, reporting
from lexmill.registry import query
from lexmill.sources.tables import read

LOG_CTE = """
cfg AS (SELECT * FROM (VALUES ('mmr_on', 0), ('mmr_off', 1)) AS t(config, c)),
log AS (
  SELECT o_orderkey AS case_id, config, o_orderkey * 4 + c * 2 + r AS seq,
    CASE WHEN o_orderkey % 13 = 0 THEN CAST('nan' AS DOUBLE) WHEN o_orderkey % 29 = c THEN NULL ELSE ((o_orderkey * 37 + c * 11 * (o_orderkey % 3) + r) % 100) / 100e0 END AS score,
    CASE WHEN o_orderkey % 17 = c AND r = 1 THEN 'timeout' END AS error,
    CASE o_orderstatus WHEN 'O' THEN 'answered' WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'answered' ELSE 'insufficient_evidence' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'unable_to_verify' END END AS outcome,
    o_orderkey % 8 = 0 AS repair_used,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS synthesizer_name, o_orderstatus AS source_document,
    'p' || CAST(o_orderkey % 3 AS VARCHAR) AS prompt_version,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 7 AS VARCHAR) || ',' || CAST(o_orderkey % 11 AS VARCHAR) ELSE CAST(o_orderkey % 7 + c AS VARCHAR) || ',' || CAST(o_orderkey % 11 AS VARCHAR) END AS context
  FROM orders, cfg, (SELECT unnest([0, 1]) AS r) WHERE r = 0 OR o_orderkey % 4 = 0
),
latest AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY case_id, config ORDER BY seq DESC) AS k FROM log) WHERE k = 1),
fin AS (SELECT *, CASE WHEN NOT isnan(score) AND NOT isinf(score) THEN score END AS value FROM latest)
"""


def score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cfg = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.lit(k).alias("c")) for k, n in enumerate(("mmr_on", "mmr_off"))]))
    runs = F.explode(F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = o.select("*", cfg.alias("cfg")).select("*", "cfg.*", runs.alias("r"))
    return rows.selectExpr(
        "o_orderkey AS case_id",
        "config",
        "o_orderkey * 4 + c * 2 + r AS seq",
        "CASE WHEN o_orderkey % 13 = 0 THEN double('NaN') WHEN o_orderkey % 29 = c THEN NULL ELSE ((o_orderkey * 37 + c * 11 * (o_orderkey % 3) + r) % 100) / 100D END AS score",
        "CASE WHEN o_orderkey % 17 = c AND r = 1 THEN 'timeout' END AS error",
        "CASE o_orderstatus WHEN 'O' THEN 'answered' WHEN 'F' THEN IF(o_orderkey % 2 = 0, 'answered', 'insufficient_evidence') ELSE IF(o_orderkey % 3 = 0, 'error', 'unable_to_verify') END AS outcome",
        "o_orderkey % 8 = 0 AS repair_used",
        "IF(o_orderkey % 5 = 0, NULL, o_orderpriority) AS synthesizer_name",
        "o_orderstatus AS source_document",
        "concat('p', o_orderkey % 3) AS prompt_version",
        "concat_ws(',', o_orderkey % 7 + IF(o_orderkey % 3 = 0, 0, c), o_orderkey % 11) AS context",
    )


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.last_wins(score_log(spark, sf_dir), ["case_id", "config"], "seq")


_SCORE = "CASE WHEN isnan(score) THEN NULL ELSE score END AS score"


@query("jsonl_last_wins", f"WITH {LOG_CTE} SELECT case_id, config, seq, {_SCORE}, error, outcome FROM latest")
def jsonl_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("case_id", "config", "seq", reporting.finite(F.col("score")).alias("score"), "error", "outcome")


@query("nonfinite_to_null", f"WITH {LOG_CTE} SELECT case_id, config, value AS score, CASE WHEN error IS NOT NULL THEN error WHEN score IS NOT NULL AND value IS NULL THEN 'non_finite_score' END AS error FROM fin")
def nonfinite_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select(
        "case_id", "config", reporting.finite(F.col("score")).alias("score"), reporting.score_error(F.col("score"), F.col("error")).alias("error")
    )


_SLICES = """SELECT config, CASE WHEN GROUPING(synth) = 0 THEN 'synthesizer_name' WHEN GROUPING(src) = 0 THEN 'source_document' ELSE 'overall' END AS dimension,
  CASE WHEN GROUPING(synth) = 0 THEN synth WHEN GROUPING(src) = 0 THEN src ELSE 'all' END AS value,
  round(avg(value), 6) AS mean, count(value) AS n, count(*) FILTER (value IS NULL) AS n_null
FROM (SELECT config, value, coalesce(synthesizer_name, 'unknown') AS synth, coalesce(source_document, 'unknown') AS src FROM fin)
GROUP BY GROUPING SETS ((config, synth), (config, src), (config))"""


@query("report_slices", f"WITH {LOG_CTE} {_SLICES}")
def report_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest(spark, sf_dir)
    parts = [
        reporting.slices(found.filter(F.col("config") == c), ["synthesizer_name", "source_document"], *reporting.mean_columns("score")).withColumn("config", F.lit(c))
        for c in ("mmr_on", "mmr_off")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "report_paired",
    f"""WITH {LOG_CTE}, b AS (SELECT a.value AS a, b.value AS b, a.error IS NULL AND b.error IS NULL AND a.value IS NOT NULL AND b.value IS NOT NULL AS good, a.context = b.context AS same
      FROM (SELECT * FROM fin WHERE config = 'mmr_on') a FULL JOIN (SELECT * FROM fin WHERE config = 'mmr_off') b USING (case_id))
    SELECT count(*) FILTER (good) AS paired, count(*) FILTER (NOT coalesce(good, false)) AS excluded, round(avg(a) FILTER (good), 6) AS mean_left, round(avg(b) FILTER (good), 6) AS mean_right,
      count(*) FILTER (good AND a > b) AS wins, count(*) FILTER (good AND a < b) AS losses, count(*) FILTER (good AND a = b) AS ties, count(*) FILTER (good AND same) AS identical FROM b""",
)
def report_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest(spark, sf_dir)
    return reporting.paired(found.filter("config = 'mmr_on'"), found.filter("config = 'mmr_off'"), "case_id")


@query(
    "report_answer_group",
    f"""WITH {LOG_CTE}, e AS (SELECT *, outcome IN ('insufficient_evidence', 'unable_to_verify') AS refused FROM fin)
    SELECT config, count(*) AS n_cases, count(*) FILTER (outcome = 'answered') AS n_answered, count(*) FILTER (outcome = 'insufficient_evidence') AS n_insufficient_evidence,
      count(*) FILTER (outcome = 'unable_to_verify') AS n_unable_to_verify, count(*) FILTER (outcome = 'error') AS n_error,
      round(count(*) FILTER (refused) / count(*), 6) AS refusal_rate, round(count(*) FILTER (repair_used) / count(*), 6) AS repair_rate,
      round(avg(value) FILTER (outcome = 'answered'), 6) AS mean_answered, count(*) FILTER (outcome = 'answered' AND value IS NULL) AS n_null,
      round(avg(CASE WHEN refused THEN 0 WHEN outcome = 'answered' THEN value END), 6) AS mean_end_to_end, count(CASE WHEN refused THEN 0 WHEN outcome = 'answered' THEN value END) AS n_end_to_end
    FROM e GROUP BY config""",
)
def report_answer_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.answer_group(latest(spark, sf_dir), ["config"])


@query(
    "report_operations",
    f"""WITH {LOG_CTE} SELECT config, count(*) FILTER (score IS NULL) AS n_null, count(*) FILTER (error IS NOT NULL) AS n_errors, count(*) FILTER (repair_used) AS n_repairs,
      array_to_string(list_sort(list_distinct(list(prompt_version))), ',') AS prompt_versions FROM latest GROUP BY config""",
)
def report_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).groupBy("config").agg(
        F.count_if(F.col("score").isNull()).alias("n_null"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.count_if("repair_used").alias("n_repairs"),
        F.array_join(F.sort_array(F.collect_set("prompt_version")), ",").alias("prompt_versions"),
    )


@query(
    "stage_summary",
    f"""WITH {LOG_CTE}, done AS (SELECT * FROM latest WHERE config = 'mmr_on' AND case_id % 6 <> 0), up AS (SELECT * FROM latest WHERE config = 'mmr_on' AND case_id % 12 <> 0)
    SELECT count(*) FILTER (d.case_id IS NOT NULL AND d.error IS NULL) AS done, count(*) FILTER (d.error IS NOT NULL) AS errors,
      count(*) FILTER (d.case_id IS NULL AND u.case_id IS NOT NULL) AS pending, count(*) FILTER (d.case_id IS NULL AND u.case_id IS NULL) AS missing_upstream
    FROM orders LEFT JOIN done d ON d.case_id = o_orderkey LEFT JOIN up u ON u.case_id = o_orderkey""",
)
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest(spark, sf_dir).filter("config = 'mmr_on'")
    cases = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    return reporting.stage_summary(cases, found.filter("case_id % 6 <> 0"), ["case_id"], found.filter("case_id % 12 <> 0"))


@query(
    "score_reuse",
    f"""WITH {LOG_CTE}, f AS (SELECT case_id, context, min(config) AS evaluate FROM latest GROUP BY case_id, context)
    SELECT case_id, config, CASE WHEN evaluate <> config THEN evaluate END AS reused_from FROM latest JOIN f USING (case_id, context)""",
)
def score_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.reusable_scores(latest(spark, sf_dir), "case_id", "config", "context")


@query(
    "score_jobs",
    f"""WITH {LOG_CTE}, r AS (SELECT * FROM latest WHERE config = 'mmr_off')
    SELECT o_orderkey AS case_id, CASE WHEN r.case_id IS NULL OR r.error IS NOT NULL THEN 'missing_upstream' WHEN outcome <> 'answered' THEN 'skipped' ELSE 'ready' END AS job
    FROM orders LEFT JOIN r ON r.case_id = o_orderkey AND r.case_id % 9 <> 0""",
)
def score_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoring would do with each case: answers that are missing or failed wait, refusals are skipped."""
    answers = latest(spark, sf_dir).filter("config = 'mmr_off' AND case_id % 9 <> 0").select("case_id", "error", "outcome", F.lit(1).alias("here"))
    job = F.when(F.col("here").isNull() | F.col("error").isNotNull(), "missing_upstream").when(F.col("outcome") != "answered", "skipped").otherwise("ready")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id")).join(answers, "case_id", "left").select("case_id", job.alias("job"))


@query(
    "context_precision_ap",
    """WITH v AS (SELECT l_orderkey AS case_id, l_linenumber AS k, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS v FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY k, v) AS pos, sum(v) OVER (PARTITION BY case_id ORDER BY k, v ROWS UNBOUNDED PRECEDING) AS hits FROM v)
    SELECT case_id, round(CASE WHEN sum(v) > 0 THEN sum(CASE WHEN v = 1 THEN hits / pos ELSE 0 END) / sum(v) ELSE 0 END, 6) AS precision FROM r GROUP BY case_id""",
)
def context_precision_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("v")))).alias("v")
    )
    return lines.select("case_id", F.round(reporting.average_precision(F.transform("v", lambda x: x["v"])), 6).alias("precision"))


@query(
    "context_recall_mean",
    """WITH r AS (SELECT l_orderkey AS case_id, avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS recall FROM lineitem GROUP BY l_orderkey)
    SELECT round(avg(recall), 6) AS mean, count(*) AS n FROM r""",
)
def context_recall_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of claims attributed per case, then the mean over cases."""
    recall = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg((F.col("l_linestatus") == "O").cast("int")).alias("recall"))
    return recall.agg(F.round(F.avg("recall"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    "answer_relevancy_mean",
    """WITH p AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3)
    SELECT vec_id, round(avg(c), 6) AS relevancy FROM p GROUP BY vec_id""",
)
def answer_relevancy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of a vector and those of the three questions made from its answer (here: the next three)."""
    from lexmill.operators.fusion import cosine

    table = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    made = table.select(F.explode(F.array(*[F.col("vec_id") - k for k in (1, 2, 3)])).alias("vec_id"), F.col("v").alias("made"))
    return table.join(made, "vec_id").groupBy("vec_id").agg(F.round(F.avg(cosine(F.col("v"), F.col("made"))), 6).alias("relevancy"))


@query(
    "retrieval_hit_at_k",
    """WITH g AS (SELECT o_orderkey AS case_id, o_custkey % 10 AS dieu, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 END AS khoan FROM orders),
    r AS (SELECT l_orderkey AS case_id, l_linenumber AS rank, l_partkey % 10 AS dieu, l_suppkey % 4 AS khoan FROM lineitem WHERE l_linenumber <= 5)
    SELECT case_id, EXISTS (SELECT 1 FROM r WHERE r.case_id = g.case_id AND r.dieu = g.dieu AND (g.khoan IS NULL OR r.khoan = g.khoan)) AS hit FROM g""",
)
def retrieval_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first five results hold the expected article, and clause where one is expected."""
    wanted = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS case_id", "o_custkey % 10 AS dieu", "IF(o_orderkey % 2 = 0, o_orderkey % 4, NULL) AS khoan")
    found = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 5").selectExpr("l_orderkey AS case_id", "l_partkey % 10 AS d", "l_suppkey % 4 AS k")
    hit = (F.col("d") == F.col("dieu")) & (F.col("khoan").isNull() | (F.col("k") == F.col("khoan")))
    return wanted.join(found, "case_id", "left").groupBy("case_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"))


@query(
    "synthesizer_counts",
    "SELECT CASE WHEN o_orderkey % 5 = 0 THEN '(missing)' ELSE o_orderpriority END AS synthesizer, count(*) AS n FROM orders GROUP BY 1",
)
def synthesizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("IF(o_orderkey % 5 = 0, NULL, o_orderpriority) AS synthesizer_name")
    counted = rows.groupBy(F.coalesce("synthesizer_name", F.lit("(missing)")).alias("synthesizer")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), "synthesizer")


@query(
    "metric_means",
    f"""WITH {LOG_CTE}, m AS (SELECT 'score' AS metric, value FROM fin UNION ALL SELECT 'repair', CASE WHEN repair_used THEN 1e0 END FROM fin)
    SELECT metric, round(avg(value), 6) AS mean, count(value) AS n FROM m GROUP BY metric""",
)
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = latest(spark, sf_dir).select(reporting.finite(F.col("score")).alias("score"), F.when(F.col("repair_used"), 1.0).alias("repair"))
    return wide.unpivot([], ["score", "repair"], "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


# Planning of test sets


@query(
    "largest_remainder",
    """WITH w AS (SELECT n_regionkey, n_nationkey, n_nationkey % 7 + 1 AS w, 100 AS t FROM nation),
    d AS (SELECT *, (w * t) // sum(w) OVER p AS f, (w * t) % sum(w) OVER p AS r FROM w WINDOW p AS (PARTITION BY n_regionkey)),
    l AS (SELECT *, t - sum(f) OVER (PARTITION BY n_regionkey) AS leftover, row_number() OVER (PARTITION BY n_regionkey ORDER BY r DESC, n_nationkey) AS k FROM d)
    SELECT n_regionkey, n_nationkey, CAST(f + CASE WHEN k <= leftover THEN 1 ELSE 0 END AS BIGINT) AS share FROM l""",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    return ranking.largest_remainder(rows, ["n_regionkey"], F.col("n_nationkey") % 7 + 1, F.lit(100), ["n_nationkey"])


@query(
    "allocate_questions",
    """WITH m AS (SELECT * FROM (VALUES ('single_hop', 125), ('multi_hop_abstract', 16), ('multi_hop_specific', 16)) AS t(kind, total)),
    w AS (SELECT kind, total AS t, doc_id, n_chars AS w FROM m, documents),
    d AS (SELECT *, (w * t) // sum(w) OVER p AS f, (w * t) % sum(w) OVER p AS r FROM w WINDOW p AS (PARTITION BY kind)),
    l AS (SELECT *, t - sum(f) OVER (PARTITION BY kind) AS leftover, row_number() OVER (PARTITION BY kind ORDER BY r DESC, doc_id) AS k FROM d)
    SELECT kind, doc_id, CAST(f + CASE WHEN k <= leftover THEN 1 ELSE 0 END AS BIGINT) AS share FROM l""",
)
def allocate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """157 questions, mixed 80/10/10, over documents by their length."""
    mix = planning.question_mix(157)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("total")) for k, n in mix.items()]))
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars", kinds.alias("m")).select("doc_id", "n_chars", "m.*")
    return planning.allocate(rows, ["kind"], "n_chars", "total", "doc_id").select("kind", "doc_id", "share")


@query(
    "unit_order_cumulative",
    "SELECT doc_id, n_chars, CAST(row_number() OVER o AS BIGINT) AS rank, CAST(sum(n_chars) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM documents WINDOW o AS (ORDER BY n_chars, doc_id)",
)
def unit_order_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranking.global_running(ranking.global_row_number(rows, ["n_chars", "doc_id"], "rank", 1), ["n_chars", "doc_id"], F.col("n_chars"), "total")


UNITS_CTE = """
units AS (SELECT doc_id, n_chars, lang || '.md#' || CAST(doc_id AS VARCHAR) AS unit_key, 1 + n_chars % 5 AS quota FROM documents),
progress AS (SELECT lang || '.md#' || CAST(doc_id AS VARCHAR) AS unit_key, CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'partial' ELSE 'skipped' END AS status, CAST(doc_id % 3 AS BIGINT) AS made, n_chars AS chars, n_chars * 2 + 4000 AS tokens FROM documents WHERE doc_id % 4 <> 3)
"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", planning.unit_key(F.concat("lang", F.lit(".md")), F.col("doc_id")).alias("unit_key"), (1 + F.col("n_chars") % 5).alias("quota")
    )


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").filter("doc_id % 4 <> 3").selectExpr(
        "concat(lang, '.md#', doc_id) AS unit_key", "CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'partial' ELSE 'skipped' END AS status",
        "doc_id % 3 AS made", "n_chars AS chars", "n_chars * 2 + 4000 AS tokens",
    )


@query(
    "remaining_quota",
    f"WITH {UNITS_CTE} SELECT unit_key, CASE WHEN status = 'partial' THEN greatest(0, quota - made) WHEN status IS NULL THEN quota ELSE 0 END AS remaining FROM units LEFT JOIN progress USING (unit_key)",
)
def remaining_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.remaining(_units(spark, sf_dir), _progress(spark, sf_dir))


@query(
    "pending_units",
    f"WITH {UNITS_CTE} SELECT unit_key, coalesce(status, 'new') AS status FROM units LEFT JOIN progress USING (unit_key) WHERE status IS NULL OR status = 'partial' OR status = 'skipped' AND n_chars > 1000",
)
def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and unfinished units, and skipped ones that a retry names (here: the long ones)."""
    return planning.pending(_units(spark, sf_dir), _progress(spark, sf_dir), retry=F.col("n_chars") > 1000)


@query(
    "recoverable_units",
    f"WITH {UNITS_CTE}, raw AS (SELECT lang || '.md#' || CAST(doc_id AS VARCHAR) AS unit_key FROM documents WHERE doc_id % 2 = 1) SELECT unit_key, count(*) AS made FROM raw WHERE unit_key NOT IN (SELECT unit_key FROM progress) GROUP BY unit_key",
)
def recoverable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "documents").filter("doc_id % 2 = 1").selectExpr("concat(lang, '.md#', doc_id) AS unit_key")
    return planning.recoverable(raw, _progress(spark, sf_dir))


@query(
    "progress_mismatch",
    f"WITH {UNITS_CTE}, p AS (SELECT unit_key, CASE WHEN chars % 50 = 0 THEN chars + 1 ELSE chars END AS chars FROM progress UNION ALL SELECT 'gone.md#1', 5) SELECT unit_key, CASE WHEN doc_id IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM p LEFT JOIN units USING (unit_key) WHERE doc_id IS NULL OR n_chars <> chars",
)
def progress_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _progress(spark, sf_dir).selectExpr("unit_key", "IF(chars % 50 = 0, chars + 1, chars) AS chars")
    gone = spark.createDataFrame([("gone.md#1", 5)], "unit_key string, chars long")
    return planning.mismatches(p.unionByName(gone), _units(spark, sf_dir))


@query(
    "append_dedupe",
    """WITH old AS (SELECT DISTINCT text FROM documents WHERE doc_id % 10 = 0), new AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE doc_id % 10 <> 0 AND text IS NOT NULL)
    SELECT doc_id FROM new WHERE k = 1 AND text NOT IN (SELECT text FROM old WHERE text IS NOT NULL)""",
)
def append_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    return planning.unseen(docs.filter("doc_id % 10 <> 0"), docs.filter("doc_id % 10 = 0"), "text", "doc_id").select("doc_id")


@query(
    "finalize_review",
    """SELECT d.doc_id AS pos, substr(sha256(d.text), 1, 12) AS case_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1""",
)
def finalize_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed rows, aligned by position; those kept, in order of position."""
    raw = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), planning.case_id(F.col("text")).alias("case_id"))
    review = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"))
    return planning.finalize(raw, review)


@query(
    "tokens_per_char",
    f"WITH {UNITS_CTE} SELECT round(CASE WHEN count(*) >= 3 THEN greatest(sum(tokens) - 4000 * count(*), 0) / sum(chars) END, 6) AS rate FROM progress WHERE status = 'done'",
)
def tokens_per_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).filter("status = 'done'").agg(F.round(planning.tokens_per_char(F.col("tokens"), F.col("chars")), 6).alias("rate"))


@query(
    "consecutive_breaker",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN event_type END AS failure, event_id % 5 = 0 AS resets FROM events),
    r AS (SELECT *, CASE WHEN failure IS NULL AND NOT resets THEN NULL ELSE coalesce(failure, '') END AS mark FROM e),
    m AS (SELECT *, lag(mark) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM r WHERE mark IS NOT NULL)
    SELECT user_id, min(event_id) AS tripped_at FROM m WHERE mark <> '' AND mark = before GROUP BY user_id""",
)
def consecutive_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two failures of one kind follow each other; rows that neither fail nor reset don't count."""
    e = read(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "IF(event_type = 'error' OR event_id % 3 = 0, event_type, NULL) AS failure", "event_id % 5 = 0 AS resets"
    )
    return planning.breaker(e, "user_id", "event_id", F.col("failure"), F.col("resets"))


@query(
    "count_by_type",
    """WITH k AS (SELECT unnest(['click', 'view', 'refund']) AS kind) SELECT kind, count(event_id) AS n FROM k LEFT JOIN events ON event_type = kind GROUP BY kind""",
)
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.count_by_kind(read(spark, sf_dir, "events"), F.col("event_type"), ["click", "view", "refund"])


@query(
    "plan_status",
    f"""WITH {UNITS_CTE}, r AS (SELECT unit_key, coalesce(status, 'pending') AS status, CAST(row_number() OVER (ORDER BY n_chars, doc_id) AS BIGINT) AS rank FROM units LEFT JOIN progress USING (unit_key))
    SELECT unit_key, status, rank, rank = (SELECT min(rank) FROM r WHERE status IN ('pending', 'partial')) AS is_next FROM r""",
)
def plan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.plan(_units(spark, sf_dir), _progress(spark, sf_dir))


@query(
    "record_progress",
    f"""WITH {UNITS_CTE}, run AS (SELECT unit_key, CAST(1 AS BIGINT) AS made, CASE WHEN quota > 3 THEN NULL ELSE 10 END AS tokens FROM units WHERE n_chars % 2 = 0)
    SELECT unit_key, coalesce(p.made, 0) + coalesce(r.made, 0) AS made, CASE WHEN r.unit_key IS NULL THEN p.tokens WHEN p.unit_key IS NULL THEN r.tokens ELSE p.tokens + r.tokens END AS tokens,
      CASE WHEN r.unit_key IS NULL THEN p.status WHEN r.made > 0 THEN 'done' ELSE 'skipped' END AS status
    FROM progress p FULL JOIN run r USING (unit_key)""",
)
def record_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's counts added to the progress; a missing token count poisons the sum."""
    run = _units(spark, sf_dir).filter("n_chars % 2 = 0").selectExpr("unit_key", "1L AS made", "IF(quota > 3, NULL, 10L) AS tokens")
    return planning.record(_progress(spark, sf_dir), run)


@query(
    "mask_secrets",
    """SELECT o_orderkey, left(regexp_replace('key gsk_' || CAST(o_orderkey AS VARCHAR) || 'Ab of org_x' || CAST(o_custkey AS VARCHAR) || ' failed', '(org|gsk)_[A-Za-z0-9]+', '\\1_***', 'g'), 200) AS message FROM orders""",
)
def mask_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("key gsk_"), F.col("o_orderkey"), F.lit("Ab of org_x"), F.col("o_custkey"), F.lit(" failed"))
    return read(spark, sf_dir, "orders").select("o_orderkey", planning.mask(text).alias("message"))


@query(
    "unit_keys",
    "SELECT doc_id, lang || '.md#' || CAST(doc_id AS VARCHAR) AS unit_key, 'kg/' || lang || '_' || lpad(CAST(doc_id AS VARCHAR), greatest(4, length(CAST(doc_id AS VARCHAR)))::INTEGER, '0') || '.json' AS graph_path FROM documents",
)
def unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are padded to four digits and longer ones kept whole."""
    number = F.col("doc_id").cast("string")
    path = F.concat(F.lit("kg/"), "lang", F.lit("_"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")), F.lit(".json"))
    return read(spark, sf_dir, "documents").select("doc_id", planning.unit_key(F.concat("lang", F.lit(".md")), F.col("doc_id")).alias("unit_key"), path.alias("graph_path"))
