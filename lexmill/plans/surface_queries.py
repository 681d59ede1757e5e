"""Queries of the smaller surfaces: messages, traces, admission, unit selection, stage status, error classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators import throttle
from lexmill.plans.conversation_queries import turn_events
from lexmill.plans.evaluation_queries import LOG_CTE, UNITS_CTE, latest
from lexmill.plans.retrieval_queries import DENSE_CTE, dense_hits
from lexmill.registry import query
from lexmill.sources.tables import read

#: Messages by code, a table of fixed size.
MESSAGES = {
    "out_of_scope": "Câu hỏi nằm ngoài phạm vi tra cứu.",
    "unsafe": "Yêu cầu không được hỗ trợ.",
    "unable_to_verify": "Không kiểm chứng được câu trả lời.",
    "internal_error": "Lỗi nội bộ.",
}
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in MESSAGES.items())


@query(
    "fixed_messages",
    f"WITH m AS (SELECT * FROM (VALUES {_VALUES}) AS t(code, message)), e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'unsafe' WHEN 2 THEN 'unable_to_verify' WHEN 3 THEN 'boom' END AS code FROM events) SELECT event_id, CASE WHEN e.code IS NOT NULL THEN coalesce(message, '{MESSAGES['internal_error']}') END AS message FROM e LEFT JOIN m USING (code)",
)
def fixed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed text of a refusal or error; unknown codes are internal errors."""
    codes = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    rows = read(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 6 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'unsafe' WHEN 2 THEN 'unable_to_verify' WHEN 3 THEN 'boom' END AS code")
    return rows.select("event_id", F.when(F.col("code").isNotNull(), F.coalesce(F.try_element_at(codes, "code"), F.lit(MESSAGES["internal_error"]))).alias("message"))


@query("retrieve_output", f"WITH {DENSE_CTE} SELECT query_id, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS ids, max(score) AS best FROM dense WHERE rank <= 5 GROUP BY query_id")
def retrieve_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "vec_id")))
    return dense_hits(spark, sf_dir, 5).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["vec_id"].cast("string")), ",").alias("ids"), F.max("score").alias("best")
    )


@query(
    "turn_events_invariant",
    "SELECT user_id AS turn, count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS n_done, arg_max(event_type NOT IN ('click', 'view', 'error'), event_id) AS ends_done FROM events GROUP BY user_id HAVING n_done <> 1 OR NOT ends_done",
)
def turn_events_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that break the rule: one done event, the last by order."""
    done = F.col("type") == "done"
    checked = turn_events(spark, sf_dir).groupBy("turn").agg(F.count_if(done).alias("n_done"), F.max_by(done, "seq").alias("ends_done"))
    return checked.filter("n_done <> 1 OR NOT ends_done")


@query(
    "trace_metadata",
    """SELECT event_id, '{"turn":' || user_id || ',"outcome":"' || event_type || '"' || CASE WHEN event_id % 4 = 0 THEN ',"cache":"hit"' ELSE '' END || '}' AS metadata, event_type || CASE WHEN event_id % 4 = 0 THEN ',cached' ELSE '' END AS tags FROM events""",
)
def trace_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as JSON without null fields, and tags."""
    cached = F.col("event_id") % 4 == 0
    body = F.to_json(F.struct(F.col("user_id").alias("turn"), F.col("event_type").alias("outcome"), F.when(cached, "hit").alias("cache")))
    tags = F.array_join(F.array_compact(F.array(F.col("event_type"), F.when(cached, F.lit("cached")))), ",")
    return read(spark, sf_dir, "events").select("event_id", body.alias("metadata"), tags.alias("tags"))


@query(
    "content_deltas",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'v' || event_id WHEN 'error' THEN '' ELSE NULL END AS content, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('click', 'view') THEN NULL WHEN event_id % 5 = 0 THEN 'length' ELSE 'stop' END AS finish_reason FROM events""",
)
def content_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text delta and finish reason per event: tokens carry text, a cut-off answer ends with length."""
    kind = F.col("event_type")
    content = F.when(kind == "click", F.concat(F.lit("v"), "event_id")).when(kind == "error", "")
    reason = F.when(kind == "error", "error").when(kind.isin("click", "view"), None).when(F.col("event_id") % 5 == 0, "length").otherwise("stop")
    return read(spark, sf_dir, "events").select("event_id", content.alias("content"), reason.alias("finish_reason"))


@query(
    "error_bodies",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 422 WHEN 1 THEN 429 WHEN 2 THEN 500 ELSE 401 END AS status, CASE WHEN event_id % 4 = 1 THEN CAST(event_id % 60 + 1 AS BIGINT) END AS retry_after,
      '{"error":{"code":"' || CASE event_id % 4 WHEN 0 THEN 'invalid_request' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'internal_error' ELSE 'unauthorized' END || '"}}' AS body FROM events""",
)
def error_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.struct(F.lit(s).alias("status"), F.lit(c).alias("code")) for s, c in ((422, "invalid_request"), (429, "rate_limited"), (500, "internal_error"), (401, "unauthorized"))])
    rows = read(spark, sf_dir, "events").select("event_id", F.get(codes, (F.col("event_id") % 4).cast("int")).alias("e"))
    wait = F.when(F.col("e.status") == 429, F.col("event_id") % 60 + 1)
    return rows.select("event_id", "e.status", wait.alias("retry_after"), F.to_json(F.struct(F.struct(F.col("e.code")).alias("error"))).alias("body"))


@query("admission_decisions")
def admission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each call runs, waits or is rejected, and when it starts. No SQL: what a call meets hangs on all before it;
    held against a brute-force version in tests."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id % 5 AS bucket", "event_id", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS s", "event_id % 900 + 1 AS d")
    return throttle.admissions(rows, "bucket", "s", "d", "event_id").select("event_id", "decision", "start")


@query(
    "select_units",
    f"WITH {UNITS_CTE} SELECT unit_key FROM units WHERE unit_key LIKE 'fr.md#%' OR unit_key IN ('en.md#0', 'en.md#1', 'de.md#21')",
)
def select_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units named by selectors: a document, with or without its suffix, or one unit of it."""
    units = read(spark, sf_dir, "documents").select(F.concat("lang", F.lit(".md")).alias("document"), F.col("doc_id").alias("index"))
    asked = spark.createDataFrame([("fr",), ("en.md#0",), ("en#1",), ("de#21",)], "selector string")
    parts = F.split("selector", "#")
    wanted = asked.select(F.concat(F.regexp_replace(parts[0], "\\.md$", ""), F.lit(".md")).alias("d"), F.try_element_at(parts, F.lit(2)).cast("long").alias("i"))
    hit = (F.col("document") == F.col("d")) & (F.col("i").isNull() | (F.col("i") == F.col("index")))
    return units.join(F.broadcast(wanted), hit, "left_semi").select(F.concat("document", F.lit("#"), "index").alias("unit_key"))


@query(
    "stage_status",
    f"""WITH {LOG_CTE}, s AS (SELECT * FROM (VALUES ('retrieve', 2), ('generate', 3), ('score', 5)) AS t(stage, m)),
    g AS (SELECT stage, l.*, case_id % m <> 0 AS here FROM s, latest l)
    SELECT stage, config, count(*) FILTER (here AND error IS NULL) AS done, count(*) FILTER (here AND error IS NOT NULL) AS errors, count(*) FILTER (NOT here AND (stage <> 'score' OR outcome = 'answered')) AS pending FROM g GROUP BY stage, config""",
)
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done, failed and pending cases of each stage and configuration; scoring waits for answered cases only."""
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("m")) for s, m in (("retrieve", 2), ("generate", 3), ("score", 5))]))
    rows = latest(spark, sf_dir).select("case_id", "config", "error", "outcome", stages.alias("s")).withColumn("here", F.col("case_id") % F.col("s.m") != 0)
    eligible = (F.col("s.stage") != "score") | (F.col("outcome") == "answered")
    return rows.groupBy("s.stage", "config").agg(
        F.count_if(F.col("here") & F.col("error").isNull()).alias("done"),
        F.count_if(F.col("here") & F.col("error").isNotNull()).alias("errors"),
        F.count_if(~F.col("here") & eligible).alias("pending"),
    )


@query(
    "error_roots",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ConnectTimeout' WHEN 1 THEN 'ValidationError' ELSE 'ValueError' END AS root, event_id % 3 = 0 AS transport FROM events",
)
def error_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last cause of an error's chain, and whether any cause is one of transport."""
    chain = F.expr("CASE event_id % 3 WHEN 0 THEN array('RuntimeError', 'ConnectTimeout') WHEN 1 THEN array('RuntimeError', 'ValidationError') ELSE array('ValueError') END")
    rows = read(spark, sf_dir, "events").select("event_id", chain.alias("chain"))
    transport = F.exists("chain", lambda x: x.isin("ConnectTimeout", "ConnectError", "ReadTimeout", "RemoteProtocolError"))
    return rows.select("event_id", F.element_at("chain", -1).alias("root"), transport.alias("transport"))


@query(
    "graph_reuse",
    "SELECT d.doc_id, d.doc_id % 3 = 0 AS reusable FROM documents d WHERE text IS NOT NULL",
)
def graph_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stored graph holds the very text of its unit, told by digest."""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    stored = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("g"))
    return docs.join(stored, "doc_id").select("doc_id", (F.col("h") == F.col("g")).alias("reusable"))


@query(
    "user_default",
    "SELECT coalesce(CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END, 'anonymous') AS user, count(*) AS n, CAST(sum(CASE WHEN event_id % 2 = 0 THEN event_id END) AS BIGINT) AS tokens FROM events GROUP BY 1",
)
def user_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage totals per user; requests without one count as anonymous, unknown usage as nothing."""
    rows = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("u"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("t"))
    return rows.groupBy(F.coalesce("u", F.lit("anonymous")).alias("user")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"))
