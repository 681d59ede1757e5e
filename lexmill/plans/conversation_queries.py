"""Queries of conversations, caches and budgets over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import query_key_text
from lexmill.functions.text import WHITE
from lexmill.operators import conversation, throttle, turn_order
from lexmill.plans.verification_queries import A_CTE, Q_CTE, contexts, questions
from lexmill.registry import query
from lexmill.sources.tables import read

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
C_CTE = f"""
k AS (SELECT conv_id, turn, role, trim(text, {_WS}) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, {_WS}) <> ''),
p0 AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM k),
p1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pair, role ORDER BY turn) AS nth FROM p0),
pairs AS (SELECT * FROM p1 WHERE pair >= 1 AND nth = 1),
lst AS (SELECT conv_id, max(turn) AS lt, arg_max(role, turn) AS lr, arg_max(text, turn) AS lx FROM k GROUP BY conv_id),
cl AS (SELECT *, CASE WHEN role = 'user' THEN left(text, 1000) ELSE trim(regexp_replace(text, '\\[\\d+\\]', '', 'g'), {_WS}) END AS t0 FROM pairs),
clean AS (SELECT *, CASE WHEN role = 'assistant' AND length(t0) > 600 THEN rtrim(left(t0, 600), {_WS}) || '…' ELSE t0 END AS t, max(pair) OVER (PARTITION BY conv_id) AS final FROM cl),
hist AS (SELECT conv_id, turn, role, t FROM clean JOIN lst USING (conv_id) WHERE turn < lt AND pair >= final - 3 AND lr = 'user'),
win AS (SELECT conv_id, lx, CASE WHEN lr <> 'user' THEN 'last_not_user' WHEN length(lx) > 1000 THEN 'query_too_long' END AS error FROM lst)
"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.windows(read(spark, sf_dir, "conversations"))


@query(
    "history_window",
    f"""WITH {C_CTE} SELECT w.conv_id, CASE WHEN error IS NULL THEN lx END AS query, error, CASE WHEN error IS NULL THEN coalesce((SELECT string_agg(role || ': ' || t, chr(10) ORDER BY turn) FROM hist h WHERE h.conv_id = w.conv_id), '') END AS history FROM win w""",
)
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return _windows(spark, sf_dir).select("conv_id", "query", "error", lines.alias("history"))


@query("pair_turns", f"WITH {C_CTE} SELECT conv_id, turn, role, CAST(pair AS BIGINT) AS pair FROM pairs")
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.paired_turns(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "pair")


@query(
    "clean_assistant",
    "SELECT o_orderkey, 'Mức ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' ' || repeat('x', 700 - length('Mức ' || o_custkey || ' ') - 100) || '…' ELSE '' END AS text FROM orders",
)
def clean_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit(" Mức "), "o_custkey", F.lit("[1]"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.repeat(F.lit("x"), 700))).otherwise(""),
        F.lit(conversation.SOURCES_MARK), F.lit("[1] Điều 1"), F.lit(conversation.DISCLAIMER_BEGIN),
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", conversation.clean_assistant(text).alias("text"))


@query(
    "recent_user_turns",
    f"""WITH {C_CTE}, u AS (SELECT conv_id, turn, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM hist WHERE role = 'user')
    SELECT w.conv_id, coalesce((SELECT string_agg(t, chr(10) ORDER BY turn) FROM u WHERE u.conv_id = w.conv_id AND k <= 2), '') AS turns FROM win w WHERE error IS NULL""",
)
def recent_user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).filter("error IS NULL").select("conv_id", F.array_join(conversation.recent_user_turns(F.col("history")), "\n").alias("turns"))


@query(
    "condense_message",
    f"""WITH {C_CTE} SELECT w.conv_id, 'Hội thoại trước:' || chr(10) || coalesce((SELECT string_agg(CASE role WHEN 'user' THEN 'Người dùng' ELSE 'Trợ lý' END || ': ' || t, chr(10) ORDER BY turn) FROM hist h WHERE h.conv_id = w.conv_id), '') || chr(10) || chr(10) || 'Câu hỏi cuối: ' || lx AS message FROM win w WHERE error IS NULL""",
)
def condense_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).filter("error IS NULL").select("conv_id", conversation.history_text(F.col("history"), F.col("query")).alias("message"))


@query(
    "condense_check",
    """WITH c AS (SELECT o_orderkey AS q, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ab' WHEN 2 THEN 'Theo Điều ' || o_custkey % 20 || ' thì sao' WHEN 3 THEN 'Theo Điều 7 khoản 2 thì sao' ELSE 'mức lương là bao nhiêu' END AS text, o_custkey FROM orders)
    SELECT q, CASE WHEN q % 5 = 0 THEN 'empty' WHEN q % 5 = 1 THEN 'bad_length' WHEN q % 5 = 2 AND o_custkey % 20 <> 7 THEN 'unknown_citation' ELSE 'ok' END AS reason, CASE WHEN q % 5 IN (3, 4) OR q % 5 = 2 AND o_custkey % 20 = 7 THEN text END AS text FROM c""",
)
def condense_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(
        """CASE o_orderkey % 5 WHEN 0 THEN ' \n ' WHEN 1 THEN '"ab"' WHEN 2 THEN concat('\n“Theo Điều ', o_custkey % 20, ' thì sao”\nthừa')
        WHEN 3 THEN 'Theo Điều 7 khoản 2 thì sao' ELSE '`mức lương là bao nhiêu`' END"""
    )
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("Điều 7 khoản 2 nói gì").alias("text")))
    found = conversation.check_rewrite(raw, F.lit("còn mức lương"), history)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), found.alias("r")).select("q", "r.reason", "r.text")


@query(
    "cache_key",
    f"WITH {Q_CTE}, n AS (SELECT q, rtrim(regexp_replace(lower('  ' || text || '  ?! '), '\\s+', ' ', 'g'), ' ?.!') AS k FROM qs) SELECT q, k AS normal, 'rag:ans:v1:p1:m1:' || substr(sha256(k), 1, 32) AS answer_key, 'rag:ret:v1:' || substr(sha256(k), 1, 32) AS retrieval_key FROM n",
)
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("  "), "text", F.lit("  ?! "))
    return questions(spark, sf_dir).select(
        "q", query_key_text(text).alias("normal"), conversation.answer_key(text, "v1", "p1", "m1").alias("answer_key"), conversation.retrieval_key(text, "v1").alias("retrieval_key")
    )


@query(
    "cache_lookup",
    """WITH c AS (SELECT user_id AS k, min(event_id) AS value, min(ts) + INTERVAL 7 DAY AS expires_at FROM events WHERE event_id % 2 = 0 GROUP BY user_id)
    SELECT event_id, CASE WHEN expires_at > ts THEN c.value END AS value FROM events LEFT JOIN c ON k = user_id""",
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    cache = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("value"), (F.min("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return conversation.cache_lookup(e.select("event_id", "user_id", "ts"), cache, "user_id", "ts").select("event_id", "value")


@query("cache_flush", "SELECT c_custkey FROM customer WHERE NOT c_name LIKE 'Customer#%1_'")
def cache_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.flush(read(spark, sf_dir, "customer"), "c_name", "Customer#*1?").select("c_custkey")


@query(
    "cacheable_answer",
    f"""WITH {A_CTE} SELECT a, a % 7 <> 0 AND a % 5 <> 0 AND (y <= coalesce(n, 0) OR a % 11 = 0) AS ok FROM ans LEFT JOIN nc USING (a)""",
)
def cacheable_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = contexts(spark, sf_dir).groupBy("a").agg(F.collect_list("rank").alias("ranks"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a")).join(given, "a", "left")
    text = F.when(F.col("a") % 11 == 0, "Tôi không tìm thấy quy định").otherwise("Mức là")
    ok = conversation.cacheable(
        F.when(F.col("a") % 7 == 0, "x"), F.when(F.col("a") % 5 == 0, 1).otherwise(0), F.array((F.col("a") % 6 + 1).cast("int")),
        F.coalesce("ranks", F.array().cast("array<int>")), text,
    )
    return rows.select("a", ok.alias("ok"))


@query(
    "single_flight_leaders",
    """WITH RECURSIVE e AS (SELECT user_id % 20 AS k, event_id, epoch(date_trunc('second', ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS i FROM events),
    f(k, event_id, i, since, leads) AS (SELECT k, event_id, i, s, true FROM e WHERE i = 1
      UNION ALL SELECT e.k, e.event_id, e.i, CASE WHEN e.s - f.since >= 3600 THEN e.s ELSE f.since END, e.s - f.since >= 3600 FROM f JOIN e ON e.k = f.k AND e.i = f.i + 1)
    SELECT k, event_id FROM f WHERE leads""",
)
def single_flight_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("k"), "event_id", "ts")
    return conversation.single_flight(e, "k", "ts", "event_id", 3600)


_PIECE = f"[^{WHITE[1:-1]}]+{WHITE}*"


@query(
    "replay_pieces",
    f"""WITH p AS (SELECT doc_id, CASE WHEN regexp_full_match(text, '{WHITE}+') THEN [text] ELSE regexp_extract_all(text, '^{WHITE}*{_PIECE}|{_PIECE}') END AS words FROM documents),
    w AS (SELECT doc_id, i, (i - 1) // 4 AS g, words[i] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM p))
    SELECT doc_id, CAST(g AS INTEGER) AS k, string_agg(w, '' ORDER BY i) AS piece FROM w GROUP BY doc_id, g""",
)
def replay_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents, as replayed answers."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(conversation.replay_pieces(F.col("text"))).alias("k", "piece"))


@query(
    "rate_limit_minute",
    """WITH e AS (SELECT event_id, user_id % 10 AS u, ts, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY u, s // 60 ORDER BY ts, event_id) AS n FROM e)
    SELECT event_id, CAST(n AS INTEGER) AS n, n <= 1 AS allowed, CASE WHEN n > 1 THEN 60 - s % 60 END AS retry_after FROM n""",
)
def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).cast("string").alias("u"), "ts")
    return conversation.rate_limit(e, "u", "ts", "event_id", 1).select("event_id", "n", "allowed", "retry_after")


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "user_id AS turn", "event_id AS seq", "ts", "CASE event_type WHEN 'click' THEN 'token' WHEN 'view' THEN 'token' WHEN 'error' THEN 'error' ELSE 'done' END AS type",
        "concat(event_type, event_id % 7) AS text",
    )


@query(
    "turn_trace",
    """WITH e AS (SELECT user_id AS turn, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'token' WHEN 'view' THEN 'token' WHEN 'error' THEN 'error' ELSE 'done' END AS type, event_type || CAST(event_id % 7 AS VARCHAR) AS text FROM events)
    SELECT turn, min(ts) FILTER (type = 'token') AS first_token, coalesce(string_agg(text, '' ORDER BY seq) FILTER (type = 'token'), '') AS text, arg_max(text, seq) FILTER (type = 'error') AS last_error, count(*) FILTER (type = 'done') AS n_done,
      epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS seconds FROM e GROUP BY turn""",
)
def turn_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.turn_trace(turn_events(spark, sf_dir), "turn")


@query(
    "latency_histogram",
    """WITH b AS (SELECT unnest(['0.5', '1', '2', '5', '10', '20', '30', '60', '120', '+Inf']) AS le) SELECT event_type AS outcome, le, count(*) FILTER (le = '+Inf' OR value <= TRY_CAST(le AS DOUBLE)) AS n FROM events, b GROUP BY event_type, le""",
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.histogram(read(spark, sf_dir, "events").withColumnRenamed("event_type", "outcome"), "value", ["outcome"])


@query(
    "sources_block",
    f"WITH {A_CTE} SELECT a, chr(10) || chr(10) || '---' || chr(10) || '**Nguồn**' || chr(10) || string_agg('[' || rank || '] ' || breadcrumb || ' — ' || chunk_id, chr(10) ORDER BY rank) AS sources FROM c5 GROUP BY a",
)
def sources_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.sources_block(contexts(spark, sf_dir).selectExpr("a", "rank AS n", "breadcrumb", "chunk_id AS source_document"), "a")


@query(
    "completion_text",
    "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
)
def completion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas in order as one completion."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("content"), F.count(F.lit(1)).alias("n"))


# Budgets


@query(
    "sliding_budget_60s",
    """WITH e AS (SELECT event_id, user_id % 5 AS bucket, epoch(date_trunc('second', ts))::BIGINT AS s, event_id % 900 AS tokens FROM events)
    SELECT event_id, count(*) OVER w AS n_requests, CAST(sum(tokens) OVER w AS BIGINT) AS n_tokens FROM e WINDOW w AS (PARTITION BY bucket ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
def sliding_budget_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.sliding_load(_calls(spark, sf_dir), "bucket", "s", "tokens").select("event_id", "n_requests", "n_tokens")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id", "user_id % 5 AS bucket", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS s", "event_id % 900 AS tokens")


@query(
    "admission_load",
    """WITH e AS (SELECT user_id % 5 AS bucket, epoch(date_trunc('second', ts))::BIGINT AS s, event_id % 900 + 1 AS d FROM events),
    m AS (SELECT bucket, s AS ts, 1 AS d FROM e UNION ALL SELECT bucket, s + d, -1 FROM e), t AS (SELECT bucket, ts, sum(d) AS d FROM m GROUP BY bucket, ts)
    SELECT bucket, ts, CAST(sum(d) OVER (PARTITION BY bucket ORDER BY ts) AS BIGINT) AS running FROM t""",
)
def admission_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _calls(spark, sf_dir).selectExpr("bucket", "s", "s + tokens + 1 AS e")
    return throttle.admission_load(spans, "s", "e", "bucket")


@query("throttle_delay")
def throttle_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When calls may start under 8,000 tokens and 30 requests a minute; held against a brute-force version in tests."""
    return throttle.delays(_calls(spark, sf_dir), "bucket", "s", "tokens", "event_id", 8000, 30)


@query("round_robin_assign", "SELECT event_id, event_id % 9 AS client FROM events")
def round_robin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", throttle.round_robin(F.col("event_id"), 9).alias("client"))


_ERRORS = "CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 429 WHEN 2 THEN 498 WHEN 3 THEN 503 WHEN 4 THEN 401 WHEN 5 THEN 400 END AS status, CASE WHEN event_id % 7 = 0 THEN 'Limit 1000 (RPD) reached' ELSE 'slow down' END AS message, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '0.2' WHEN 2 THEN '500' WHEN 3 THEN '7.5' END AS header"


@query(
    "error_classes",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 6 THEN 'timeout' ELSE 'http' END AS kind, {_ERRORS} FROM events)
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'daily_limit' WHEN 1 THEN 'minute_limit' WHEN 4 THEN 'auth' WHEN 5 THEN 'other' ELSE 'transient' END AS class, CASE event_id % 7 WHEN 0 THEN 300e0 WHEN 1 THEN CASE event_id % 5 WHEN 1 THEN 1e0 WHEN 2 THEN 60e0 WHEN 3 THEN 7.5e0 ELSE 15e0 END END AS cooldown FROM e""",
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_id", "IF(event_id % 7 = 6, 'timeout', 'http') AS kind", *[x.strip() for x in _split_columns(_ERRORS)])
    kind = throttle.error_class(F.col("kind"), F.col("status"), F.col("message"))
    return rows.select("event_id", kind.alias("class"), "header").select("event_id", "class", throttle.cooldown(F.col("class"), F.col("header")).alias("cooldown"))


def _split_columns(sql: str) -> list[str]:
    return [x if x.startswith("CASE") else "CASE" + x for x in sql.split(", CASE")]


@query("daily_quota_flag", f"WITH e AS (SELECT event_id, {_ERRORS} FROM events) SELECT event_id, event_id % 7 = 0 AS daily FROM e")
def daily_quota_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").selectExpr("event_id", *_split_columns(_ERRORS))
    return rows.select("event_id", throttle.is_daily_limit(F.col("message")).alias("daily"))


@query(
    "token_estimates",
    "SELECT doc_id, CAST(ceil(n_chars / 2.5) + 300 AS BIGINT) AS estimate, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE CAST(ceil(n_chars / 2.5) + 300 AS BIGINT) END AS settled, 'm:' || substr(sha256(source), 1, 8) AS bucket FROM documents",
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimate = throttle.estimate(F.col("n_chars"), 2.5, 300)
    actual = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", estimate.alias("estimate"), throttle.settled(actual, estimate).alias("settled"), throttle.bucket_id("m", F.col("source")).alias("bucket")
    )


@query(
    "token_delta",
    "WITH u AS (SELECT event_id % 9 AS client, event_id, event_id % 900 AS tokens FROM events), t AS (SELECT client, sum(CASE WHEN event_id <= 500 THEN tokens ELSE 0 END)::BIGINT AS before, sum(tokens)::BIGINT AS after FROM u GROUP BY client) SELECT *, after - before AS delta FROM t",
)
def token_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.token_totals(read(spark, sf_dir, "events").selectExpr("event_id % 9 AS client", "event_id", "event_id % 900 AS tokens"), "client", "event_id", 500)


# Turns: an event asks one of a hundred questions, at a hundredth of its time; some are refused, fail, or find nothing.
TURNS = """SELECT event_id AS turn, user_id % 100 AS k, {second} AS asked, event_id % 71 AS took, event_id % 13 = 0 AS failed, event_id % 11 AS n_chunks,
  CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 17 AS DOUBLE) - 8 END AS best, event_id % 3 > 0 AS keeps, CASE event_type WHEN 'error' THEN 'out_of_scope' WHEN 'view' THEN 'unsafe' END AS verdict,
  CASE WHEN event_id % 2 = 0 THEN 'Xin chào!' ELSE 'lương tối thiểu là bao nhiêu' END AS text FROM {table}"""
TURN_LIMITS = turn_order.Limits(answers=120, retrievals=400)


def asked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "events").createOrReplaceTempView("lexmill_events")
    rows = spark.sql(TURNS.format(second="unix_timestamp(CAST(ts AS TIMESTAMP)) DIV 100", table="lexmill_events"))
    return rows.withColumn("relevant", turn_order.relevant(F.col("n_chunks"), F.col("best")))


TURN_SQL = f"""
WITH RECURSIVE t AS ({TURNS.format(second="CAST(epoch(date_trunc('second', ts)) AS BIGINT) // 100", table="events")}),
seen AS (SELECT *, CASE WHEN verdict = 'unsafe' THEN 'unsafe' WHEN verdict = 'out_of_scope' AND turn % 2 = 0 THEN 'out_of_scope' ELSE 'allow' END AS scoped,
  n_chunks > 0 AND coalesce(best >= -6.8, true) AS relevant FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY asked, turn) AS i FROM seen WHERE scoped = 'allow'),
f AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS turn, '' AS role, '' AS cache, '' AS outcome, CAST(0 AS BIGINT) AS decided,
    CAST(NULL AS BIGINT) AS ended, false AS good, CAST(-1000000 AS BIGINT) AS leads, CAST(-1 AS BIGINT) AS kept FROM (SELECT DISTINCT k FROM o)
  UNION ALL
  SELECT k, i, turn, role, CASE WHEN served THEN 'answer_hit' WHEN found THEN 'retrieval_hit' ELSE 'miss' END, outcome, CASE WHEN served THEN greatest(asked, ended) ELSE start END,
    CASE WHEN role = 'leader' THEN fin ELSE ended END, CASE WHEN role = 'leader' THEN fine ELSE good END,
    CASE WHEN role <> 'leader' THEN leads WHEN fine THEN fin + 120 ELSE fin - 45 END,
    CASE WHEN NOT served AND NOT found AND outcome = 'answered' THEN start + 400 ELSE kept END
  FROM (SELECT *, start + least(runs, 60) AS fin, outcome = 'answered' AND keeps AND runs <= 60 AS fine
    FROM (SELECT *, CASE WHEN outcome = 'answered' THEN took ELSE 0 END AS runs
      FROM (SELECT *, CASE WHEN served OR found THEN 'answered' WHEN failed THEN 'retrieval_error' WHEN relevant THEN 'answered' ELSE 'no_context' END AS outcome
        FROM (SELECT *, start < kept AS found, CASE WHEN served THEN 'follower' WHEN follows THEN 'alone' ELSE 'leader' END AS role
          FROM (SELECT *, CASE WHEN follows THEN asked + 45 ELSE greatest(asked, coalesce(ended, asked)) END AS start, follows AND good AND asked + 45 >= ended AS served
            FROM (SELECT o.*, f.ended, f.good, f.leads, f.kept, f.ended IS NOT NULL AND o.asked < f.leads AS follows FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)))))))
"""


@query(
    "turn_order",
    f"{TURN_SQL} SELECT k, turn, role, cache, outcome, decided FROM f WHERE i > 0 UNION ALL SELECT k, turn, 'refused', 'miss', scoped, asked FROM seen WHERE scoped <> 'allow'",
)
def turn_order_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each turn: refused by the guard, served by the cache or by the flight it follows, or produced."""
    allowed, refused = turn_order.guarded(asked_turns(spark, sf_dir), F.col("verdict"), F.col("text"))
    gone = refused.select("k", "turn", F.lit("refused").alias("role"), F.lit("miss").alias("cache"), F.col("verdict").alias("outcome"), F.col("asked").alias("decided"))
    return turn_order.fates(allowed, "k", "turn", TURN_LIMITS).unionByName(gone)


@query(
    "flight_followers",
    f"{TURN_SQL} SELECT k, count(*) FILTER (role = 'leader') AS n_leaders, count(*) FILTER (role = 'follower') AS n_served, count(*) FILTER (role = 'alone') AS n_alone, CAST(sum(decided - asked) FILTER (role <> 'leader') AS BIGINT) AS waited, count(*) FILTER (role = 'leader' AND decided > asked) AS n_takeovers FROM f JOIN o USING (k, turn) GROUP BY k",
)
def flight_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question: who led, took over, was served while waiting, ran alone, and how long they waited in all."""
    allowed, _ = turn_order.guarded(asked_turns(spark, sf_dir), F.col("verdict"), F.col("text"))
    found = turn_order.fates(allowed, "k", "turn", TURN_LIMITS).join(allowed.select("k", "turn", "asked"), ["k", "turn"])
    late = F.col("decided") - F.col("asked")
    return found.groupBy("k").agg(
        F.count_if(F.col("role") == "leader").alias("n_leaders"), F.count_if(F.col("role") == "follower").alias("n_served"), F.count_if(F.col("role") == "alone").alias("n_alone"),
        F.sum(F.when(F.col("role") != "leader", late)).alias("waited"), F.count_if((F.col("role") == "leader") & (late > 0)).alias("n_takeovers"),
    )
