"""Conversations, caches, single flight, replay, rate limits and traces, as set operations over turns and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import query_key_text
from lexmill.sources.shared import keep

from .citation import article_numbers

#: Fixed values.
SOURCES_MARK = "\n\n---\n**Nguồn**\n"
DISCLAIMER_BEGIN = "\n\n_Dữ liệu pháp luật trong hệ thống được cập nhật tới "
MAX_QUERY, MAX_TURNS, MAX_ASSISTANT, GUARD_TURNS = 1000, 3, 600, 2
QUOTES = "\"'`“”‘’«»"
RETRIEVAL_TTL = 86_400
LATENCY_BUCKETS = (0.5, 1, 2, 5, 10, 20, 30, 60, 120)


def clean_assistant(text: Column) -> Column:
    """An earlier answer without sources, disclaimer and citations, cut to its limit."""
    out = F.substring_index(F.substring_index(text, SOURCES_MARK, 1), DISCLAIMER_BEGIN, 1)
    out = F.regexp_replace(F.regexp_replace(out, "\\[\\d+\\]", ""), "^\\s+|\\s+$", "")
    return F.when(F.length(out) > MAX_ASSISTANT, F.concat(F.regexp_replace(F.left(out, F.lit(MAX_ASSISTANT)), "\\s+$", ""), F.lit("…"))).otherwise(out)


def kept_messages(messages: DataFrame) -> DataFrame:
    """User and assistant messages that say something, trimmed: conv_id, turn, role, text."""
    text = F.regexp_replace("text", "^\\s+|\\s+$", "")
    return messages.select("conv_id", "turn", "role", text.alias("text")).filter(F.col("role").isin("user", "assistant") & (F.col("text") != ""))


def paired_turns(messages: DataFrame) -> DataFrame:
    """Kept messages with pair, the number of the user turn they belong to: a user message opens a pair and the first
    assistant message after it closes it; other assistant messages drop out."""
    ordered = W.partitionBy("conv_id").orderBy("turn")
    rows = kept_messages(messages).withColumn("pair", F.sum((F.col("role") == "user").cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy("conv_id", "pair", "role").orderBy("turn"))
    return rows.withColumn("nth", nth).filter("pair >= 1 AND nth = 1").drop("nth")


def windows(messages: DataFrame) -> DataFrame:
    """conv_id, query, history (array of role, text) and error: the last message must be a user's and short enough; the
    history holds the last pairs before it, cleaned."""
    kept = kept_messages(messages)
    last = kept.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("last"))
    pairs = paired_turns(messages)
    final = F.max("pair").over(W.partitionBy("conv_id"))
    clean = F.when(F.col("role") == "user", F.left("text", F.lit(MAX_QUERY))).otherwise(clean_assistant(F.col("text")))
    before = pairs.withColumn("final", final).join(last.select("conv_id", F.col("last.turn").alias("lt"), F.col("last.role").alias("lr")), "conv_id")
    # A query opens a pair of its own, which is no history.
    history = (
        before.filter((F.col("turn") < F.col("lt")) & (F.col("pair") >= F.col("final") - MAX_TURNS) & (F.col("lr") == "user"))
        .groupBy("conv_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", clean.alias("text")))), lambda m: F.struct(m["role"], m["text"])).alias("history"))
    )
    error = F.when(F.col("last.role") != "user", "last_not_user").when(F.length("last.text") > MAX_QUERY, "query_too_long")
    none = F.array().cast("array<struct<role:string,text:string>>")
    return last.join(history, "conv_id", "left").select(
        "conv_id", F.when(error.isNull(), F.col("last.text")).alias("query"), F.when(error.isNull(), F.coalesce("history", none)).alias("history"), error.alias("error")
    )


def recent_user_turns(history: Column, n: int = GUARD_TURNS) -> Column:
    users = F.transform(F.filter(history, lambda m: m["role"] == "user"), lambda m: m["text"])
    return F.slice(users, F.greatest(F.size(users) - n + 1, F.lit(1)), n)


def check_rewrite(raw: Column, query: Column, history: Column) -> Column:
    """struct(text, reason): the first line of a rewritten question, if it is of a fair length and cites nothing that
    neither the question nor the history cites."""
    from .citation import clause_numbers

    lines = F.filter(F.transform(F.split(raw, "\\R"), lambda x: F.trim(x)), lambda x: x != "")
    text = F.trim(F.btrim(F.get(lines, F.lit(0)), F.lit(QUOTES)))
    source = F.concat_ws("\n", query, F.array_join(F.transform(history, lambda m: m["text"]), "\n"))
    unknown = (F.size(F.array_except(article_numbers(text), article_numbers(source))) > 0) | (
        F.size(F.array_except(clause_numbers(text), clause_numbers(source))) > 0
    )
    reason = F.when(F.size(lines) == 0, "empty").when(~F.length(text).between(5, 500), "bad_length").when(unknown, "unknown_citation").otherwise("ok")
    return F.struct(F.when(reason == "ok", text).alias("text"), reason.alias("reason"))


def condense(turns: DataFrame, turn: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(turn, text, reason, calls) of each turn (turn, query, history): the question rewritten to stand alone, or as it is.

    ask: (turn, message) to (turn, raw, finish), raw null where the call failed. Turns without a history aren't asked. An
    answer that is blank since it was cut off is asked for once more, and what comes then counts; nothing else is tried
    again, since the same call would fail the same way.
    """
    turns = keep(turns.select(turn, "query", "history"))
    asked = turns.filter(F.size("history") > 0)
    message = history_text(F.col("history"), F.col("query"))
    first = keep(ask(asked.select(turn, message.alias("message"))))
    cut = (F.coalesce(F.trim("raw"), F.lit("")) == "") & F.coalesce(F.col("finish") == "length", F.lit(False))
    again = asked.join(first.filter(cut).select(turn), turn, "left_semi")
    second = keep(ask(again.select(turn, message.alias("message")))).select(turn, F.col("raw").alias("raw2"), F.col("finish").alias("finish2"), F.lit(True).alias("twice"))
    both = turns.join(first.select(turn, "raw", "finish"), turn, "left").join(second, turn, "left")
    both = both.withColumn("raw", F.when(F.col("twice"), F.col("raw2")).otherwise(F.col("raw"))).withColumn("finish", F.when(F.col("twice"), F.col("finish2")).otherwise(F.col("finish")))
    checked = both.withColumn("c", check_rewrite(F.coalesce("raw", F.lit("")), F.col("query"), F.col("history")))
    reason = (
        F.when(F.coalesce(F.size("history"), F.lit(0)) <= 0, "no_history")
        .when(cut, "finish_length")
        .when(F.col("raw").isNull(), "call_failed")
        .otherwise(F.col("c.reason"))
    )
    calls = F.when(F.col("twice"), 2).when(reason == "no_history", 0).otherwise(1)
    out = checked.withColumn("reason", reason)
    return out.select(turn, F.when(F.col("reason") == "ok", F.col("c.text")).otherwise(F.col("query")).alias("text"), "reason", calls.alias("calls"))


def usage(prompt: Column, completion: Column, reasoning: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, reasoning_tokens) of what a provider says, whatever it calls it; null, not
    a struct of nulls, where it says nothing."""
    parts = (prompt.cast("long"), completion.cast("long"), reasoning.cast("long"))
    known = F.coalesce(*parts).isNotNull()
    return F.when(known, F.struct(*[p.alias(n) for p, n in zip(parts, ("prompt_tokens", "completion_tokens", "reasoning_tokens"))]))


def provider_usage(raw: Column) -> Column:
    """usage() of a provider's JSON, in either of the two shapes that clients give."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(raw, f"$.{p}") for p in paths])
    return usage(
        at("input_tokens", "prompt_tokens"),
        at("output_tokens", "completion_tokens"),
        at("output_token_details.reasoning", "completion_tokens_details.reasoning_tokens"),
    )


def store_retrievals(cache: DataFrame, found: DataFrame, key: str, ttl_s: int = RETRIEVAL_TTL) -> DataFrame:
    """The cache (key, value, expires_at in seconds) with the chunks found (key, value: an array, at): the newest of each
    key, for ttl_s seconds; an empty list is never kept, and doesn't take the place of one that is."""
    new = found.filter(F.size("value") > 0).select(key, "value", (F.col("at") + ttl_s).alias("expires_at"))
    return cache.select(key, "value", "expires_at").unionByName(new).groupBy(key).agg(F.max_by(F.struct("value", "expires_at"), "expires_at").alias("x")).select(key, "x.*")


def history_text(history: Column, query: Column) -> Column:
    """The message that asks for a rewrite."""
    lines = F.transform(history, lambda m: F.concat(F.when(m["role"] == "user", "Người dùng").otherwise("Trợ lý"), F.lit(": "), m["text"]))
    return F.concat(F.lit("Hội thoại trước:\n"), F.array_join(lines, "\n"), F.lit("\n\nCâu hỏi cuối: "), query)


def digest(query: Column) -> Column:
    return F.substring(F.sha2(query_key_text(query), 256), 1, 32)


def answer_key(query: Column, corpus: str, prompt: str, model: str) -> Column:
    return F.concat(F.lit(f"rag:ans:{corpus}:{prompt}:{model}:"), digest(query))


def retrieval_key(query: Column, corpus: str) -> Column:
    return F.concat(F.lit(f"rag:ret:{corpus}:"), digest(query))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, now: str) -> DataFrame:
    """Requests with the cached value that has not expired at their time; no hit gives null."""
    live = cache.select(key, "value", "expires_at")
    return requests.join(live, key, "left").withColumn("value", F.when(F.col("expires_at") > F.col(now), F.col("value"))).drop("expires_at")


def flush(cache: DataFrame, key: str, pattern: str) -> DataFrame:
    """The cache without keys that match a pattern with * and ?."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return cache.filter(~F.col(key).like(like))


def cacheable(error: Column, n_warnings: Column, cited: Column, referenced: Column, text: Column) -> Column:
    """Whether an answer may be kept: clean, and citing what it was given or saying that nothing was found."""
    return error.isNull() & (n_warnings == 0) & (F.coalesce(F.arrays_overlap(cited, referenced), F.lit(False)) | F.contains(text, F.lit("không tìm thấy")))


def single_flight(requests: DataFrame, key: str, ts: str, tie: str, ttl: int = 60) -> DataFrame:
    """Requests with leader: the first of a key leads for ttl seconds, those within follow it, the next one leads again.

    Leadership depends on earlier leadership, so it folds over the times of one key and minute-long idle stretches cut
    the fold: a request after a gap of ttl always leads.
    """
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    ordered = W.partitionBy(key).orderBy(ts, tie)
    rows = requests.withColumn("__s", seconds)
    gap = F.when(F.col("__s") - F.lag("__s").over(ordered) < ttl, 0).otherwise(1)
    rows = rows.withColumn("__g", gap).withColumn("__island", F.sum("__g").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    listed = rows.groupBy(key, "__island").agg(F.array_sort(F.collect_list(F.struct(F.col("__s").alias("s"), F.col(tie).alias("t")))).alias("r"))
    folded = F.aggregate(
        "r",
        F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(None).cast("bigint").alias("at")),
        lambda a, x: F.when(a["at"].isNull() | (x["s"] - a["at"] >= ttl), F.struct(F.concat(a["out"], F.array(x["t"].cast("bigint"))).alias("out"), x["s"].alias("at"))).otherwise(a),
    )["out"]
    return listed.select(key, F.explode(folded).alias(tie))


def replay_pieces(text: Column, words: int = 4) -> Column:
    """The text in pieces of so many words, white space kept: each piece takes the white space after its words."""
    return F.regexp_extract_all(text, F.lit(f"(\\s*(?:\\S+\\s*){{1,{words}}}|\\s+)"), F.lit(1))


def rate_limit(requests: DataFrame, user: str, ts: str, tie: str, limit: int) -> DataFrame:
    """Requests with n (their number in the user's minute), allowed, and retry_after: seconds to the next minute."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    minute = F.floor(seconds / 60)
    n = F.row_number().over(W.partitionBy(F.coalesce(user, F.lit("anonymous")), minute).orderBy(ts, tie))
    return requests.withColumn("n", n).withColumn("allowed", F.col("n") <= limit).withColumn("retry_after", F.when(F.col("n") > limit, 60 - seconds % 60))


def turn_trace(events: DataFrame, turn: str) -> DataFrame:
    """One row per turn of its events (type, seq, ts, text): first token time, text, last error, how it ended."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "text"))))
    return events.groupBy(turn).agg(
        F.min(F.when(F.col("type") == "token", F.col("ts"))).alias("first_token"),
        F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"),
        F.max_by("text", F.when(F.col("type") == "error", F.col("seq"))).alias("last_error"),
        F.count_if(F.col("type") == "done").alias("n_done"),
        (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).alias("seconds"),
    )


def histogram(values: DataFrame, value: str, by: list[str], buckets: tuple = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound, and all of them: one pass, one row per group before bounds are unfolded."""
    counted = values.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(buckets)], F.count(F.lit(1)).alias("total"))
    bounds = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(buckets)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return counted.select(*by, F.explode(bounds).alias("x")).select(*by, "x.*")


def sources_block(citations: DataFrame, key: str) -> DataFrame:
    """The list of sources under an answer: [n] breadcrumb — document, in order of n."""
    line = F.concat(F.lit("["), "n", F.lit("] "), "breadcrumb", F.lit(" — "), "source_document")
    ordered = F.array_sort(F.collect_list(F.struct("n", line.alias("t"))))
    return citations.groupBy(key).agg(F.concat(F.lit(SOURCES_MARK), F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")).alias("sources"))
