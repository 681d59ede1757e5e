"""Budgets over time: sliding loads, admissions with delays, estimates, round robin, classes of provider errors."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW_S, SHARE = 60, 0.9
RETRY_DEFAULT, RETRY_MIN, RETRY_MAX, DAILY_S = 15.0, 1.0, 60.0, 300.0


def sliding_load(events: DataFrame, bucket: str, second: str, tokens: str) -> DataFrame:
    """Events with the requests and tokens of their bucket in the window that ends with them; an entry of exactly the
    window's age has left it."""
    recent = W.partitionBy(bucket).orderBy(second).rangeBetween(-(WINDOW_S - 1), 0)
    return events.withColumn("n_requests", F.count(F.lit(1)).over(recent)).withColumn("n_tokens", F.sum(tokens).over(recent))


def estimate(chars: Column, per_token: float, completion: int) -> Column:
    return (F.ceil(chars / per_token) + completion).cast("long")


def settled(actual: Column, estimated: Column) -> Column:
    return F.coalesce(actual, estimated)


def bucket_id(model: str, key: Column) -> Column:
    return F.concat(F.lit(model + ":"), F.substring(F.sha2(key, 256), 1, 8))


def delays(events: DataFrame, bucket: str, second: str, tokens: str, tie: str, max_tokens: int, max_requests: int) -> DataFrame:
    """(bucket, tie, start): when each request may start, first come first served within both budgets.

    Each start depends on those before, so a bucket's requests are a fold; it streams over Arrow batches of rows sorted
    by bucket and time and keeps only the window's entries, so no bucket is gathered.
    """
    token_cap, request_cap = int(max_tokens * SHARE), int(max_requests * SHARE)
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, int]] = []
        current, clock = None, 0.0
        for pdf in batches:
            out = []
            for b, t, s, n in zip(pdf[bucket], pdf[tie], pdf[second], pdf[tokens]):
                if b != current:
                    current, held, clock = b, [], float("-inf")
                n = min(int(n), token_cap)
                now = max(float(s), clock)
                held = [h for h in held if now - h[0] < WINDOW_S]
                while held and (len(held) + 1 > request_cap or sum(x for _, x in held) + n > token_cap):
                    now = held[0][0] + WINDOW_S
                    held = [h for h in held if now - h[0] < WINDOW_S]
                held.append((now, n))
                clock = now
                out.append((b, t, now))
            yield pd.DataFrame(out, columns=[bucket, tie, "start"])

    rows = events.select(bucket, tie, second, tokens).repartition(bucket).sortWithinPartitions(bucket, second, tie)
    return rows.mapInPandas(run, f"{bucket} {kinds[bucket]}, {tie} {kinds[tie]}, start double")


def admission_load(spans: DataFrame, start: str, end: str, key: str) -> DataFrame:
    """(key, ts, running): how many spans of a key run at each of its starts and ends, ends first at equal times."""
    marks = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("ts"), F.lit(1).alias("d")), F.struct(F.col(end).alias("ts"), F.lit(-1).alias("d")))).alias("m")).select(key, "m.*")
    per_time = marks.groupBy(key, "ts").agg(F.sum("d").alias("d"))
    return per_time.select(key, "ts", F.sum("d").over(W.partitionBy(key).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)).alias("running"))


def admissions(calls: DataFrame, bucket: str, second: str, duration: str, tie: str, max_running: int = 2, max_waiting: int = 6) -> DataFrame:
    """(bucket, tie, decision, start) of calls in order of time: a call runs where a place is free, waits its turn where
    fewer than max_waiting wait, and is rejected elsewhere. A rejected call takes no place; a call that waits starts when
    the first running one ends, and places that end at a call's second are free.

    What a call meets depends on all before it, so a bucket is a fold; it streams over sorted rows and holds no more than
    the calls that run and wait.
    """
    kinds = dict(calls.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: list[float] = []
        waiting: deque[tuple[object, float]] = deque()
        current, out = None, []

        def free(now: float) -> None:
            while ends and ends[0] <= now:
                end = heapq.heappop(ends)
                if waiting:
                    key, length = waiting.popleft()
                    heapq.heappush(ends, end + length)
                    out.append((current, key, "wait", end))

        for pdf in batches:
            for b, key, s, d in zip(pdf[bucket], pdf[tie], pdf[second], pdf[duration]):
                if b != current:
                    free(float("inf"))
                    current = b
                    ends.clear()
                free(float(s))
                if len(ends) < max_running:
                    heapq.heappush(ends, float(s) + float(d))
                    out.append((b, key, "run", float(s)))
                elif len(waiting) < max_waiting:
                    waiting.append((key, float(d)))
                else:
                    out.append((b, key, "reject", None))
            yield pd.DataFrame(out, columns=[bucket, tie, "decision", "start"])
            out.clear()
        free(float("inf"))
        yield pd.DataFrame(out, columns=[bucket, tie, "decision", "start"])

    rows = calls.select(bucket, tie, second, duration).repartition(bucket).sortWithinPartitions(bucket, second, tie)
    return rows.mapInPandas(run, f"{bucket} {kinds[bucket]}, {tie} {kinds[tie]}, decision string, start double")


def round_robin(calls: Column, n: int) -> Column:
    """The client of a call by its number."""
    return F.pmod(calls, F.lit(n))


def is_daily_limit(message: Column) -> Column:
    return F.lower(message).rlike("per day|\\(tpd\\)|\\(rpd\\)")


def retry_after(value: Column) -> Column:
    """Seconds to wait from a header: missing or not a finite number is the default, others are clamped."""
    x = F.expr("NULL").cast("double") if value is None else value.try_cast("double")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(fine, F.least(F.greatest(x, F.lit(RETRY_MIN)), F.lit(RETRY_MAX))).otherwise(F.lit(RETRY_DEFAULT))


def error_class(kind: Column, status: Column, message: Column) -> Column:
    return (
        F.when((status == 429) & is_daily_limit(message), "daily_limit")
        .when(status == 429, "minute_limit")
        .when(kind.isin("connection", "timeout") | (status == 498) | status.between(500, 599), "transient")
        .when(status.isin(401, 403), "auth")
        .otherwise("other")
    )


def cooldown(error: Column, header: Column) -> Column:
    return F.when(error == "daily_limit", F.lit(DAILY_S)).when(error == "minute_limit", retry_after(header))


def token_totals(usage: DataFrame, client: str, seq: str, mark: int) -> DataFrame:
    """Totals per client before a mark and after it, and their difference."""
    total = usage.groupBy(client).agg(
        F.sum(F.when(F.col(seq) <= mark, F.col("tokens")).otherwise(0)).alias("before"), F.sum("tokens").alias("after")
    )
    return total.withColumn("delta", F.col("after") - F.col("before"))
