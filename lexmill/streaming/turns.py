"""Structured Streaming forms of the event operators: minute limits, single flight, turn folding, a cache with expiry.

Each takes and returns a streaming DataFrame; state is bounded by watermarks or time-outs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_counts(events: DataFrame, user: str, ts: str, limit: int, delay: str = "2 minutes") -> DataFrame:
    """user, start and n of each user's minutes, with over: how many requests lie over the limit. Rows later than the
    delay are dropped."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, "1 minute"), F.coalesce(user, F.lit("anonymous")).alias("user")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user", F.col("window.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))


def leaders(requests: DataFrame, key: str, ts: str, tie: str, ttl_s: int = 60) -> DataFrame:
    """(key, tie) of the requests that lead: the first of a key, and the first whose second is ttl_s or more after the
    leader's before it, when that one's lock has expired. A key's requests in one batch of the stream are sorted together;
    the state holds one second per key, and goes when the watermark has passed the lock."""
    kinds = dict(requests.dtypes)

    def lead(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since = state.get[0] if state.exists else None
        out = []
        rows = pd.concat([pdf[[ts, tie]] for pdf in batches]).sort_values([ts, tie], kind="stable")
        for t, x in rows.itertuples(index=False):
            second = int(t.timestamp() // 1)
            if since is None or second - since >= ttl_s:
                since = second
                out.append((k[0], x))
        state.update((since,))
        state.setTimeoutTimestamp(max(since * 1000, state.getCurrentWatermarkMs()) + ttl_s * 1000)
        yield pd.DataFrame(out, columns=[key, tie])

    return requests.withWatermark(ts, f"{ttl_s} seconds").groupBy(key).applyInPandasWithState(
        lead, f"{key} {kinds[key]}, {tie} {kinds[tie]}", "since long", "append", GroupStateTimeout.EventTimeTimeout
    )


def fold_turns(events: DataFrame, turn: str, idle: str = "10 minutes") -> DataFrame:
    """One row per turn when its done event comes, or when the watermark has passed it by so much: text in order of seq, whether it was done,
    and how many events it had. events: turn, seq, ts, type, text."""
    kind = dict(events.dtypes)[turn]
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seqs, texts, n = state.get
            state.remove()
            yield _row(turn, key[0], seqs, texts, n, False)
            return
        seqs, texts, n = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        done, newest = False, 0
        for pdf in batches:
            n += len(pdf)
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
            done |= bool((pdf["type"] == "done").any())
            tokens = pdf[pdf["type"] == "token"]
            seqs += [int(x) for x in tokens["seq"]]
            texts += tokens["text"].tolist()
        if done:
            if state.exists:
                state.remove()
            yield _row(turn, key[0], seqs, texts, n, True)
        else:
            state.update((seqs, texts, n))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ms)

    return events.withWatermark("ts", idle).groupBy(turn).applyInPandasWithState(
        fold, f"{turn} {kind}, text string, n_events long, done boolean", "seqs array<long>, texts array<string>, n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def _row(turn: str, key, seqs: list[int], texts: list[str], n: int, done: bool) -> pd.DataFrame:
    ordered = [t for _, t in sorted(zip(seqs, texts))]
    return pd.DataFrame({turn: [key], "text": ["".join(ordered)], "n_events": [n], "done": [done]})


def cached_answers(requests: DataFrame, key: str, ts: str, ttl_s: int) -> DataFrame:
    """Requests (key, ts, value; null value: a lookup) answered from keyed state: hit is the value stored last, if it is
    younger than ttl_s at the request's time. The chunks of a key come in no order of time, so all of a key's requests in
    one batch of the stream are sorted together; the state holds one value per key."""
    kind = dict(requests.dtypes)[key]

    def answer(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        out = []
        rows = pd.concat([pdf[[ts, "value"]] for pdf in batches]).sort_values(ts, kind="stable")
        for t, v in rows.itertuples(index=False):
            s = t.timestamp()
            if pd.isna(v):
                out.append((k[0], t, held[0] if held and 0 <= s - held[1] < ttl_s else None))
            elif held is None or s >= held[1]:
                held = (v, s)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(int(held[1] * 1000), state.getCurrentWatermarkMs()) + ttl_s * 1000)
        yield pd.DataFrame(out, columns=[key, ts, "hit"])

    return requests.withWatermark(ts, f"{ttl_s} seconds").groupBy(key).applyInPandasWithState(
        answer, f"{key} {kind}, {ts} timestamp, hit string", "value string, at double", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_table(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and returns the rows it appended, from a table beside the checkpoint."""
    path = f"{checkpoint}-rows"
    files = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    files.trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
