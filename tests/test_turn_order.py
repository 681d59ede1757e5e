"""Turns against a second-by-second account of one key, and on a stream of several micro-batches."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from lexmill.operators import turn_order

LIMITS = turn_order.Limits(lock=60, wait=45, answers=90, retrievals=200)
SCHEMA = "k long, turn long, asked long, took long, failed boolean, relevant boolean, keeps boolean"


def made(n, keys, every, seed):
    random.seed(seed)
    return [
        (random.randrange(keys) if turn % 50 else None, turn, random.randrange(every * n), random.choice([0, 5, 30, 59, 60, 61, 90]), random.random() < 0.3, random.random() < 0.8, random.random() < 0.4)
        for turn in range(n)
    ]


def account(rows, limits):
    """Each second: a flight that ends frees the lock, then whoever waits or comes is seen to in order."""
    fate, answer, lock, kept = {}, None, None, -1
    waiting = []
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    for now in range(rows[0][2], rows[-1][2] + limits.wait + limits.lock + 1):
        if lock and lock[0] == now:
            answer, lock = (now if lock[1] else answer), None
        waiting += [r for r in rows if r[2] == now]
        for r in list(waiting):
            _, turn, asked, took, failed, relevant, keeps = r
            if answer is not None and answer <= now < answer + limits.answers:
                fate[turn] = ("follower", "answer_hit", "answered", now)
            elif lock is None or now == asked + limits.wait:
                found = now < kept
                outcome = "answered" if found else "retrieval_error" if failed else "answered" if relevant else "no_context"
                if outcome == "answered" and not found:
                    kept = now + limits.retrievals
                fate[turn] = ("alone" if lock else "leader", "retrieval_hit" if found else "miss", outcome, now)
                if lock is None and outcome == "answered":
                    if took == 0:
                        answer = now if keeps else answer
                    else:
                        lock = (now + min(took, limits.lock), keeps and took <= limits.lock)
            else:
                continue
            waiting.remove(r)
    return fate


@pytest.mark.parametrize(("every", "seed"), [(3, 1), (15, 2), (60, 3)])
def test_turns_against_an_account_by_seconds(spark, every, seed):
    rows = made(300, 3, every, seed)
    got = {r.turn: (r.role, r.cache, r.outcome, r.decided) for r in turn_order.fates(spark.createDataFrame(rows, SCHEMA), "k", "turn", LIMITS).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        want |= account([r for r in rows if r[0] == k], LIMITS)
    assert got == want
    assert {x[0] for x in got.values()} == {"leader", "follower", "alone"} or every > 3


def test_no_turns(spark):
    assert turn_order.fates(spark.createDataFrame([], SCHEMA), "k", "turn", LIMITS).collect() == []


def test_guard_and_gate(spark):
    rows = spark.createDataFrame([(1, "unsafe", "x"), (2, "out_of_scope", "Xin chào!"), (3, "out_of_scope", "lương?"), (4, None, "x")], "turn int, v string, q string")
    allowed, refused = turn_order.guarded(rows, F.col("v"), F.col("q"))
    assert sorted(r.turn for r in allowed.collect()) == [3, 4] and sorted(r.turn for r in refused.collect()) == [1, 2]
    gate = spark.createDataFrame([(0, None), (5, None), (5, -7.0), (5, -6.8)], "n int, best double").select(turn_order.relevant(F.col("n"), F.col("best")).alias("r"))
    assert [r.r for r in gate.collect()] == [False, True, False, True]


def test_stream_over_several_batches(spark, tmp_path):
    """The stream agrees with the batch form; a row behind the watermark is dropped, and a key's state goes by its timer."""
    day = 1_704_067_200
    rows = sorted(((r[0] or 0, r[1], day + r[2], *r[3:]) for r in made(200, 3, 20, 9)), key=lambda r: (r[2], r[1]))
    one = lambda turn, s: [(0, turn, day + s, 10, False, True, True)]
    parts = [rows[:60], rows[60:130], rows[130:], one(900, 5), one(901, 90_000), one(902, 90_010)]
    schema = SCHEMA + ", ts timestamp"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).withColumn("ts", F.timestamp_seconds("asked")).coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"
        for n in range(len(parts)):
            for f in (tmp_path / "in" / f"p{n}").glob("*.parquet"):
                (tmp_path / "seen").mkdir(exist_ok=True)
                shutil.copy(f, tmp_path / "seen" / f"{n}-{f.name}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/seen")
            found = turn_order.stream_fates(stream, "k", "turn", "ts", "1 minute", LIMITS)
            found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.unset(provider)
    got = {r.turn: tuple(r)[2:] for r in spark.read.parquet(out).collect()}
    kept = rows + parts[4] + parts[5]
    want = {r.turn: tuple(r)[2:] for r in turn_order.fates(spark.createDataFrame(kept, SCHEMA), "k", "turn", LIMITS).collect()}
    assert 900 not in got and got == want and got[902][0] == "follower"
