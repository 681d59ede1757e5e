"""Spans and counts agree with what the queries give, and a sink that is missing or fails changes nothing."""

import time

import pytest
from pyspark.sql import functions as F

from lexmill.streaming import observe


def test_counts_of_a_batch(spark):
    df, seen = observe.watched(spark.range(100), "passing", even=F.count_if(F.col("id") % 2 == 0), last=F.max("id"))
    assert df.filter("id < 10").count() == 10
    assert seen.get == {"rows": 100, "even": 50, "last": 99}


def test_spans_of_steps():
    spans = []
    with observe.span("step", spans.append, unit="u") as found:
        found["n"] = 3
    with pytest.raises(KeyError), observe.span("bad", spans.append):
        raise KeyError("content")
    assert [(s["span"], s["error"], s.get("n")) for s in spans] == [("step", None, 3), ("bad", "KeyError", None)] and "content" not in str(spans)

    def broken(_):
        raise RuntimeError

    for sink in (None, broken):
        with observe.span("quiet", sink) as found:
            found["n"] = 1


def test_spans_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10 + k).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    spans = []
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    out = observe.watched_stream(stream, "passing", odd=F.count_if(F.col("id") % 2 == 1))

    def run(n):
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start(f"{tmp_path}/out{n}").awaitTermination()

    with observe.listening(spark, spans.append):
        run(0)
        until = time.time() + 20
        while time.time() < until and not any(s["span"] == "query_ended" for s in spans):
            time.sleep(0.2)
    batches = [s for s in spans if s["span"] == "batch" and s["rows_in"]]
    got = spark.read.parquet(f"{tmp_path}/out0")
    assert len(batches) == 3 and sum(s["rows_in"] for s in batches) == got.count() == 33
    assert sum(s["observed"]["passing"]["odd"] for s in batches) == got.filter("id % 2 = 1").count()
    n = len(spans)
    with observe.listening(spark, None):
        run(1)
    time.sleep(1)
    assert len(spans) == n
