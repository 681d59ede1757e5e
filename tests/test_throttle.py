"""Admissions and limiters against simulations that go second by second."""

import random

from lexmill.operators import throttle


def ticks(calls, max_running, max_waiting):
    """(decision, start) by key, one second after another: places that end are free first, then calls come in order."""
    out, running, waiting, left = {}, [], [], sorted(calls)
    for now in range(5000):
        running = [end for end in running if end > now]
        while waiting and len(running) < max_running:
            key, length = waiting.pop(0)
            out[key] = ("wait", float(now))
            running.append(now + length)
        while left and left[0][0] == now:
            _, key, length = left.pop(0)
            if len(running) < max_running:
                out[key] = ("run", float(now))
                running.append(now + length)
            elif len(waiting) < max_waiting:
                waiting.append((key, length))
            else:
                out[key] = ("reject", None)
    assert not waiting and not left
    return out


def test_admissions_against_ticks(spark):
    random.seed(9)
    for size in (50, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        calls = {b: [(random.randint(0, 600), 1000 * b + k, random.randint(1, 60)) for k in range(n)] for b, n in ((0, 80), (1, 3), (2, 150))}
        df = spark.createDataFrame([(b, k, s, d) for b, found in calls.items() for s, k, d in found], "b int, k long, s long, d long")
        got = {r.k: (r.decision, r.start) for r in throttle.admissions(df, "b", "s", "d", "k").collect()}
        want = {k: x for found in calls.values() for k, x in ticks(found, 2, 6).items()}
        assert got == want and {x for x, _ in want.values()} == {"run", "wait", "reject"}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_rejected_call_takes_no_place(spark):
    rows = [("b", k, 0, 10) for k in range(9)] + [("b", 9, 100, 1)]
    got = [tuple(r)[1:] for r in sorted(throttle.admissions(spark.createDataFrame(rows, "b string, k long, s long, d long"), "b", "s", "d", "k").collect(), key=lambda r: r.k)]
    assert [d for _, d, _ in got] == ["run"] * 2 + ["wait"] * 6 + ["reject", "run"]
    assert [s for _, _, s in got] == [0, 0, 10, 10, 20, 20, 30, 30, None, 100]
