"""Causes of errors: each error of a run may name a cause and a context, and these others, in circles too.

errors: run, id, name; edges: run, src, dst, kind (cause or context). Both walks are recursive queries that carry the way
they came, so a circle ends where it meets itself. A recursive query stops at a number of rows that the session sets
(spark.sql.cteRecursionRowLimit); whole tables of errors need it off, which is done here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of errors of transport, and of answers that don't mean what they should.
TRANSPORT = ("ConnectTimeout", "ConnectError", "ReadTimeout", "RemoteProtocolError")
SEMANTIC = ("OutputParserException", "ValidationError", "JSONDecodeError")


def _unbounded(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def roots(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """run, id, root, depth: from each start (run, id) along its cause, or where it names none, its context, to the last
    error that the way hasn't met."""
    _unbounded(edges)
    first = F.coalesce(F.min(F.when(F.col("kind") == "cause", F.col("dst"))), F.min("dst"))
    steps = edges.groupBy("run", "src").agg(first.alias("dst"))
    found = starts.sparkSession.sql(
        """WITH RECURSIVE way(run, id, root, path) AS (
             SELECT run, id, id, array(id) FROM {starts}
             UNION ALL
             SELECT w.run, w.id, s.dst, concat(w.path, array(s.dst)) FROM way w JOIN {steps} s ON s.run = w.run AND s.src = w.root
             WHERE NOT array_contains(w.path, s.dst))
           SELECT run, id, root, size(path) - 1 AS depth FROM way""",
        starts=starts,
        steps=steps,
    )
    return found.groupBy("run", "id").agg(F.max_by("root", "depth").alias("root"), F.max("depth").alias("depth"))


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """run, id, met: every error that a start leads to over causes and contexts, itself included, each once."""
    _unbounded(edges)
    every = edges.select("run", "src", "dst").distinct()
    found = starts.sparkSession.sql(
        """WITH RECURSIVE way(run, id, met, path) AS (
             SELECT run, id, id, array(id) FROM {starts}
             UNION ALL
             SELECT w.run, w.id, e.dst, concat(w.path, array(e.dst)) FROM way w JOIN {every} e ON e.run = w.run AND e.src = w.met
             WHERE NOT array_contains(w.path, e.dst))
           SELECT run, id, met FROM way""",
        starts=starts,
        every=every,
    )
    return found.distinct()


def describe(errors: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """run, id, root (its id), root_name, depth, n_errors, transport and semantic (whether any error reached is of that
    class), and trace: the distinct names that were reached, in order, and no message."""
    name = errors.select("run", F.col("id").alias("met"), "name")
    any_of: Column = lambda names: F.bool_or(F.col("name").isin(*names))
    about = reached(starts, edges).join(name, ["run", "met"]).groupBy("run", "id").agg(
        F.count(F.lit(1)).alias("n_errors"), any_of(TRANSPORT).alias("transport"), any_of(SEMANTIC).alias("semantic"),
        F.array_join(F.array_sort(F.collect_set("name")), " < ").alias("trace"),
    )
    rooted = roots(starts, edges).join(name.select("run", F.col("met").alias("root"), F.col("name").alias("root_name")), ["run", "root"])
    return rooted.join(about, ["run", "id"])
