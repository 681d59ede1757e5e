"""Evaluation records: logs whose last line wins, finite scores, slices, paired comparison, answer groups, operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The record with the greatest seq of each key: one aggregate, no sort."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*keys, "r.*")


def finite(score: Column) -> Column:
    """The score, null where it is not a finite number."""
    return F.when(~F.isnan(score) & (F.abs(score) != float("inf")), score)


def score_error(score: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), error).when(score.isNotNull() & finite(score).isNull(), F.lit("non_finite_score"))


def slices(df: DataFrame, dimensions: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates overall and by each dimension alone, with (dimension, value); null and empty values are unknown."""
    named = df.withColumns({c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "unknown").otherwise(F.col(c)) for c in dimensions})
    sets = [[F.col(c)] for c in dimensions] + [[]]
    grouped = named.groupingSets(sets, *[F.col(c) for c in dimensions]).agg(*aggregates, *[F.grouping(c).alias(f"__{c}") for c in dimensions])
    dimension, value = F.lit("overall"), F.lit("all")
    for c in dimensions:
        dimension = F.when(F.col(f"__{c}") == 0, F.lit(c)).otherwise(dimension)
        value = F.when(F.col(f"__{c}") == 0, F.col(c)).otherwise(value)
    kept = [c for c in grouped.columns if c not in dimensions and not c.startswith("__")]
    return grouped.select(dimension.alias("dimension"), value.alias("value"), *kept)


def mean_columns(score: str) -> list[Column]:
    """Mean of the finite values, how many there are, and how many are missing."""
    value = finite(F.col(score))
    return [
        F.round(F.avg(value), 6).alias("mean"),
        F.count(value).alias("n"),
        F.count_if(value.isNull()).alias("n_null"),
    ]


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row over the cases that both sides scored without error: means, wins, losses, ties, identical contexts; and
    how many cases fell out. Both sides: key, score, error, context (array of ids in order)."""
    a = left.select(key, finite(F.col("score")).alias("a"), F.col("error").alias("ea"), F.col("context").alias("ca"))
    b = right.select(key, finite(F.col("score")).alias("b"), F.col("error").alias("eb"), F.col("context").alias("cb"))
    both = a.join(b, key, "full")
    good = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("ea").isNull() & F.col("eb").isNull()
    return both.agg(
        F.count_if(good).alias("paired"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("excluded"),
        F.round(F.avg(F.when(good, F.col("a"))), 6).alias("mean_left"),
        F.round(F.avg(F.when(good, F.col("b"))), 6).alias("mean_right"),
        F.count_if(good & (F.col("a") > F.col("b"))).alias("wins"),
        F.count_if(good & (F.col("a") < F.col("b"))).alias("losses"),
        F.count_if(good & (F.col("a") == F.col("b"))).alias("ties"),
        F.count_if(good & (F.col("ca") == F.col("cb"))).alias("identical"),
    )


OUTCOMES = ("answered", "insufficient_evidence", "unable_to_verify", "error")


def answer_group(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Outcome counts and rates, and the mean score of answered cases and end to end, where a refusal counts 0 and an
    error is left out. answers: outcome, repair_used, score."""
    outcome, value = F.col("outcome"), finite(F.col("score"))
    refused = outcome.isin("insufficient_evidence", "unable_to_verify")
    end_to_end = F.when(refused, F.lit(0.0)).when(outcome == "answered", value)
    n = F.count(F.lit(1))
    return answers.groupBy(*(by or [])).agg(
        n.alias("n_cases"),
        *[F.count_if(outcome == o).alias(f"n_{o}") for o in OUTCOMES],
        F.round(F.count_if(refused) / n, 6).alias("refusal_rate"),
        F.round(F.count_if(F.col("repair_used")) / n, 6).alias("repair_rate"),
        F.round(F.avg(F.when(outcome == "answered", value)), 6).alias("mean_answered"),
        F.count_if((outcome == "answered") & value.isNull()).alias("n_null"),
        F.round(F.avg(end_to_end), 6).alias("mean_end_to_end"),
        F.count(end_to_end).alias("n_end_to_end"),
    )


def stage_summary(cases: DataFrame, latest: DataFrame, keys: list[str], upstream: DataFrame | None = None) -> DataFrame:
    """One row: done, errors, pending and missing upstream over the wanted keys."""
    joined = cases.select(*keys).join(latest.select(*keys, "error", F.lit(True).alias("__here")), keys, "left")
    if upstream is not None:
        joined = joined.join(upstream.select(*keys, F.lit(True).alias("__up")), keys, "left")
    else:
        joined = joined.withColumn("__up", F.lit(True))
    here, up = F.col("__here").isNotNull(), F.col("__up").isNotNull()
    return joined.agg(
        F.count_if(here & F.col("error").isNull()).alias("done"),
        F.count_if(here & F.col("error").isNotNull()).alias("errors"),
        F.count_if(~here & up).alias("pending"),
        F.count_if(~here & ~up).alias("missing_upstream"),
    )


def reusable_scores(retrievals: DataFrame, case: str, config: str, context: str) -> DataFrame:
    """Each (case, config) with the smallest config of the case whose ordered context is equal: scored once, reused by
    the others."""
    first = retrievals.groupBy(case, context).agg(F.min(config).alias("evaluate"))
    return retrievals.join(first, [case, context]).select(
        case, config, F.when(F.col("evaluate") != F.col(config), F.col("evaluate")).alias("reused_from")
    )


def average_precision(verdicts: Column) -> Column:
    """Mean over the relevant ranks of precision at that rank; 0 without any. verdicts: array of 0 and 1 in rank order."""
    upto = F.transform(verdicts, lambda v, k: F.struct(v.alias("v"), (k + 1).alias("k")))
    folded = F.aggregate(
        upto,
        F.struct(F.lit(0).cast("long").alias("hits"), F.lit(0.0).alias("sum")),
        lambda s, x: F.struct(
            (s["hits"] + x["v"]).cast("long").alias("hits"),
            (s["sum"] + F.when(x["v"] == 1, (s["hits"] + 1) / x["k"]).otherwise(F.lit(0.0))).alias("sum"),
        ),
    )
    return F.when(folded["hits"] > 0, folded["sum"] / folded["hits"]).otherwise(F.lit(0.0))
