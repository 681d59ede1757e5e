"""The stages of an evaluation over a test set: hypothetical answers, vectors, retrieval, answers, three kinds of scores.

Outside models are plugs; the defaults are deterministic stand-ins without a model, so scores say how a run went, not how
good a model is. Records are (case_id, ..., error); a stage that has nothing to work on records why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.operators import models, reporting, verification
from lexmill.operators.ranking import global_row_number
from lexmill.operators.runs import Stage
from lexmill.sources.shared import keep

#: Questions (query_id, text, hypothetical) to hits (query_id, chunk_id, breadcrumb, content, raw_table, score, pos).
Retriever = Callable[[DataFrame], DataFrame]
KEY = "case_id"


def none() -> Column:
    return F.lit(None).cast("string").alias("error")


def overlap(a: Column, b: Column) -> Column:
    """Share of the tokens of a that b has, null where a has none; a stand-in for a judge."""
    wanted = F.array_distinct(tokens(a))
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens(b))) / F.size(wanted))


def stages(retrieve: Retriever, plugs: models.Plugs | None = None) -> list[Stage]:
    plugs = plugs or models.Plugs()

    def hyde(cases: DataFrame, _: dict) -> DataFrame:
        return cases.select(KEY, F.concat(F.lit("Trả lời: "), "user_input").alias("hypothetical"), none())

    def embed(cases: DataFrame, good: dict) -> DataFrame:
        made = cases.select(KEY).join(good["hyde"], KEY)
        return made.select(KEY, plugs.encoder(F.col("hypothetical")).alias("vec"), none())

    def retrieved(cases: DataFrame, good: dict) -> DataFrame:
        numbered = keep(global_row_number(cases.join(good["hyde"].select(KEY, "hypothetical"), KEY), [KEY], "query_id"))  # retrievers take numbers
        hits = retrieve(numbered.select("query_id", F.col("user_input").alias("text"), "hypothetical")).join(numbered.select("query_id", KEY), "query_id")
        listed = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "content")))
        per = hits.groupBy(KEY).agg(listed.alias("hits"), F.bool_or(F.col("score").isNull()).alias("unscored"))
        found = cases.select(KEY).join(per, KEY, "left")
        error = F.when(F.col("hits").isNull(), "no_context").when(F.col("unscored"), "rerank_fallback")
        return found.select(KEY, F.transform("hits", lambda h: h["chunk_id"]).alias("chunk_ids"), F.transform("hits", lambda h: h["content"]).alias("contexts"), error.alias("error"))

    def generate(cases: DataFrame, good: dict) -> DataFrame:
        made = cases.select(KEY).join(good["retrieve"], KEY)
        return made.select(KEY, F.concat(F.get("contexts", F.lit(0)), F.lit(" [1]")).alias("answer"), none())

    def scored(name: str, score: Column, *needs: str) -> Stage:
        def work(cases: DataFrame, good: dict) -> DataFrame:
            rows = cases
            for need in needs:
                rows = rows.join(good[need].drop("error"), KEY)
            value = reporting.finite(score)
            return rows.select(KEY, value.alias("score"), F.when(value.isNull(), "no_score").alias("error"))

        return Stage(name, needs, f"{KEY} string, score double, error string", work)

    context = F.array_join("contexts", "\n")
    verdicts = F.transform("contexts", lambda c: (F.coalesce(overlap(F.col("reference"), c), F.lit(0.0)) > 0.5).cast("int"))
    cites = F.size(verification.cited(F.col("answer"))) > 0
    return [
        Stage("hyde", (), f"{KEY} string, hypothetical string, error string", hyde),
        Stage("embed", ("hyde",), f"{KEY} string, vec array<double>, error string", embed),
        Stage("retrieve", ("hyde",), f"{KEY} string, chunk_ids array<string>, contexts array<string>, error string", retrieved),
        Stage("generate", ("retrieve",), f"{KEY} string, answer string, error string", generate),
        scored("score-recall", overlap(F.col("reference"), context), "retrieve"),
        scored("score-answers", F.when(cites, overlap(F.col("reference"), F.col("answer"))), "generate"),
        scored("score-precision", reporting.average_precision(verdicts), "retrieve"),
    ]


def report(run) -> DataFrame:
    """metric, dimension, value, mean, n, n_null of the scores, overall and by kind of question and source."""
    out = None
    for name in ("score-recall", "score-answers", "score-precision"):
        rows = run.cases.select(KEY, "synthesizer_name", "source_document").join(run.records(name).select(KEY, "score"), KEY, "left")
        one = reporting.slices(rows, ["synthesizer_name", "source_document"], *reporting.mean_columns("score")).select(F.lit(name).alias("metric"), "*")
        out = one if out is None else out.unionByName(one)
    return out
