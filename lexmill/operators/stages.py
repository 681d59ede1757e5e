"""Stages of a run over many cases: what is still to do, prompts, batches of texts, marks of what went wrong, embedding in
two phases, and the interfaces that outside code implements.

A stage keeps its results as a log of records (keys, error, ...). It works on the cases that the log doesn't have, appends
what it made, and is summed up from the log alone, so a run that breaks off goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.models import BATCH, DIMENSION
from lexmill.operators.ranking import global_row_number
from lexmill.operators.reporting import stage_summary
from lexmill.sources import files, snapshots

#: What a user message and a repair message are made of; the wording of the instructions is the caller's.
USER = "Ngữ cảnh:\n%s\n\nCâu hỏi: %s"
REPAIR = USER + "\n\nBản nháp:\n%s\n\nLỗi cần sửa:\n%s"


class Retriever(Protocol):
    """Questions (query_id, text, hypothetical) to hits (query_id, chunk_id, breadcrumb, content, raw_table, score, pos)."""

    def __call__(self, questions: DataFrame) -> DataFrame: ...


class BatchScorer(Protocol):
    """Scores of a batch of samples under the named metrics: one mapping per sample, null or NaN where there is none."""

    def __call__(self, rows: list[dict], names: list[str]) -> list[dict[str, float | None]]: ...


class UnitRunner(Protocol):
    """Rows of questions for one unit: (unit key, title, text, how many of each kind) to a list of records."""

    def __call__(self, unit_key: str, title: str, text: str, wanted: dict[str, int]) -> list[dict]: ...


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: str, context: Column, query: Column) -> Column:
    """array of struct(role, content): the system message and the question with its context."""
    return F.array(_message("system", F.lit(system)), _message("user", F.format_string(USER, context, query)))


def repair_messages(system: str, context: Column, query: Column, draft: Column, issues: Column) -> Column:
    """The same for a draft that is written anew; issues: array of structs, one line of JSON each."""
    lines = F.array_join(F.transform(issues, lambda x: F.to_json(x)), "\n")
    return F.array(_message("system", F.lit(system)), _message("user", F.format_string(REPAIR, context, query, draft, lines)))


def to_do(cases: DataFrame, log: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """The cases without a record, and those whose record is an error if these are to be tried again."""
    settled = log.filter("error IS NULL") if retry_failed else log
    return cases.join(settled.select(*keys).distinct(), keys, "left_anti")


def run_stage(
    cases: DataFrame, path: str, schema: str, keys: list[str], work: Callable[[DataFrame], DataFrame], upstream: DataFrame | None = None, retry_failed: bool = False
) -> DataFrame:
    """Runs work over the cases that are to do and whose upstream record is there without an error, appends its records
    (schema, with keys and error) to the log at path, and returns the summary of the stage, one row."""
    spark = cases.sparkSession
    empty = spark.createDataFrame([], schema)
    read = lambda: files.read_log(spark, path, schema, keys) if files.present(spark, path) else empty
    ready = None if upstream is None else upstream.filter("error IS NULL").select(*keys).distinct()
    wanted = to_do(cases, read(), keys, retry_failed)
    made = work(wanted if ready is None else wanted.join(ready, keys, "left_semi"))
    files.append_log(made.select(*empty.columns), path)
    return stage_summary(cases, read(), keys, ready)


def packed(jobs: DataFrame, key: str, texts: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, vectors, error) of jobs with a few texts each, in batches of BATCH texts at most; a job is never cut. A batch
    that fails, or has another number of vectors than texts, gives its jobs the error's name."""
    kind = dict(jobs.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(batch: list[tuple]) -> pd.DataFrame:
            flat = [t for _, found in batch for t in found]
            try:
                vectors, error = [[float(x) for x in v] for v in embed(flat)], None
                if len(vectors) != len(flat):
                    raise ValueError("wrong number of vectors")
            except Exception as e:  # noqa: BLE001  a client may fail in any way
                vectors, error = None, type(e).__name__
            out, at = [], 0
            for k, found in batch:
                out.append((k, None if vectors is None else vectors[at : at + len(found)], error))
                at += len(found)
            return pd.DataFrame(out, columns=[key, "vectors", "error"])

        batch, size = [], 0
        for pdf in parts:
            for k, found in zip(pdf[key], pdf[texts]):
                if batch and size + len(found) > BATCH:
                    yield close(batch)
                    batch, size = [], 0
                batch.append((k, list(found)))
                size += len(found)
        if batch:
            yield close(batch)

    return jobs.select(key, texts).mapInPandas(run, f"{key} {kind}, vectors array<array<double>>, error string")


def retrieval_marks(cases: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """(key, n, error): no_context where a case has no hit, rerank_fallback where a hit has no score."""
    found = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("score").isNull()).alias("unscored"))
    error = F.when(F.col("n").isNull(), "no_context").when(F.col("unscored"), "rerank_fallback")
    return cases.select(key).join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), error.alias("error"))


def faithfulness(supported: Column) -> Column:
    """Share of an answer's statements that its context supports; null without a statement. supported: array of 0 and 1."""
    return F.when(F.size(supported) > 0, F.aggregate(supported, F.lit(0.0), lambda s, x: s + x) / F.size(supported))


def embed_summary(embedded: DataFrame, key: str) -> DataFrame:
    """One row: chunks, those embedded, those skipped, and the ids of the skipped in order."""
    skipped = F.col("vec").isNull()
    return embedded.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~skipped).alias("embedded"), F.count_if(skipped).alias("skipped"),
        F.array_sort(F.collect_list(F.when(skipped, F.col(key)))).alias("skipped_ids"),
    )


def checkpoint_embeddings(embedded: DataFrame, folder: str, source: str = "source_document") -> None:
    """The first phase: embedded chunks, skipped ones left out, one folder per source; sources that come again replace
    theirs and no others."""
    rows = embedded.filter("vec IS NOT NULL")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(folder)


def checkpoint_plan(spark: SparkSession, chunks: str, checkpoints: str) -> DataFrame:
    """position, source and target of each JSON file right in a folder of chunks, in the order of the lower-cased name;
    the target has the same place below the folder of checkpoints. None where the folder is missing."""
    if not files.present(spark, chunks):
        return spark.createDataFrame([], "position long, source string, target string")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(chunks).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    numbered = global_row_number(listed.withColumn("name", name), [F.lower("name"), "name"], "position", 1)
    return numbered.select("position", F.col("path").alias("source"), F.concat(F.lit(checkpoints.rstrip("/") + "/"), "name").alias("target"))


def refresh_index(spark: SparkSession, folder: str, index: str, dimension: int = DIMENSION) -> int:
    """The second phase: the whole index from all checkpoints, none of it if one vector has another dimension. Returns how
    many vectors it holds; nothing happens where there is no checkpoint."""
    if not files.present(spark, folder):
        return 0
    rows = spark.read.parquet(folder)
    wrong = F.when(F.size("vec") != dimension, F.raise_error(F.lit(f"a vector has another dimension than {dimension}")).cast("array<double>"))
    files.write_swapped(rows.withColumn("vec", F.coalesce(wrong, F.col("vec"))), index)
    return files.read_swapped(spark, index).count()


def refresh_snapshot(spark: SparkSession, folder: str, index: str, dimension: int = DIMENSION) -> int:
    """refresh_index() into the snapshots of an index: vectors change in the same step as the tables beside them, and
    readers of an older snapshot keep theirs."""
    if not files.present(spark, folder):
        return 0
    rows = spark.read.parquet(folder)
    wrong = F.when(F.size("vec") != dimension, F.raise_error(F.lit(f"a vector has another dimension than {dimension}")).cast("array<double>"))
    made = snapshots.commit(spark, index, {"vectors": rows.withColumn("vec", F.coalesce(wrong, F.col("vec")))}, {"dimension": dimension})
    return made.read(spark, "vectors").count()


def check_scope(only: list[str], append: bool = False, retry_skipped: bool = False) -> None:
    """Runs that repeat finished or skipped units must name their units."""
    for flag, given in (("append", append), ("retry_skipped", retry_skipped)):
        if given and not only:
            raise ValueError(f"{flag} needs the units that it is for")


def quota_units(every: DataFrame, selected: DataFrame, size: int | None) -> DataFrame:
    """The units that questions are dealt over: all, so that runs in parts agree with one run, unless a size is given for
    the selected ones."""
    return every if size is None else selected
