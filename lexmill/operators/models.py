"""Where outside models plug in: encoders, segmenters, token counters, scorers, generators.

A plug is a function of columns. The defaults here are deterministic stand-ins that need no model; their names say so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import let, tokens, word_count
from lexmill.operators.ranking import global_row_number
from lexmill.sources.shared import keep

BATCH, ATTEMPTS, DIMENSION = 25, 3, 64


def standin_encoder(text: Column, dimension: int = DIMENSION) -> Column:
    """Feature hashing of tokens to an array of doubles of length one, zeros where there is no token; no model."""

    def counted(places: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))

    def scaled(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return let(length, lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)).otherwise(counts))

    places = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int"))
    return let(let(places, counted), scaled)


def standin_scorer(query: Column, passage: Column) -> Column:
    """Share of the query's tokens that the passage has, on the scale of a cross-encoder's logits; no model."""

    def share(asked: Column) -> Column:
        shared = F.size(F.array_intersect(asked, tokens(passage)))
        return F.when(F.size(asked) > 0, shared / F.size(asked) * 20 - 10).otherwise(F.lit(-10.0))

    return let(F.array_distinct(tokens(query)), share)


@dataclass(frozen=True)
class Plugs:
    encoder: Callable[[Column], Column] = standin_encoder
    segmenter: Callable[[Column], Column] = lambda c: c
    token_counter: Callable[[Column], Column] = word_count
    scorer: Callable[[Column, Column], Column] = standin_scorer
    extra: dict = field(default_factory=dict)


def embed(chunks: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], budget: int = 900) -> DataFrame:
    """(key, vec, error) by an injected client in batches of BATCH, each tried ATTEMPTS times; a batch that fails gives
    nulls and its error, and a task that runs over its budget of calls raises. Responses must be lists of numbers, one
    per text and all of a size."""
    kind = dict(chunks.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = 0
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part, vectors, error = pdf.iloc[at : at + BATCH], None, None
                for _ in range(ATTEMPTS):
                    calls += 1
                    if calls > budget:
                        raise RuntimeError("request budget exceeded")
                    try:
                        found = [[float(x) for x in v] for v in client(part[text].tolist())]
                        if len(found) != len(part) or len({len(v) for v in found}) > 1:
                            raise ValueError("wrong shape of response")
                        vectors, error = found, None
                        break
                    except Exception as e:  # noqa: BLE001  a client may fail in any way
                        error = type(e).__name__
                yield pd.DataFrame({key: part[key], "vec": vectors or [None] * len(part), "error": error})

    return chunks.select(key, text).mapInPandas(run, f"{key} {kind}, vec array<double>, error string")


def rewrite(chunks: DataFrame, keys: list[str], text: str, client: Callable[[str], str], retries: int = 2) -> DataFrame:
    """(keys, result) by an injected generator: null where all attempts failed."""
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf[text]:
                result = None
                for _ in range(retries + 1):
                    try:
                        result = client(t)
                        break
                    except Exception:  # noqa: BLE001, S112  a client may fail in any way
                        continue
                out.append(result)
            yield pdf[keys].assign(result=np.array(out, dtype=object))

    return chunks.select(*keys, text).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", result string")


def called_once(rows: DataFrame, text: str, client: Callable[[str], str], attempts: int = ATTEMPTS, budget: int | None = None) -> DataFrame:
    """rows with result, error and attempts: each distinct text is sent once, whatever number of rows it has, and its
    answer joined back by digest. A text is tried `attempts` times; error is the name of the last exception where none
    answered, `null_text` where there is nothing to send, and `over_budget` where the budget of calls of the whole job
    doesn't reach: it is dealt in the order of digests, `attempts` calls a text, so it holds however tasks run. Answers
    are written before they are joined, so a lost executor repeats no call that is done."""
    digest = F.sha2(F.col(text), 256)
    asked = rows.filter(F.col(text).isNotNull()).select(digest.alias("__digest"), F.col(text).alias("__text")).dropDuplicates(["__digest"])
    if budget is not None:
        asked = global_row_number(asked, ["__digest"], "__n").withColumn("__text", F.when(F.col("__n") < budget // attempts, F.col("__text"))).drop("__n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["__text"]:
                result, error, n = None, "over_budget" if t is None else None, 0
                while t is not None and n < attempts:
                    n += 1
                    try:
                        result, error = client(t), None
                        break
                    except Exception as e:  # noqa: BLE001  a client may fail in any way
                        error = type(e).__name__
                out.append((result, error, n))
            yield pd.concat([pdf[["__digest"]].reset_index(drop=True), pd.DataFrame(out, columns=["result", "error", "attempts"])], axis=1)

    # Dealt evenly first: after a shuffle by digest a few tasks would wait for all calls.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = keep(asked.repartition(parts, "__digest").mapInPandas(run, "__digest string, result string, error string, attempts int"))
    joined = rows.withColumn("__digest", digest).join(answers, "__digest", "left").drop("__digest")
    missing = F.when(F.col(text).isNull(), F.lit("null_text")).otherwise(F.col("error"))
    return joined.withColumn("error", missing).withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def error_classes(called: DataFrame) -> DataFrame:
    """error (null: answered), rows and calls of the distinct texts, most first."""
    return called.groupBy("error").agg(F.count(F.lit(1)).alias("n_rows"), F.max("attempts").alias("attempts"))


def record(chunks: DataFrame) -> DataFrame:
    """Index records of chunks: the raw table only where there is one."""
    return chunks.select("chunk_id", "source_document", "breadcrumb", "content", "has_table", F.when(F.col("has_table"), F.col("raw_table")).alias("raw_table"))
