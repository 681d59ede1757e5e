"""The corpus pipeline: toxic documents go, repeated line windows go, one document of each near-duplicate group stays,
contaminated documents go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents; n_chars follows the text where a stage changes it. No stage drops a row for a null or empty text as such:
they score as clean, have no lines to lose, form one near-duplicate group with fingerprint zero, hold no window, and
encode to no ids. Where rows meet others they are told apart by an id of their own, so a doc_id that repeats doesn't multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontaminate, lines, simhash, toxicity
from lexmill.llm.common import RID, keep, table


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents as a row id and row, a struct of all their columns, whatever these are called, and the same rows with
    that id in the place of doc_id, for an operator. Both are read from a table that holds the ids: numbered anew, rows
    could get other ids in other splits."""
    rows = keep(docs.select(F.monotonically_increasing_id().alias(RID), F.struct("*").alias("row")))
    return rows, rows.select(F.col(RID).alias("doc_id"), F.col("row")["text"].alias("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores as clean. Rows are judged where they are: no id, no shuffle."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"))
    return rows.filter(toxicity.scores(F.col("row")["text"], model, spark) < toxicity.CUT).select("row.*")


def dedup_line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that later occurrences of three-line windows cover."""
    return lines.dedup_lines(docs, length="n_chars", written=True)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each near-duplicate group."""
    rows, keyed = _keyed(docs)
    # Components are named by row ids here; the document that stays is the one of smallest doc_id, then row id.
    groups = keep(simhash.near_duplicates(keyed).select(F.col("doc_id").alias(RID), "component_id"))
    place = F.struct(F.col("row")["doc_id"].alias("doc_id"), RID)
    first = rows.select(RID, place.alias("place")).join(groups, RID).groupBy("component_id").agg(F.min("place").alias("first"))
    return rows.join(first.select(F.col(f"first.{RID}").alias(RID)), RID, "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate."""
    rows, keyed = _keyed(docs)
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"))
    return rows.join(found.filter("contaminated").select(F.col("doc_id").alias(RID)), RID, "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document that is left, and whether they decode to its bytes."""
    return bpe.encode(docs, offsets=False, check=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_line_windows),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", encode),
]

#: The first, third and last stage are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
    return docs
