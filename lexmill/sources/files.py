"""Markdown, JSON arrays and record logs; versioned index tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources import snapshots
from lexmill.sources.shared import keep

CHUNK = (
    "chunk_id string, source_document string, breadcrumb string, content string, token_count int, has_table boolean, "
    "raw_table string, standardization_table string, is_split boolean, split_index int, split_total int"
)
CASE = (
    "case_id string, user_input string, reference string, reference_contexts array<string>, synthesizer_name string, "
    "source_document string, source_section string"
)
INDEX_VERSION = 3


def present(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def read_markdown(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, stem and text of the Markdown files of a folder, in the order of the folded path; none if it is missing."""
    if not present(spark, folder):
        return spark.createDataFrame([], "path string, stem string, text string")
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.input_file_name()
    return files.select(path.alias("path"), F.regexp_extract(path, "([^/]*)\\.md$", 1).alias("stem"), F.col("value").alias("text"))


def read_eval_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Like read_markdown, not recursive; raises where the folder has no file, and where a file is blank."""
    found = read_markdown(spark, folder, False)
    if found.isEmpty():
        raise ValueError(f"no Markdown in {folder}")
    blank = F.when(F.trim("text") == "", F.raise_error(F.concat(F.lit("blank file: "), "path")).cast("string"))
    return found.withColumn("text", F.coalesce(blank, F.col("text")))


def read_json_array(spark: SparkSession, paths: str | list[str], schema: str = CHUNK) -> DataFrame:
    """Objects of JSON array files under a declared schema; malformed files raise."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def read_testset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Test cases with pos; a repeated case_id or an empty required field raises."""
    rows = spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    empty = F.exists(F.array("case_id", "user_input", "reference"), lambda x: F.coalesce(F.trim(x), F.lit("")) == "") | (F.size(F.coalesce("reference_contexts", F.array())) == 0)
    bad = rows.agg(F.count_if(empty).alias("empty"), (F.count("case_id") - F.count_distinct("case_id")).alias("repeated")).first()
    if bad["empty"] or bad["repeated"]:
        raise ValueError(f"{bad['empty']} cases with empty fields, {bad['repeated']} repeated ids")
    return rows if limit is None else rows.orderBy("pos").limit(limit)


def read_log(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last record of each key of a JSONL log. A broken last line is dropped; a broken line before it raises.

    Lines are read in splits. A line's place is its file's time and name, where its split begins, and its number there,
    so no task reads more than a split; what is aggregated goes by key.
    """
    from lexmill.operators.reporting import last_wins

    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select(place.alias("seq"), F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = lines.select("seq", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"}).alias("r")).select("seq", "r.*")
    last, seq = lines.agg(F.max("seq")).scalar(), lines.schema["seq"].dataType
    broken = F.col("_bad").isNotNull()
    checked = parsed.filter(~(broken & (F.col("seq") == last))).withColumn(
        "seq", F.when(broken, F.raise_error(F.lit("broken line in the middle of the log")).cast(seq)).otherwise(F.col("seq"))
    )
    return last_wins(checked.drop("_bad"), keys, "seq").drop("seq")


def append_log(records: DataFrame, path: str) -> None:
    """Appends records to a folder of JSONL files; a commit is all or nothing."""
    records.write.mode("append").option("ignoreNullFields", False).json(path)


def write_swapped(df: DataFrame, path: str) -> None:
    """Overwrites a table: the new files are complete in a folder of their own before they take the old ones' place."""
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.old"
    df.write.parquet(fresh)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        fs.rename(at(path), at(old))
    fs.rename(at(fresh), at(path))
    fs.delete(at(old), True)


def save_index(chunks: DataFrame, folder: str) -> int:
    """Commits the sparse index of chunks (chunk_id, breadcrumb, content, and source_document where it is known) as one
    snapshot: postings, terms and statistics, with a version; returns how many chunks it holds. Chunks of documents that
    have a key carry its terms. Other tables of the snapshot stay."""
    from lexmill.operators import bm25, citation

    text = F.concat_ws(" ", "breadcrumb", "content")
    known = "source_document" in chunks.columns
    key = F.try_element_at(citation.document_keys(), F.col("source_document")) if known else F.lit(None).cast("string")
    found = keep(bm25.terms(chunks, "chunk_id", text, citation.document_terms(F.col("breadcrumb"), key)))
    terms, postings = bm25.index_of(found, "chunk_id")
    tables = {"postings": postings, "terms": terms, "stats": bm25.stats(found)}
    snapshots.commit(chunks.sparkSession, folder, tables, {"index_version": INDEX_VERSION})
    return found.count()


def read_swapped(spark: SparkSession, path: str) -> DataFrame:
    """A table that write_swapped wrote. Where a writer broke off between its two renames, the table before it."""
    old = f"{path.rstrip('/')}.old"
    return spark.read.parquet(path if present(spark, path) or not present(spark, old) else old)


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings, terms and stats of one snapshot; raises where they are missing or of another version."""
    found = snapshots.pinned(spark, folder)
    if "stats" not in found.tables:
        raise FileNotFoundError(f"no index in {folder}")
    if (version := found.notes.get("index_version")) != INDEX_VERSION:
        raise ValueError(f"index version {version}, expected {INDEX_VERSION}")
    return found.read(spark, "postings"), found.read(spark, "terms"), found.read(spark, "stats")


def read_yaml_cases(spark: SparkSession, text: str) -> DataFrame:
    """Cases of a small YAML file of the form `- id: a` with indented `key: value` lines; values are text or JSON."""
    cases: list[dict[str, str]] = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") and line.startswith("- "):
            cases.append({})
            bare = bare[2:]
        key, _, value = bare.partition(":")
        if cases and value.strip():
            value = value.strip()
            cases[-1][key.strip()] = json.loads(value) if value.startswith('"') else value.strip("'")
    return spark.createDataFrame([(k + 1, {a: str(b) for a, b in c.items()}) for k, c in enumerate(cases)], "pos int, fields map<string,string>")
