"""Planning of generation runs: quotas, allocation, progress, recovery, review, breakers, masked messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import nfc

from .ranking import global_row_number, largest_remainder

FIXED_TOKENS, MESSAGE_CHARS = 4000, 200


def question_mix(total: int) -> dict[str, int]:
    """80/10/10, the tenths rounded half to even, the rest single hop."""
    tenth = round(total / 10)
    return {"single_hop": total - 2 * tenth, "multi_hop_abstract": tenth, "multi_hop_specific": tenth}


def allocate(rows: DataFrame, keys: list[str], weight: str, total: str, order: str) -> DataFrame:
    return largest_remainder(rows, keys, F.col(weight), F.col(total), [order])


def unit_key(document: Column, index: Column) -> Column:
    return F.concat(document, F.lit("#"), index.cast("string"))


def case_id(question: Column) -> Column:
    return F.substring(F.sha2(question, 256), 1, 12)


def remaining(units: DataFrame, progress: DataFrame) -> DataFrame:
    """Questions still wanted per unit: all for new units, the rest for partial ones, none otherwise."""
    left = F.when(F.col("status") == "partial", F.greatest(F.lit(0), F.col("quota") - F.coalesce("made", F.lit(0)))).when(
        F.col("status").isNull(), F.col("quota")
    )
    return units.join(progress.select("unit_key", "status", "made"), "unit_key", "left").select("unit_key", F.coalesce(left, F.lit(0)).cast("long").alias("remaining"))


def pending(units: DataFrame, progress: DataFrame, retry: Column) -> DataFrame:
    joined = units.join(progress.select("unit_key", "status"), "unit_key", "left")
    wanted = F.col("status").isNull() | (F.col("status") == "partial") | ((F.col("status") == "skipped") & retry)
    return joined.filter(wanted).select("unit_key", F.coalesce("status", F.lit("new")).alias("status"))


def recoverable(raw: DataFrame, progress: DataFrame) -> DataFrame:
    """Units with raw rows but no progress, and how many rows."""
    return raw.join(progress, "unit_key", "left_anti").groupBy("unit_key").agg(F.count(F.lit(1)).alias("made"))


def mismatches(progress: DataFrame, units: DataFrame) -> DataFrame:
    """Progress whose unit is gone or has changed its length."""
    joined = progress.select("unit_key", "chars").join(units.select("unit_key", "n_chars"), "unit_key", "left")
    return joined.filter("n_chars IS NULL OR n_chars <> chars").select(
        "unit_key", F.when(F.col("n_chars").isNull(), "missing").otherwise("changed").alias("problem")
    )


def unseen(new: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is not in old, the first of each key. A key is told apart by its 256-bit digest, so that the
    texts themselves stay out of the join's sort."""
    digest = F.sha2(key, 256).alias("__d")
    first = W.partitionBy("__d").orderBy(order)
    marked = new.withColumn("__d", digest).withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
    return marked.join(old.select(digest).distinct(), "__d", "left_anti").drop("__d")


def finalize(raw: DataFrame, review: DataFrame) -> DataFrame:
    """Kept rows, in order of position; verdicts other than keep and drop raise."""
    verdict = F.when(F.col("verdict").isin("keep", "drop"), F.col("verdict")).otherwise(F.raise_error(F.lit("unknown verdict")).cast("string"))
    return raw.join(review.withColumn("verdict", verdict), "pos").filter("verdict = 'keep'").select("pos", "case_id").orderBy("pos")


def tokens_per_char(tokens: Column, chars: Column) -> Column:
    """An aggregate over finished units; null below three."""
    n = F.count(F.lit(1))
    return F.when(n >= 3, F.greatest(F.sum(tokens) - FIXED_TOKENS * n, F.lit(0)) / F.sum(chars))


def breaker(rows: DataFrame, key: str, order: str, failure: Column, resets: Column) -> DataFrame:
    """Per key the first row whose failure repeats the one before it, with nothing that resets between."""
    mark = F.when(failure.isNull() & ~resets, None).otherwise(F.coalesce(failure, F.lit("")))
    marked = rows.select(key, order, mark.alias("mark")).filter("mark IS NOT NULL")
    before = F.lag("mark").over(W.partitionBy(key).orderBy(order))
    return marked.withColumn("before", before).filter("mark <> '' AND mark = before").groupBy(key).agg(F.min(order).alias("tripped_at"))


def count_by_kind(rows: DataFrame, kind: Column, kinds: list[str]) -> DataFrame:
    """Count per known kind, zero where there is none; unknown kinds are ignored."""
    known = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counted = rows.filter(kind.isin(kinds)).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def plan(units: DataFrame, progress: DataFrame) -> DataFrame:
    """Units in run order (chars, document, index) with their status, and the one that comes next."""
    ranked = global_row_number(units.select("unit_key", "n_chars", "doc_id"), ["n_chars", "doc_id"], "rank", 1)
    joined = ranked.join(progress.select("unit_key", "status"), "unit_key", "left").select("unit_key", F.coalesce("status", F.lit("pending")).alias("status"), "rank")
    following = joined.filter(F.col("status").isin("pending", "partial")).agg(F.min("rank")).scalar()
    return joined.withColumn("is_next", F.col("rank") == following)


def record(progress: DataFrame, run: DataFrame) -> DataFrame:
    """Progress after a run: counts add up, and token totals too unless either is unknown."""
    a = progress.select("unit_key", F.col("made").alias("m0"), F.col("tokens").alias("t0"), F.col("status").alias("s0"), F.lit(True).alias("h0"))
    b = run.select("unit_key", F.col("made").alias("m1"), F.col("tokens").alias("t1"), F.lit(True).alias("h1"))
    tokens = F.when(F.col("h1").isNull(), F.col("t0")).when(F.col("h0").isNull(), F.col("t1")).otherwise(F.col("t0") + F.col("t1"))
    status = F.when(F.col("h1").isNull(), F.col("s0")).when(F.col("m1") > 0, "done").otherwise("skipped")
    made = F.coalesce("m0", F.lit(0)) + F.coalesce("m1", F.lit(0))
    return a.join(b, "unit_key", "full").select("unit_key", made.alias("made"), tokens.alias("tokens"), status.alias("status"))


def mask(message: Column) -> Column:
    return F.left(F.regexp_replace(message, "(org|gsk)_[A-Za-z0-9]+", "$1_***"), F.lit(MESSAGE_CHARS))


def select(units: DataFrame, only: list[str]) -> DataFrame:
    """The units (document, index, unit_key) that selectors name: `name` or `name#index`, the name composed, with or
    without .md; none names all. A selector that names nothing raises, with the documents, or the range of numbers, that
    there are. Selectors are the few that a caller types."""
    if not only:
        return units
    asked = units.sparkSession.createDataFrame([(k, s) for k, s in enumerate(only)], "k int, selector string")
    parts = F.split(nfc(F.col("selector")), "#", 2)
    bare = lambda c: F.regexp_replace(nfc(c), "\\.md$", "")
    asked = asked.select("k", "selector", bare(parts[0]).alias("name"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("wanted"))
    known = units.groupBy("document").agg(F.min("index").alias("low"), F.max("index").alias("high"), F.array_sort(F.collect_set("index")).alias("numbers"))
    met = F.broadcast(asked).join(known.withColumn("name", bare(F.col("document"))), "name", "left")  # one row a document
    number = F.col("wanted").try_cast("long")
    problem = F.when(F.col("document").isNull(), "document").when((F.col("wanted") != "") & ~F.coalesce(F.array_contains("numbers", number), F.lit(False)), "number")
    wrong = met.withColumn("problem", problem).filter("problem IS NOT NULL").orderBy("k").first()
    if wrong is not None and wrong["problem"] == "document":
        names = known.agg(F.array_join(F.array_sort(F.collect_list("document")), ", ")).first()[0]
        raise ValueError(f"{wrong['selector']!r}: no such document; there are {names}")
    if wrong is not None:
        raise ValueError(f"{wrong['selector']!r}: {wrong['document']} has units {wrong['low']} to {wrong['high']}")
    hits = met.select("document", number.alias("i"))
    here = (units["document"] == hits["document"]) & (F.col("i").isNull() | (F.col("i") == units["index"]))
    return units.join(F.broadcast(hits), here, "left_semi")


#: What a case must have.
REQUIRED = ("case_id", "user_input", "reference")


def invalid_rows(raw: DataFrame) -> DataFrame:
    """position (from 1) and problem of each row of cases (position, and those of REQUIRED and reference_contexts) that
    can't go into a test set: what is null or blank, in order, or a case_id that an earlier row has."""
    blank = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED]
    said = F.coalesce(F.exists("reference_contexts", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""), F.lit(False))
    empty = F.array_join(F.array_compact(F.array(*blank, F.when(~said, F.lit("reference_contexts")))), ", ")
    again = F.row_number().over(W.partitionBy("case_id").orderBy("position")) > 1
    problem = F.when(empty != "", F.concat(F.lit("empty: "), empty)).when(again & F.col("case_id").isNotNull(), "repeated case_id")
    return raw.select("position", problem.alias("problem")).filter("problem IS NOT NULL")


def finalized(raw: DataFrame, review: DataFrame) -> DataFrame:
    """The rows that a review (pos from 1, verdict) keeps, in order, if every row is valid; else raises with the first
    problem and its position."""
    wrong = invalid_rows(raw).orderBy("position").first()
    if wrong is not None:
        raise ValueError(f"row {wrong['position']}: {wrong['problem']}")
    kept = finalize(raw.withColumn("pos", F.col("position")), review)
    return raw.join(kept.select(F.col("pos").alias("position")), "position", "left_semi").orderBy("position")


def attached(new: DataFrame, units: DataFrame, old: DataFrame) -> DataFrame:
    """New cases (unit_key, position, user_input, ...) with the document and section of their unit, without those whose
    question is in old or came before among them."""
    sourced = new.join(units.select("unit_key", F.col("document").alias("source_document"), F.col("title").alias("source_section")), "unit_key")
    return unseen(sourced, old, "user_input", "position")


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress of units (unit_key, made, tokens, status) from a JSON file: empty where there is none, and an error, not
    fewer rows, where it is corrupt."""
    from lexmill.sources import files

    schema = "unit_key string, made long, tokens long, status string"
    if not files.present(spark, path):
        return spark.createDataFrame([], schema)
    rows = files.read_json_array(spark, path, schema)
    bad = F.col("unit_key").isNull() | ~F.coalesce(F.col("status").isin("done", "partial", "skipped"), F.lit(False))
    return rows.withColumn("unit_key", F.when(bad, F.raise_error(F.lit("corrupt progress")).cast("string")).otherwise(F.col("unit_key")))
