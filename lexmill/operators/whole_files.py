"""Whole files: regions rewritten by an outside model, put together with the emitted body; and Markdown to chunks with
what stands in front of the body and behind it.

A file is a group of rows throughout, so one that cannot be read, or holds nothing, gives a row with its error and
nothing else; the others don't notice. Good rows and errors are written in one pass, to two folders of one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as fn
from lexmill.operators import chunking, formatting, models, units
from lexmill.operators.ranking import packed_groups
from lexmill.sources.shared import keep

#: What the warnings of a region are called, and how a chunk behind the body is named.
FRONT_FAILED, BACK_FAILED, NO_TITLE = "llm_frontmatter_conversion_failed", "llm_backmatter_conversion_failed", "frontmatter_title_not_found"
DROPPED_TABLE = "dropped_noi_nhan_table"
BACK_SUFFIX = "Chú thích sửa đổi (cuối văn bản)"
TOKENS = 4_000

#: What a rewriter does: (doc, region, k, prompt) to (doc, region, k, result), null where it failed.
Rewriter = Callable[[DataFrame], DataFrame]


def regions(blocks: DataFrame) -> DataFrame:
    """Zoned blocks with region: before (with the line that names a kind of document), title (the paragraph right behind
    that line), after, body or back; what belongs to none is left out."""
    zoned = formatting.boundaries(blocks)
    front = F.col("zone") == "front"
    names = front & (F.col("kind") == "paragraph") & F.trim("text").rlike(formatting.DOCUMENT_KIND)
    named = zoned.filter(names).groupBy("doc").agg(F.min("pos").alias("named"))
    found = zoned.join(named, "doc", "left")
    # The title stands at the next place, if that is a paragraph that says something.
    title = found.filter((F.col("pos") == F.col("named") + 1) & (F.col("zone") == "front") & (F.col("kind") == "paragraph") & (F.trim("text") != ""))
    found = found.drop("named").join(title.select("doc", F.col("pos").alias("at")), "doc", "left")
    region = (
        F.when(front & (F.col("at").isNull() | (F.col("pos") < F.col("at"))), "before")
        .when(front & (F.col("pos") == F.col("at")), "title")
        .when(front, "after")
        .when(F.col("zone") == "middle", "body")
        .when(F.col("zone") == "back", "back")
        .when(F.col("zone") == "signature", "signature")
    )
    return found.withColumn("region", region).filter("region IS NOT NULL").drop("at")


def marked(blocks: DataFrame) -> Column:
    """A block as a rewriter reads it: bold and italic in asterisks, where the columns are there."""
    if "is_bold" not in blocks.columns:
        return F.col("text")
    sign = F.when(F.col("is_bold") & F.col("is_italic"), "***").when(F.col("is_bold"), "**").when(F.col("is_italic"), "*").otherwise("")
    return F.when(F.col("kind") == "paragraph", F.concat(sign, "text", sign)).otherwise(F.col("text"))


def prompts(found: DataFrame, front: str = "%s", back: str = "%s", tokens: int = TOKENS) -> DataFrame:
    """doc, region, k, prompt of the regions before, after and back: blocks packed in order while they fit, and put into
    the caller's wording, a format with one %s."""
    rows = found.filter(F.col("region").isin("before", "after", "back")).select("doc", "region", "pos", marked(found).alias("t"))
    listed = rows.groupBy("doc", "region").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("b"))
    sizes = F.transform("b", lambda x: F.length(x["t"]))
    group = packed_groups(sizes, int(tokens * formatting.CHARS_PER_TOKEN))
    one = listed.select("doc", "region", F.explode(F.arrays_zip(group.alias("k"), F.col("b").alias("b"))).alias("z")).select("doc", "region", "z.k", F.col("z.b.pos").alias("pos"), F.col("z.b.t").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n\n")
    wording = F.when(F.col("region") == "back", F.format_string(back, F.col("text"))).otherwise(F.format_string(front, F.col("text")))
    return one.groupBy("doc", "region", "k").agg(text.alias("text")).select("doc", "region", "k", wording.alias("prompt"))


def compose(blocks: DataFrame, rewrite: Rewriter, front: str = "%s", back: str = "%s", tokens: int = TOKENS) -> DataFrame:
    """doc, text, warnings (array of code and detail): the Markdown of each document of blocks (doc, pos, kind, text, and
    is_bold, is_italic).

    A region whose rewriting failed anywhere is left out whole, with a warning. The title stands between what is before
    and after it, also where these failed. Front and body follow one another, the back stands behind a rule.
    """
    found = keep(regions(blocks))
    asked = keep(prompts(found, front, back, tokens))
    made = formatting.assemble(rewrite(asked).select("doc", "region", "k", "result"))
    per = made.groupBy("doc").agg(
        *[F.max(F.when(F.col("region") == r, F.col("text"))).alias(r) for r in ("before", "after", "back")],
        *[F.max(F.when(F.col("region") == r, F.col("qc"))).alias(f"{r}_qc") for r in ("before", "after", "back")],
    )
    about = found.groupBy("doc").agg(
        F.max(F.when(F.col("region") == "title", F.col("text"))).alias("title"),
        F.bool_or(F.col("region").isin("before", "title", "after")).alias("has_front"),
        F.max(F.when(F.col("region") == "signature", F.col("pos"))).alias("signature"),
    )
    lines = F.array_sort(F.collect_list(F.struct("pos", "part", "line")))
    body = formatting.emit(found.filter("region = 'body'").select("doc", "pos", "kind", "text")).groupBy("doc")
    body = keep(body.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("body")))
    checked = formatting.validate(body.select("doc", F.col("body").alias("text"))).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("code", "detail"))).alias("checks"))
    joined = about.join(per, "doc", "left").join(body, "doc", "left").join(checked, "doc", "left")
    some = lambda c: F.nullif(c, F.lit(""))
    head = fn.escape_setext(F.concat_ws("\n\n", some(F.col("before")), F.concat(F.lit("# "), F.col("title")), some(F.col("after"))))
    text = F.concat_ws("\n\n", some(head), some(F.col("body")))
    text = F.concat(text, F.coalesce(F.concat(F.lit("\n\n---\n\n"), some(F.col("back"))), F.lit("")), F.lit("\n"))
    warn = lambda when, code, detail="": F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))
    own = F.array_compact(F.array(
        warn(F.col("signature").isNotNull(), DROPPED_TABLE, F.concat(F.lit("block "), F.col("signature"))),
        warn(F.col("before_qc").isNotNull(), FRONT_FAILED), warn(F.col("after_qc").isNotNull(), FRONT_FAILED),
        warn(F.col("has_front") & F.col("title").isNull(), NO_TITLE), warn(F.col("back_qc").isNotNull(), BACK_FAILED),
    ))
    none = F.array().cast("array<struct<code:string,detail:string>>")
    return joined.select("doc", text.alias("text"), F.concat(own, F.coalesce("checks", none)).alias("warnings"))


def files_to_markdown(blocks: DataFrame, rewrite: Rewriter, **how) -> DataFrame:
    """path, text, warnings, error of each file of blocks as read_docx gives them: a file with an error has no text."""
    whole = keep(blocks)
    status = whole.groupBy("path").agg(F.max("error").alias("error"))
    good = whole.join(status.filter("error IS NULL").select("path"), "path", "left_semi").filter("kind IS NOT NULL").withColumnRenamed("path", "doc")
    made = compose(good, rewrite, **how).withColumnRenamed("doc", "path")
    return status.join(made, "path", "left").select("path", "text", "warnings", "error")


def write_apart(found: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes rows with an error column in one pass, to status=good and status=failed below the folder, and returns both."""
    status = F.when(F.col("error").isNull(), "good").otherwise("failed")
    found.withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(folder)
    # Partitions that nothing fell into have no folder, so the table is read as one.
    rows = found.sparkSession.read.schema(found.withColumn("status", status).schema).parquet(folder)
    return rows.filter("status = 'good'").drop("status"), rows.filter("status = 'failed'").drop("status")


def plain_rewriter(prompts: DataFrame) -> DataFrame:
    """A stand-in that gives prompts back as they are; no model."""
    return prompts.select("doc", "region", "k", F.col("prompt").alias("result"))


def calling(client: Callable[[str], str], attempts: int = 3) -> Rewriter:
    """A rewriter that asks a client, once for equal prompts."""
    return lambda asked: models.called_once(asked, "prompt", client, attempts).select("doc", "region", "k", "result")


def document_chunks(docs: DataFrame, stem: Column, max_tokens: int = chunking.MAX_TOKENS) -> DataFrame:
    """All chunks of Markdown documents (doc, text), with place, their order: what stands in front of the first structural
    heading, the clauses, and what stands behind the rule, the outer regions cut as one clause without a number."""
    blocks = keep(chunking.split_blocks(docs))
    regioned = chunking.regions(chunking.headings(blocks))
    names = keep(chunking.document_names(regioned, stem))
    clauses = chunking.chunks(chunking.clause_rows(chunking.track(blocks, stem)), max_tokens).withColumn("__region", F.lit(1))
    side = F.when(F.col("pos") < F.col("start"), 0).when(F.col("pos") > F.col("finish"), 2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n")
    outer = regioned.withColumn("side", side).filter("side IS NOT NULL").groupBy("doc", "side").agg(text.alias("text")).join(names, "doc")
    prefix = F.when(F.col("side") == 2, F.concat("source_document", F.lit(f" - {BACK_SUFFIX}"))).otherwise(F.col("source_document"))
    cut = units.split_regions(outer.select(F.struct("doc", "side", "source_document").alias("doc"), prefix.alias("prefix"), "text"), max_tokens)
    crumb = F.when(F.col("parts") > 1, F.concat("prefix", F.lit(" (phần "), "part", F.lit("/"), "parts", F.lit(")"))).otherwise(F.col("prefix"))
    sides = cut.select(
        "doc.doc", F.lit(None).cast("bigint").alias("clause"), "part", "parts", "doc.source_document", crumb.alias("breadcrumb"), "content",
        F.lit(False).alias("has_table"), F.lit(None).cast("string").alias("raw_table"),
        chunking.chunk_id(F.col("doc.source_document"), crumb).alias("chunk_id"), fn.word_count(F.col("content")).alias("token_count"), F.col("doc.side").alias("__region"),
    )
    every = clauses.select(*sides.columns).unionByName(sides)
    return every.withColumn("place", F.struct(F.col("__region").alias("region"), F.coalesce("clause", F.lit(0).cast("bigint")).alias("clause"), "part")).drop("__region")
