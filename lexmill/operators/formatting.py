"""Document blocks to structured Markdown: boundaries, titles, emitted headings, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import text as fn
from lexmill.operators.ranking import in_ranges, over_ranges
from lexmill.sources.shared import keep

#: What a signature table holds, an attachment table, and lines that name a kind of document.
SIGNATURE = "(?iu)Nơi\\s+nhận:|XÁC\\s+THỰC\\s+VĂN\\s+BẢN\\s+HỢP\\s+NHẤT|CHỦ\\s+NHIỆM|TM\\.\\s|KT\\.\\s|THỦ\\s+TƯỚNG"
ATTACHMENT = "(?iu)FILE\\s+ĐƯỢC\\s+ĐÍNH\\s+KÈM\\s+THEO\\s+VĂN\\s+BẢN"
DOCUMENT_KIND = "(?iu)^(?:THÔNG\\s+TƯ\\s+LIÊN\\s+TỊCH|THÔNG\\s+TƯ|NGHỊ\\s+ĐỊNH|NGHỊ\\s+QUYẾT|BỘ\\s+LUẬT|QUYẾT\\s+ĐỊNH|PHÁP\\s+LỆNH|CHỈ\\s+THỊ|LUẬT)$"
ATTACHED = "(?isu)\\s*(\\(\\s*Kèm\\s+theo(?![\\p{L}\\p{N}_]).*)$"
HEADING_CHARS, APPENDIX_CHARS, CHARS_PER_TOKEN = 200, 120, 2.5


def boundaries(blocks: DataFrame) -> DataFrame:
    """Adds front (first structural paragraph, or past the end), back (last signature table, or past the end) and zone:
    front, middle, signature, back or attachment."""
    doc = W.partitionBy("doc")
    past = F.max("pos").over(doc) + 1
    paragraph, table = F.col("kind") == "paragraph", F.col("kind") == "table"
    front = F.min(F.when(paragraph & fn.is_structural(F.col("text")), F.col("pos"))).over(doc)
    back = F.max(F.when(table & F.col("text").rlike(SIGNATURE), F.col("pos"))).over(doc)
    bounded = blocks.withColumn("front", F.coalesce(front, past)).withColumn("back", F.coalesce(back, past))
    zone = (
        F.when(F.col("pos") > F.col("back"), "back")
        .when(F.col("pos") == F.col("back"), "signature")
        .when(F.col("pos") < F.col("front"), "front")
        .when(table & F.col("text").rlike(ATTACHMENT), "attachment")
        .otherwise("middle")
    )
    return bounded.withColumn("zone", zone)


def titles(blocks: DataFrame) -> DataFrame:
    """doc and title: the paragraph after the first line that only names a kind of document."""
    ordered = W.partitionBy("doc").orderBy("pos")
    paragraphs = blocks.filter("kind = 'paragraph'").withColumn("after", F.lead("text").over(ordered))
    return paragraphs.filter(F.trim("text").rlike(DOCUMENT_KIND)).groupBy("doc").agg(F.min_by("after", "pos").alias("title"))


def is_capitals(text: Column) -> Column:
    """At least two letters, none of them small."""
    letters = F.regexp_replace(text, "[^\\p{L}]", "")
    return (F.length(letters) >= 2) & (F.upper(letters) == letters)


def emit(blocks: DataFrame) -> DataFrame:
    """doc, pos, part, line: the Markdown of middle blocks (doc, pos, kind, text).

    A label and the capital line after it become one heading and that line is used up; clauses become a heading and
    their text, in appendices one heading if short; everything else stays as it is.
    """
    ordered = W.partitionBy("doc").orderBy("pos")
    clean = F.when((F.col("kind") == "paragraph") & F.contains(F.col("text"), F.lit("[")), fn.strip_markers(F.col("text"))).otherwise(F.col("text"))
    rows = blocks.withColumn("text", clean)
    name = F.when(F.col("kind") == "paragraph", fn.kind_of_line(F.col("text")))
    rows = rows.withColumn("name", name)
    cut = F.when(F.col("kind") == "paragraph", F.trim(F.regexp_replace("text", ATTACHED, "")))
    rows = rows.withColumn("cut", cut).withColumn("rest", F.trim(F.regexp_extract("text", ATTACHED, 1)))
    labelled = F.col("name").isin("appendix", "part", "chapter")
    fits = (F.col("cut") != "") & is_capitals(F.col("cut")) & ~fn.is_structural(F.col("cut"))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)))
    rows = rows.withColumn("next", F.when(labelled, F.when(F.lead("fits").over(ordered), F.struct(F.lead("cut").over(ordered).alias("cut"), F.lead("rest").over(ordered).alias("rest")))))
    used = F.coalesce(F.lag(labelled).over(ordered) & F.col("fits"), F.lit(False))
    rows = rows.withColumn("used", used).filter("NOT used")
    sticky = F.last(F.when(F.col("name") == "appendix", True).when(F.col("name").isin("part", "chapter"), False), ignorenulls=True)
    rows = rows.withColumn("in_appendix", F.coalesce(sticky.over(ordered.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))

    def titled(level: str, separator: str) -> Column:
        heading = F.concat(F.lit(level + " "), F.when(F.col("next").isNotNull(), F.concat("text", F.lit(separator), "next.cut")).otherwise(F.col("text")))
        return F.array_compact(F.array(heading, F.nullif(F.col("next.rest"), F.lit(""))))

    number, body = F.regexp_extract("text", fn.STRUCTURE["clause"], 1), F.regexp_extract("text", fn.STRUCTURE["clause"], 2)
    lines = (
        F.when(F.col("name") == "appendix", titled("#", " — "))
        .when(F.col("name") == "part", titled("#", ". "))
        .when(F.col("name") == "chapter", titled("##", ". "))
        .when(F.col("name") == "section", F.array(F.concat(F.lit("### "), "text")))
        .when(F.col("name") == "article", F.array(F.concat(F.lit("#### "), "text")))
        .when(
            F.col("name") == "clause",
            F.when(F.col("in_appendix") & (F.length(body) <= APPENDIX_CHARS), F.array(F.concat(F.lit("##### "), number, F.lit(". "), body))).otherwise(
                F.array(F.concat(F.lit("##### Khoản "), number), body)
            ),
        )
        .otherwise(F.array("text"))
    )
    return rows.select("doc", "pos", F.posexplode(lines).alias("part", "line"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, __p, line_no (from 1), raw: the lines of documents (doc, text), in ranges."""
    rows = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("k", "raw")).select("doc", (F.col("k") + 1).alias("line_no"), "raw")
    return in_ranges(rows, ["doc"], ["line_no"])


def scan_headings(lines: DataFrame) -> DataFrame:
    """doc, __p, line_no, line, table, hashes and content of lines in ranges; hashes are 0 inside a table."""
    marked = lines.select("doc", "__p", "line_no", F.rtrim("raw").alias("line"))
    opened = F.when(F.col("line").startswith("<table>"), True).when(F.col("line").startswith("</table>"), False)
    marked = over_ranges(marked, ["doc"], ["line_no"], lasts={"opened": opened})
    table = F.coalesce("opened", F.lit(False)) | F.col("line").startswith("|") | F.col("line").startswith("</table>")
    hashes = F.length(F.regexp_extract("line", "^(#*)", 1))
    marked = marked.withColumn("table", table).withColumn("hashes", F.when(~table, hashes).otherwise(0))
    content = F.trim(F.expr("substring(line, hashes + 1)"))
    return marked.withColumn("content", content).drop("opened")


def validate(docs: DataFrame) -> DataFrame:
    """doc, code, detail: the quality warnings of Markdown documents (doc, text)."""
    return validate_lines(lines_of(docs))


def validate_lines(lines: DataFrame) -> DataFrame:
    """validate() of documents whose lines (doc, __p, line_no, raw) stand in ranges of their order: what holds from one
    line on is carried over ranges, so no task needs a whole document."""
    rows = scan_headings(lines)
    h = F.col("hashes")
    line = F.concat(F.lit("dòng "), "line_no", F.lit(": "))
    real = (h > 0) & (F.col("content") != "")
    number = F.regexp_extract("content", fn.STRUCTURE["article"], 1)
    parent = F.when(real & (h == 1), F.when(fn.kind_of_line(F.col("content")) == "appendix", F.lit("phu_luc")).otherwise(F.concat(F.lit("phan:"), "content"))).when(
        real & (h == 4), F.concat(F.lit("dieu:"), F.when(number != "", number).otherwise(F.col("content")))
    )
    held = {
        "seen": F.when(real & (h == 4), 1),
        "in_appendix": F.when(real & (h == 1), fn.kind_of_line(F.col("content")) == "appendix"),
        "top": F.when(real & (h == 1), F.col("line_no")),
        "under": F.when(real & (h == 4), F.struct("line_no", "content")),
        "parent": parent,
    }
    rows = over_ranges(rows, ["doc"], ["line_no"], lasts=held)
    rows = rows.withColumn("in_appendix", F.coalesce("in_appendix", F.lit(False))).withColumn("article", F.when(F.col("under.line_no") > F.coalesce("top", F.lit(0)), F.col("under.content")))
    holds = F.when((F.col("table") | (h == 0)) & (F.trim("line") != "") | (real & (h == 5)), 1).otherwise(0)
    # Written once: each warning looks for something else in the same rows.
    rows = keep(
        rows.select(
            "doc", "line_no", "hashes", F.when(h > 0, F.col("content")).alias("content"), F.length("line").alias("length"), holds.alias("holds"), "seen", "in_appendix", "article",
            F.coalesce("parent", F.lit("<none>")).alias("parent"), number.alias("number"),
        )
    )
    clause_no = F.trim(F.split(F.regexp_replace("content", "^Khoản ", ""), "\\.")[0])

    deep = rows.filter(h > 5).select("doc", F.lit("heading_too_deep").alias("code"), F.concat(line, F.expr("repeat('#', hashes)")).alias("detail"))
    long = rows.filter(real & (F.col("length") > HEADING_CHARS)).select("doc", F.lit("suspicious_heading_length").alias("code"), F.concat(line, "length", F.lit(" ký tự")).alias("detail"))
    skips = rows.filter(real & (h == 5) & F.col("seen").isNull() & ~F.col("in_appendix")).groupBy("doc").agg(F.min_by(F.concat(line, "content"), "line_no").alias("detail"))
    bare = rows.groupBy("doc").agg(F.max("hashes").alias("m")).filter("m = 0").select("doc", F.lit("no_heading").alias("code"), F.lit("").alias("detail"))
    articles = breaks(rows.filter(real & (h == 4) & (F.col("number") != "")), ["doc"], F.col("number"))
    clauses = breaks(rows.filter(real & (h == 5)), ["doc", "parent"], clause_no)
    empty = rows.filter("article IS NOT NULL").groupBy("doc", F.col("article").alias("detail")).agg(F.max("holds").alias("m")).filter("m = 0").select("doc", F.lit("empty_dieu").alias("code"), "detail")
    out = deep
    for more in (
        long,
        skips.select("doc", F.lit("heading_level_skip").alias("code"), "detail"),
        bare,
        articles.select("doc", F.lit("dieu_not_monotonic").alias("code"), F.concat(F.lit("Điều "), "n").alias("detail")),
        clauses.select("doc", F.lit("khoan_not_monotonic").alias("code"), F.concat("parent", F.lit(" -> khoản "), "n").alias("detail")),
        empty,
        orphan_footnotes(lines),
    ):
        out = out.unionByName(more)
    return out


def orphan_footnotes(lines: DataFrame) -> DataFrame:
    """doc, code, detail: each marker that is left, of lines (doc, raw); none spans two."""
    found = F.regexp_extract_all("raw", F.lit("(\\[\\d{1,3}\\])"), F.lit(1))
    return lines.select("doc", F.lit("orphan_footnote").alias("code"), F.explode(found).alias("detail"))


def breaks(rows: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """Rows whose number (48a, 48b, 49) is not above the one before it in the same group, as column n."""
    ordered = W.partitionBy(*keys).orderBy("line_no")
    keyed = rows.withColumn("n", number).withColumn("__k", fn.number_key(F.col("n")))
    return keyed.withColumn("__b", F.lag("__k").over(ordered)).filter(F.col("__k") <= F.col("__b")).select(*keys, "line_no", "n")


def serialize(blocks: DataFrame) -> DataFrame:
    """doc and text: blocks joined by blank lines, bold and italic marked by asterisks."""
    mark = F.when(F.col("is_bold") & F.col("is_italic"), "***").when(F.col("is_bold"), "**").when(F.col("is_italic"), "*").otherwise("")
    marked = F.when(F.col("kind") == "paragraph", F.concat(mark, "text", mark)).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", marked.alias("t"))))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))


def assemble(regions: DataFrame) -> DataFrame:
    """doc, region, text, qc: rewritten chunks of a region joined in order; any missing chunk drops all of it."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "result")))
    grouped = regions.groupBy("doc", "region").agg(F.bool_or(F.col("result").isNull()).alias("lost"), F.array_join(F.transform(ordered, lambda x: x["result"]), "\n\n").alias("text"))
    return grouped.select("doc", "region", F.when(~F.col("lost"), fn.escape_setext(F.col("text"))).alias("text"), F.when(F.col("lost"), "llm_failed").alias("qc"))
