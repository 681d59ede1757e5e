"""Structured Markdown to clause chunks: headings, breadcrumbs, quotes, clauses, points, packing, tables, ids.

All rules run as windows over (doc, pos, block); a document's blocks are ordered inside its own partition. Only clauses
over the token budget go through a pandas UDF, which packs their points or sentences.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lexmill.functions.text import ORDINALS, ROMAN, word_count

_END = "(?![\\p{L}\\p{N}_])"
_NUMBER = "(\\d+[a-zđ]?)"
_PART = f"(?iu)^Phần\\s+(?:thứ\\s+)?({ROMAN}|\\d+|{ORDINALS}){_END}"
_CHAPTER = f"(?iu)^Chương\\s+({ROMAN}|\\d+){_END}"
_SECTION = f"(?iu)^Mục\\s+{_NUMBER}{_END}"
_ARTICLE = f"^Điều\\s+{_NUMBER}\\s*\\.\\s*(.*)$"
_CLAUSE = f"(?iu)^Khoản\\s+{_NUMBER}$"
_MERGED = f"^{_NUMBER}\\.\\s+(.*)$"
MAX_TOKENS = 256


def split_blocks(docs: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """doc, pos (from 1), block: pieces between blank lines, trimmed, empty ones dropped."""
    pieces = F.filter(F.transform(F.split(text, "\n{2,}"), lambda b: F.regexp_replace(b, "^\\s+|\\s+$", "")), lambda b: b != "")
    return docs.select(key, F.posexplode(pieces).alias("p", "block")).select(key, (F.col("p") + 1).alias("pos"), "block")


def headings(blocks: DataFrame) -> DataFrame:
    """Adds level (1 to 5, null if no heading), title and structural."""
    level = F.length(F.regexp_extract("block", "^(#{1,5})\\s+(.*)$", 1))
    title = F.trim(F.regexp_extract("block", "^(#{1,5})\\s+(.*)$", 2))
    marked = blocks.withColumn("level", F.when(level > 0, level)).withColumn("title", F.when(level > 0, title))
    t = F.col("title")
    structural = (
        F.when(F.col("level") == 1, t.rlike(f"(?iu)^PHỤ\\s+LỤC{_END}") | t.rlike(_PART))
        .when(F.col("level") == 2, t.rlike(_CHAPTER))
        .when(F.col("level") == 3, t.rlike(_SECTION))
        .when(F.col("level") == 4, t.rlike(_ARTICLE))
        .when(F.col("level") == 5, t.rlike(_CLAUSE) | t.rlike(_MERGED))
    )
    return marked.withColumn("structural", F.coalesce(structural, F.lit(False)))


def regions(marked: DataFrame) -> DataFrame:
    """Adds start (first structural heading, or past the end) and finish (the --- after it, or past the end)."""
    doc = W.partitionBy("doc")
    past = F.max("pos").over(doc) + 1
    out = marked.withColumn("start", F.coalesce(F.min(F.when(F.col("structural"), F.col("pos"))).over(doc), past))
    rule = (F.col("block") == "---") & (F.col("pos") >= F.col("start"))
    return out.withColumn("finish", F.coalesce(F.min(F.when(rule, F.col("pos"))).over(doc), past))


def document_names(regioned: DataFrame, stem: Column) -> DataFrame:
    """doc and source_document: the paragraph before the first level-1 heading in front, without emphasis, and that
    heading; else the stem."""
    bare = F.trim(F.regexp_replace(F.trim(F.col("block")), "^\\*+|\\*+$", ""))
    ordered = W.partitionBy("doc").orderBy("pos")
    front = regioned.withColumn("before", F.lag(bare).over(ordered)).filter("pos < start")
    named = front.groupBy("doc").agg(
        F.min_by(F.struct("before", "title"), F.when(F.col("level") == 1, F.col("pos"))).alias("n")
    )
    docs = regioned.select("doc").distinct().join(named, "doc", "left")
    name = F.when(F.coalesce(F.col("n.before"), F.lit("")) == "", F.col("n.title")).otherwise(F.concat_ws(" ", "n.before", "n.title"))
    return docs.select("doc", F.coalesce(name, stem).alias("source_document"))


def _segment(level: int) -> Column:
    t = F.col("title")
    if level == 4:
        number, rest = F.regexp_extract(t, _ARTICLE, 1), F.trim(F.regexp_extract(t, _ARTICLE, 2))
        return F.when(number == "", t).when(rest == "", F.concat(F.lit("Điều "), number)).otherwise(F.concat(F.lit("Điều "), number, F.lit(". "), rest))
    pattern, label = {1: (_PART, "Phần "), 2: (_CHAPTER, "Chương "), 3: (_SECTION, "Mục ")}[level]
    number = F.regexp_extract(t, pattern, 1)
    return F.when(number == "", t).otherwise(F.concat(F.lit(label), number))


def quote_depth(body: DataFrame) -> DataFrame:
    """Adds depth: open quotation marks after each block, never below zero, anew at each heading above clauses.

    With S the running sum since that heading, the clamped sum is S - min(0, smallest S so far).
    """
    ordered = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    opened = F.length("block") - F.length(F.replace("block", F.lit("“"), F.lit("")))
    closed = F.length("block") - F.length(F.replace("block", F.lit("”"), F.lit("")))
    delta = F.when(F.col("level").isNull(), opened - closed).otherwise(0)
    grouped = body.withColumn("__g", F.sum(F.when(F.col("level") <= 4, 1).otherwise(0)).over(ordered)).withColumn("__d", delta)
    within = W.partitionBy("doc", "__g").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    summed = grouped.withColumn("__s", F.sum("__d").over(within))
    return summed.withColumn("depth", (F.col("__s") - F.least(F.lit(0), F.min("__s").over(within))).cast("int")).drop("__g", "__d", "__s")


def track(blocks: DataFrame, stem: Column | None = None) -> DataFrame:
    """The body's blocks with level, title, depth, flush (starts a clause), clause (its number in the document),
    breadcrumb, khoan_number and dieu_seen."""
    stem = F.col("doc").cast("string") if stem is None else stem
    regioned = regions(headings(blocks))
    names = document_names(regioned, stem)
    body = quote_depth(regioned.filter("pos >= start AND pos < finish"))
    ordered = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    flush = F.col("level").isNotNull() & ~((F.col("level") == 5) & (F.col("depth") > 0))
    body = body.withColumn("flush", flush)
    above = F.lit(0)
    for level in range(1, 5):
        at = F.max(F.when(F.col("level") == level, F.col("pos"))).over(ordered)
        text = F.last(F.when(F.col("level") == level, _segment(level)), ignorenulls=True).over(ordered)
        body = body.withColumn(f"__at{level}", F.coalesce(at, F.lit(0))).withColumn(f"__above{level}", above if level == 1 else F.greatest(*[F.col(f"__at{k}") for k in range(1, level)], F.lit(0)))
        body = body.withColumn(f"__l{level}", F.when(F.col(f"__at{level}") > F.col(f"__above{level}"), text))
    label = F.regexp_extract("title", _CLAUSE, 1)
    number = F.when(label != "", label).otherwise(F.nullif(F.regexp_extract("title", _MERGED, 1), F.lit("")))
    last = F.max(F.when(F.col("flush"), F.struct("pos", F.when(F.col("level") == 5, number).alias("number")))).over(ordered)
    body = body.withColumn("clause", F.sum(F.col("flush").cast("int")).over(ordered)).withColumn("khoan_number", last["number"])
    crumbs = body.join(names, "doc").withColumn("breadcrumb", F.concat_ws(" - ", "source_document", *[f"__l{k}" for k in range(1, 5)]))
    return crumbs.withColumn("dieu_seen", F.col("__l4").isNotNull()).drop(*[f"__{n}{k}" for n in ("at", "above", "l") for k in range(1, 5)])


def is_table(block: Column) -> Column:
    return block.rlike("^\\s*\\|") | block.rlike("(?i)^\\s*<table\\b")


def clause_rows(tracked: DataFrame) -> DataFrame:
    """doc, clause, source_document, breadcrumb, khoan_number, content, has_table, raw_table of each clause that holds
    anything and has a number or an article."""
    merged = F.when(F.col("level") == 5, F.nullif(F.trim(F.regexp_extract("title", _MERGED, 2)), F.lit("")))
    table = is_table(F.col("block"))
    paragraph = (
        F.when(F.col("flush"), merged)
        .when(F.col("level").isNotNull(), F.col("title"))
        .when(F.col("block").startswith(">") | table, None)
        .otherwise(F.col("block"))
    )
    raw = F.when(F.col("level").isNull() & ~F.col("block").startswith(">") & table, F.col("block"))

    def joined(c: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("pos", c.alias("x")))))
        return F.array_join(F.transform(found, lambda r: r["x"]), "\n\n")

    grouped = tracked.filter("khoan_number IS NOT NULL OR dieu_seen").groupBy("doc", "clause", "source_document", "breadcrumb", "khoan_number").agg(
        joined(paragraph).alias("content"), joined(raw).alias("raw")
    )
    content = F.regexp_replace("content", "^\\s+|\\s+$", "")
    return grouped.select(
        "doc", "clause", "source_document", "breadcrumb", "khoan_number", content.alias("content"),
        (F.col("raw") != "").alias("has_table"), F.nullif("raw", F.lit("")).alias("raw_table"),
    ).filter("content <> '' OR has_table")


# Tables


def standard_pipe_table(raw: Column) -> Column:
    """One line per data row: its first cell, then column: value; <br> of headers vanish, cells beyond them have no
    name."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, "^\\|+|\\|+$", ""), "\\|"), lambda x: F.trim(x)))
    rows = F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]+$")))

    def line(header: Column, row: Column) -> Column:
        cells = F.transform(
            row, lambda c, k: F.when(k == 0, c).otherwise(F.concat(F.coalesce(F.regexp_replace(F.get(header, k), "(?i)<br\\s*/?>", ""), F.lit("")), F.lit(": "), c))
        )
        return F.array_join(cells, " - ")

    def render(t: Column) -> Column:
        return F.array_join(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda r: line(F.get(t, F.lit(0)), r)), "\n")

    return F.get(F.transform(F.array(rows), lambda t: F.when(F.size(t) < 2, "").otherwise(render(t))), F.lit(0))


def decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    """Entities decoded; texts without one stay in the JVM."""
    return F.when(F.contains(text, F.lit("&")), pandas_udf(decode_entities, "string")(text)).otherwise(text)


def standard_html_table(raw: Column) -> Column:
    """The cells of a formula table, <br> as a blank, joined by blanks."""
    cells = F.regexp_extract_all(raw, F.lit("(?is)<td>(.*?)</td>"), F.lit(1))
    texts = F.filter(F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "(?i)<br\\s*/?>", " "))), lambda c: c != "")
    return unescape(F.array_join(texts, " "))


def standard_table(raw: Column) -> Column:
    is_html = F.lower(F.ltrim(raw)).startswith("<table")
    return F.when(is_html, standard_html_table(raw)).otherwise(standard_pipe_table(raw))


def gfm_table(rows: Column) -> Column:
    """A pipe table from an array of rows of cells: ragged rows padded, pipes escaped, lines of a cell joined by <br>."""
    width = F.array_max(F.transform(rows, F.size))
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))))

    def line(r: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))

    ruled = F.concat(F.slice(cells, 1, 1), F.array(F.array_repeat(F.lit("---"), width)), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))))
    return F.when(F.size(rows) > 1, F.array_join(F.transform(ruled, line), "\n"))


def html_row(cells: Column) -> Column:
    """A table of one row, as HTML with escaped cells."""
    escaped = F.transform(cells, lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")))
    body = F.transform(escaped, lambda c: F.concat(F.lit("      <td>"), F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("</td>\n")))
    return F.concat(F.lit("<table>\n  <tbody>\n    <tr>\n"), F.array_join(body, ""), F.lit("    </tr>\n  </tbody>\n</table>"))


# Splitting


def points(content: Column) -> Column:
    """Paragraphs with the number of labelled points begun so far, as array of struct(k, label, text)."""
    paragraphs = F.transform(F.split(content, "\n\n"), lambda p: F.struct(p.alias("p"), F.regexp_extract(F.trim(p), "^([a-zđư])\\)\\s+([\\s\\S]*)$", 1).alias("label")))
    return F.aggregate(
        paragraphs,
        F.array().cast("array<struct<k:int,label:string,text:string>>"),
        lambda acc, x: F.concat(
            acc,
            F.array(
                F.struct(
                    (F.coalesce(F.get(acc, F.size(acc) - 1)["k"], F.lit(0)) + F.when(x["label"] != "", 1).otherwise(0)).cast("int").alias("k"),
                    F.nullif(x["label"], F.lit("")).alias("label"),
                    F.when(x["label"] != "", F.regexp_replace(F.trim(x["p"]), "^([a-zđư])\\)\\s+", "")).otherwise(x["p"]).alias("text"),
                )
            ),
        ),
    )


_POINT = re.compile(r"([a-zđư])\)\s+(.*)", re.S)
_SENTENCE, _COMMA = re.compile(r"(?<=[.;])\s+"), re.compile(r",\s+")


def _pieces(text: str, cut: re.Pattern) -> list[str]:
    return [p for p in (x.strip() for x in cut.split(text)) if p]


def split_content(content: str, budget: int, count: Callable[[str], int] = lambda t: len(t.split())) -> list[tuple[str, list[str]]]:
    """Parts (text, point labels) of a clause: packed points with the lead-in before each part, else packed sentences.
    A unit over the budget is cut into sentences, then at commas, and such pieces overlap by one where that fits."""
    lead: list[str] = []
    found: list[tuple[str, list[str]]] = []
    for p in content.split("\n\n"):
        m = _POINT.fullmatch(p.strip())
        if m and "\n" not in p.strip():
            found.append((m[1], [m[2]]))
        elif found:
            found[-1][1].append(p)
        else:
            lead.append(p)
    head = "\n\n".join(lead).strip() if found else ""
    units = [(label, "\n\n".join(parts)) for label, parts in found] or [(None, s) for s in _pieces(content, _SENTENCE)]
    room = budget - count(head) if head else budget

    def broken(label: str | None, text: str, cuts: list[re.Pattern]) -> list[tuple[list[tuple[str | None, str]], str]]:
        for k, cut in enumerate(cuts):
            pieces = _pieces(text, cut)
            if len(pieces) > 1:
                return packed([(label, p) for p in pieces], cuts[k + 1 :], " ", True)
        return [([(label, text)], " ")]

    def packed(items, cuts, joiner, overlap):
        out, now, size = [], [], 0
        for label, text in items:
            n = count(text)
            if n > room:
                if now:
                    out.append((now, joiner))
                now, size = [], 0
                out.extend(broken(label, text, cuts))
            elif now and size + n > room:
                out.append((now, joiner))
                last = count(now[-1][1])
                carry = [now[-1]] if overlap and last + n <= room else []
                now, size = [*carry, (label, text)], n + (last if carry else 0)
            else:
                now.append((label, text))
                size += n
        if now:
            out.append((now, joiner))
        return out

    parts = packed(units, [_SENTENCE, _COMMA], "\n\n" if found else " ", False)
    return [
        ((head + "\n\n" if head else "") + joiner.join(t for _, t in group), list(dict.fromkeys(x for x, _ in group if x and found)))
        for group, joiner in parts
    ]


def chunks(clauses: DataFrame, max_tokens: int = MAX_TOKENS, count: Callable[[Column], Column] = word_count) -> DataFrame:
    """Chunks of clauses: table clauses and those within the budget as they are, the others split."""
    base = F.when(F.col("khoan_number").isNotNull(), F.concat("breadcrumb", F.lit(" - Khoản "), "khoan_number")).otherwise(F.col("breadcrumb"))
    based = clauses.withColumn("base", base).withColumn("tokens", count(F.col("content")))
    table_text = F.when(F.col("has_table"), standard_table(F.col("raw_table")))
    narrative = F.when(F.col("content") == "", table_text).otherwise(F.concat("content", F.lit("\n\n"), table_text))

    @pandas_udf("array<struct<text:string,labels:array<string>>>")
    def cut(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: [{"text": t, "labels": x} for t, x in split_content(c, max_tokens)])

    whole = based.filter(F.col("has_table") | (F.col("tokens") <= max_tokens)).select(
        "doc", "clause", F.lit(1).alias("part"), F.lit(1).alias("parts"), "source_document", F.col("base").alias("breadcrumb"),
        F.when(F.col("has_table"), narrative).otherwise(F.col("content")).alias("content"), "has_table", "raw_table",
    )
    split = based.filter(~F.col("has_table") & (F.col("tokens") > max_tokens)).withColumn("cut", cut("content"))
    one = split.select("*", F.size("cut").alias("n"), F.posexplode("cut").alias("k", "piece"))
    labels = F.array_join("piece.labels", ", ")
    part = F.concat(F.lit("(phần "), F.col("k") + 1, F.lit("/"), F.col("n"), F.lit(")"))
    crumb = F.when(F.col("n") <= 1, F.col("base")).when(labels == "", F.concat_ws(" ", "base", part)).otherwise(F.concat("base", F.lit(" - Điểm "), labels, F.lit(" "), part))
    parts = one.select(
        "doc", "clause", (F.col("k") + 1).alias("part"), F.col("n").alias("parts"), "source_document", crumb.alias("breadcrumb"),
        F.col("piece.text").alias("content"), "has_table", "raw_table",
    )
    return whole.unionByName(parts).select("*", chunk_id(F.col("source_document"), F.col("breadcrumb")).alias("chunk_id"), count(F.col("content")).alias("token_count"))


def chunk_id(source_document: Column, breadcrumb: Column) -> Column:
    return F.sha2(F.concat(source_document, F.lit("::"), breadcrumb), 256)


def split_unique(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of documents whose ids are all unique, and the ids that repeat, with their document."""
    bad = found.groupBy("doc", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(bad.select("doc").distinct(), "doc", "left_anti"), bad
