"""Queries of chunking over the synthesised legal Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as fn
from lexmill.operators import chunking, ranking
from lexmill.registry import query
from lexmill.sources import legal_view
from lexmill.sources.tables import read

HEAD_CTE = f"""
blocks AS ({legal_view.BLOCKS_SQL}),
h0 AS (SELECT *, length(regexp_extract(block, '^(#{{1,5}})\\s+(.*)$', 1)) AS n, trim(regexp_extract(block, '^(#{{1,5}})\\s+(.*)$', 2)) AS t FROM blocks),
h AS (SELECT doc, pos, block, CASE WHEN n > 0 THEN n END AS level, CASE WHEN n > 0 THEN t END AS title FROM h0),
hs AS (SELECT *, CASE level WHEN 1 THEN regexp_matches(title, '(?i)^(PHỤ\\s+LỤC|Phần\\s+(thứ\\s+)?([IVXLCDM]+|\\d+))') WHEN 2 THEN regexp_matches(title, '(?i)^Chương\\s+([IVXLCDM]+|\\d+)')
  WHEN 3 THEN regexp_matches(title, '(?i)^Mục\\s+\\d+') WHEN 4 THEN regexp_matches(title, '^Điều\\s+\\d+[a-zđ]?\\s*\\.') WHEN 5 THEN regexp_matches(title, '(?i)^Khoản\\s+\\d+[a-zđ]?$') OR regexp_matches(title, '^\\d+[a-zđ]?\\.\\s+') ELSE false END AS structural FROM h),
r0 AS (SELECT *, coalesce(min(CASE WHEN structural THEN pos END) OVER d, max(pos) OVER d + 1) AS start FROM hs WINDOW d AS (PARTITION BY doc)),
r AS (SELECT *, coalesce(min(CASE WHEN block = '---' AND pos >= start THEN pos END) OVER d, max(pos) OVER d + 1) AS finish FROM r0 WINDOW d AS (PARTITION BY doc)),
names AS (SELECT doc, arg_min(b || ' ' || title, pos) AS source_document FROM (SELECT *, trim(lag(block) OVER (PARTITION BY doc ORDER BY pos), '* ') AS b FROM r) WHERE pos < start AND level = 1 GROUP BY doc),
q0 AS (SELECT *, sum(CASE WHEN level <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS g, CASE WHEN level IS NULL THEN length(block) - length(replace(block, '“', '')) - length(block) + length(replace(block, '”', '')) ELSE 0 END AS d FROM r WHERE pos >= start AND pos < finish),
q1 AS (SELECT *, sum(d) OVER (PARTITION BY doc, g ORDER BY pos) AS s FROM q0),
q AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc, g ORDER BY pos)) AS depth FROM q1),
f AS (SELECT *, level IS NOT NULL AND NOT (level = 5 AND depth > 0) AS flush FROM q),
lv AS (SELECT *, sum(CASE WHEN flush THEN 1 ELSE 0 END) OVER o AS clause,
  coalesce(max(CASE WHEN level = 1 THEN pos END) OVER o, 0) AS p1, coalesce(max(CASE WHEN level = 2 THEN pos END) OVER o, 0) AS p2, coalesce(max(CASE WHEN level = 3 THEN pos END) OVER o, 0) AS p3, coalesce(max(CASE WHEN level = 4 THEN pos END) OVER o, 0) AS p4, max(CASE WHEN flush THEN pos END) OVER o AS pf FROM f WINDOW o AS (PARTITION BY doc ORDER BY pos)),
tr AS (SELECT lv.*, source_document, concat_ws(' - ', source_document, CASE WHEN p1 > 0 THEN t1.title END, CASE WHEN p2 > p1 THEN t2.title END, CASE WHEN p3 > greatest(p1, p2) THEN t3.title END, CASE WHEN p4 > greatest(p1, p2, p3) THEN t4.title END) AS breadcrumb,
  p4 > greatest(p1, p2, p3) AS dieu_seen, CASE WHEN tf.level = 5 THEN nullif(regexp_extract(tf.title, '^(?:Khoản )?(\\d+[a-zđ]?)', 1), '') END AS khoan_number
  FROM lv JOIN names USING (doc) LEFT JOIN h t1 ON t1.doc = lv.doc AND t1.pos = p1 LEFT JOIN h t2 ON t2.doc = lv.doc AND t2.pos = p2 LEFT JOIN h t3 ON t3.doc = lv.doc AND t3.pos = p3 LEFT JOIN h t4 ON t4.doc = lv.doc AND t4.pos = p4 LEFT JOIN h tf ON tf.doc = lv.doc AND tf.pos = pf),
cr AS (SELECT *, regexp_matches(block, '^\\s*(\\||<table)') AS is_table, CASE WHEN flush THEN CASE WHEN level = 5 THEN nullif(regexp_extract(title, '^\\d+[a-zđ]?\\.\\s+(.*)$', 1), '') END WHEN level IS NOT NULL THEN title WHEN starts_with(block, '>') OR regexp_matches(block, '^\\s*(\\||<table)') THEN NULL ELSE block END AS para FROM tr),
clauses AS (SELECT doc, clause, source_document, breadcrumb, khoan_number, coalesce(string_agg(para, chr(10) || chr(10) ORDER BY pos), '') AS content, coalesce(bool_or(is_table), false) AS has_table,
  string_agg(CASE WHEN is_table THEN block END, chr(10) || chr(10) ORDER BY pos) AS raw_table FROM cr WHERE khoan_number IS NOT NULL OR dieu_seen GROUP BY doc, clause, source_document, breadcrumb, khoan_number
  HAVING coalesce(string_agg(para, '' ORDER BY pos), '') <> '' OR coalesce(bool_or(is_table), false))
"""


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.track(legal_view.blocks(spark, sf_dir))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.clause_rows(_tracked(spark, sf_dir))


@query(
    "block_split",
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS pos, block FROM (SELECT doc_id, i, trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS block FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), '\\n{2,}') AS parts FROM documents))) WHERE block <> ''",
)
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences stand apart by blank lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n\n")).alias("text"))
    return chunking.split_blocks(docs, "doc_id")


@query("heading_tracker", f"WITH {HEAD_CTE} SELECT doc, pos, CAST(level AS INTEGER) AS level, title, structural, CAST(start AS INTEGER) AS start, CAST(finish AS INTEGER) AS finish FROM r")
def heading_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.regions(chunking.headings(legal_view.blocks(spark, sf_dir)))
    return found.select("doc", "pos", "level", "title", "structural", "start", "finish")


@query("document_names", f"WITH {HEAD_CTE} SELECT doc, source_document FROM names")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.document_names(chunking.regions(chunking.headings(legal_view.blocks(spark, sf_dir))), F.col("doc").cast("string"))


@query("breadcrumbs", f"WITH {HEAD_CTE} SELECT doc, pos, breadcrumb, khoan_number, dieu_seen FROM tr")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).select("doc", "pos", "breadcrumb", "khoan_number", "dieu_seen")


@query("quote_depth", f"WITH {HEAD_CTE} SELECT doc, pos, CAST(depth AS INTEGER) AS depth FROM q")
def quote_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).select("doc", "pos", "depth")


@query("clause_flush", f"WITH {HEAD_CTE} SELECT doc, CAST(clause AS BIGINT) AS clause, breadcrumb, khoan_number, content, has_table, raw_table FROM clauses")
def clause_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("doc", "clause", "breadcrumb", "khoan_number", "content", "has_table", "raw_table")


@query(
    "back_region",
    f"WITH {HEAD_CTE} SELECT doc, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text FROM r WHERE pos > finish GROUP BY doc",
)
def back_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.regions(chunking.headings(legal_view.blocks(spark, sf_dir))).filter("pos > finish")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return found.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("text"))


@query(
    "chunk_ids",
    f"WITH {HEAD_CTE}, b AS (SELECT *, breadcrumb || coalesce(' - Khoản ' || khoan_number, '') AS base FROM clauses) SELECT doc, CAST(clause AS BIGINT) AS clause, base AS breadcrumb, sha256(source_document || '::' || base) AS chunk_id FROM b",
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a budget that no clause exceeds."""
    return chunking.chunks(clauses(spark, sf_dir), 1_000_000).select("doc", "clause", "breadcrumb", "chunk_id")


@query("split_khoan")
def split_khoan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing with overlap and a small budget; held against literals in the tests."""
    return chunking.chunks(clauses(spark, sf_dir), 24)


@query(
    "unique_chunk_ids",
    f"WITH {HEAD_CTE}, b AS (SELECT doc, sha256(source_document || '::' || breadcrumb || coalesce(' - Khoản ' || khoan_number, '')) AS chunk_id FROM clauses) SELECT doc, chunk_id, count(*) AS n FROM b GROUP BY doc, chunk_id HAVING count(*) > 1",
)
def unique_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that repeat within their document, which fail it."""
    return chunking.split_unique(chunking.chunks(clauses(spark, sf_dir), 1_000_000))[1]


@query(
    "split_points",
    f"""WITH {HEAD_CTE}, p AS (SELECT doc, clause, i, parts[i] AS p FROM (SELECT doc, clause, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc, clause, string_split(content, chr(10) || chr(10)) AS parts FROM clauses))),
    l AS (SELECT *, regexp_extract(p, '^([a-zđư])\\)\\s+', 1) AS label FROM p)
    SELECT doc, CAST(clause AS BIGINT) AS clause, CAST(sum(CASE WHEN label <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, clause ORDER BY i) AS INTEGER) AS k, nullif(label, '') AS label, CASE WHEN label <> '' THEN regexp_replace(p, '^([a-zđư])\\)\\s+', '') ELSE p END AS text FROM l""",
)
def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("doc", "clause", F.explode(chunking.points(F.col("content"))).alias("p")).select("doc", "clause", "p.*")


_SENTENCES = "string_split(regexp_replace(text, '([.;])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    "split_sentences",
    f"SELECT doc_id, i AS k, s AS sentence FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS s FROM (SELECT doc_id, [trim(x) FOR x IN {_SENTENCES} IF trim(x) <> ''] AS parts FROM documents))",
)
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.sentences(F.col("text"))).alias("k", "sentence"))
    return found.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "sentence")


@query(
    "pack_units",
    f"""WITH RECURSIVE s AS (SELECT doc_id, i, len(list_filter(string_split_regex(sentence, '\\s+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS sentence FROM (SELECT doc_id, [trim(x) FOR x IN {_SENTENCES} IF trim(x) <> ''] AS parts FROM documents))),
    p(doc_id, i, g, total) AS (SELECT doc_id, i, 0, n FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN total + n <= 60 THEN g ELSE g + 1 END, CASE WHEN total + n <= 60 THEN total + n ELSE n END FROM p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
    SELECT doc_id, CAST(g AS INTEGER) AS g, count(*) AS n_units FROM p GROUP BY doc_id, g""",
)
def pack_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed greedily into groups of at most 60 words."""
    sized = read(spark, sf_dir, "documents").select("doc_id", F.transform(fn.sentences(F.col("text")), fn.word_count).alias("sizes"))
    return sized.select("doc_id", F.explode(ranking.packed_groups(F.col("sizes"), 60)).alias("g")).groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n_units"))


@query(
    "table_standardize",
    f"""WITH {HEAD_CTE}, t AS (SELECT doc, clause, CAST(regexp_extract(raw_table, '\\| 1 \\| (-?\\d+)', 1) AS BIGINT) AS v, raw_table FROM clauses WHERE has_table AND starts_with(raw_table, '|') AND NOT contains(raw_table, '<table'))
    SELECT doc, CAST(clause AS BIGINT) AS clause, '1 - Mứchưởng: ' || v || ' - Ghi chú: x' || chr(10) || '2 - Mứchưởng: ' || (v + 1) || ' - Ghi chú: ' AS text FROM t""",
)
def table_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clauses(spark, sf_dir).filter("has_table AND raw_table LIKE '|%' AND raw_table NOT LIKE '%<table%'")
    return found.select("doc", "clause", chunking.standard_table(F.col("raw_table")).alias("text"))


@query(
    "html_formula",
    f"WITH {HEAD_CTE} SELECT doc, CAST(clause AS BIGINT) AS clause, 'Lương = ' || regexp_extract(raw_table, '=<br>(\\d+)', 1) || ' x & y' AS text FROM clauses WHERE starts_with(raw_table, '<table')",
)
def html_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clauses(spark, sf_dir).filter("raw_table LIKE '<table%'")
    return found.select("doc", "clause", chunking.standard_table(F.col("raw_table")).alias("text"))


@query(
    "table_to_gfm",
    "SELECT p_partkey, '| ' || p_name || ' | ' || replace(p_brand || '|x', '|', chr(92) || '|') || ' | size |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || p_type || ' | ' || p_size || '<br>cm |  |' AS markdown FROM part",
)
def table_to_gfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(F.array(F.col("p_name"), F.concat("p_brand", F.lit("|x")), F.lit("size")), F.array(F.col("p_type"), F.concat("p_size", F.lit("\ncm"))))
    return read(spark, sf_dir, "part").select("p_partkey", chunking.gfm_table(rows).alias("markdown"))


@query("table_row_html", "SELECT p_partkey, '<table>' || chr(10) || '  <tbody>' || chr(10) || '    <tr>' || chr(10) || '      <td>' || p_name || ' &lt; &amp;</td>' || chr(10) || '      <td>' || p_size || '<br>cm</td>' || chr(10) || '    </tr>' || chr(10) || '  </tbody>' || chr(10) || '</table>' AS markup FROM part")
def table_row_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.concat("p_name", F.lit(" < &")), F.concat("p_size", F.lit("\ncm")))
    return read(spark, sf_dir, "part").select("p_partkey", chunking.html_row(cells).alias("markup"))


@query(
    "directory_summary",
    f"WITH {HEAD_CTE} SELECT doc, count(*) AS n_chunks, count(*) FILTER (has_table) AS n_tables FROM clauses GROUP BY doc",
)
def directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.chunks(clauses(spark, sf_dir), 1_000_000)
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("has_table").alias("n_tables"))
