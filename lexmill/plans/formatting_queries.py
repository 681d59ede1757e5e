"""Queries of formatting: blocks made from the legal view, emitted and validated again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as fn
from lexmill.operators import formatting, ranking, whole_files
from lexmill.registry import query
from lexmill.sources import legal_view
from lexmill.sources.tables import read

# The blocks of the view without heading marks: what a document holds before it is formatted.
RAW_CTE = f"""
v AS ({legal_view.BLOCKS_SQL}),
raw AS (SELECT doc, pos, CASE WHEN starts_with(block, '|') OR starts_with(block, '<table') OR starts_with(block, 'Nơi nhận:') THEN 'table' ELSE 'paragraph' END AS kind,
  CASE WHEN starts_with(block, '##### Khoản ') THEN substr(block, 13) || '. Nội dung khoản' ELSE regexp_replace(block, '^(#+ |\\*\\*)|\\*\\*$', '', 'g') END AS text FROM v)
"""


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(legal_view.blocks(spark, sf_dir))


def _raw(blocks: DataFrame) -> DataFrame:
    """Blocks as kind and text, with their other columns."""
    b = F.col("block")
    kind = F.when(b.startswith("|") | b.startswith("<table") | b.startswith("Nơi nhận:"), "table").otherwise("paragraph")
    text = F.when(b.startswith("##### Khoản "), F.concat(F.substring("block", 13, 1000), F.lit(". Nội dung khoản"))).otherwise(F.regexp_replace("block", "^(#+ |\\*\\*)|\\*\\*$", ""))
    return blocks.withColumns({"kind": kind, "text": text}).drop("block")


_STRUCT = "(regexp_matches(text, '(?i)^(PHỤ\\s+LỤC|Phần\\s+(thứ\\s+)?([IVXLCDM]+|\\d+)|Chương\\s+([IVXLCDM]+|\\d+)|Mục\\s+\\d+)') OR regexp_matches(text, '^Điều\\s+\\d+[a-zđ]?\\s*\\.'))"
ZONE_CTE = f"""{RAW_CTE},
z0 AS (SELECT *, coalesce(min(CASE WHEN kind = 'paragraph' AND {_STRUCT} THEN pos END) OVER d, max(pos) OVER d + 1) AS front, coalesce(max(CASE WHEN kind = 'table' AND contains(text, 'Nơi nhận:') THEN pos END) OVER d, max(pos) OVER d + 1) AS back FROM raw WINDOW d AS (PARTITION BY doc)),
z AS (SELECT *, CASE WHEN pos > back THEN 'back' WHEN pos = back THEN 'signature' WHEN pos < front THEN 'front' ELSE 'middle' END AS zone FROM z0)
"""


@query("front_back_boundary", f"WITH {ZONE_CTE} SELECT doc, CAST(min(front) AS INTEGER) AS front, CAST(max(back) AS INTEGER) AS back FROM z GROUP BY doc")
def front_back_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.boundaries(raw_blocks(spark, sf_dir)).groupBy("doc").agg(F.min("front").alias("front"), F.max("back").alias("back"))


@query("block_zones", f"WITH {ZONE_CTE} SELECT doc, zone, count(*) AS n FROM z GROUP BY doc, zone")
def block_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.boundaries(raw_blocks(spark, sf_dir)).groupBy("doc", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("title_lookup", f"WITH {RAW_CTE} SELECT doc, arg_min(after, pos) AS title FROM (SELECT *, lead(text) OVER (PARTITION BY doc ORDER BY pos) AS after FROM raw WHERE kind = 'paragraph') WHERE text = 'NGHỊ ĐỊNH' GROUP BY doc")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.titles(raw_blocks(spark, sf_dir))


_EMITTED = f"""WITH {ZONE_CTE}, m AS (SELECT doc, pos, kind, CASE WHEN kind = 'paragraph' THEN trim(regexp_replace(text, '\\[\\d+\\]', '', 'g')) ELSE text END AS text FROM z WHERE zone = 'middle'),
    k AS (SELECT *, CASE WHEN kind = 'table' THEN NULL WHEN regexp_matches(text, '(?i)^Chương\\s') THEN '##' WHEN regexp_matches(text, '(?i)^Mục\\s+\\d') THEN '###' WHEN regexp_matches(text, '^Điều\\s+\\d+\\s*\\.') THEN '####' WHEN regexp_matches(text, '^\\d+[a-zđ]?\\s*\\.\\s+') THEN '#####' END AS mark FROM m)
    SELECT doc, pos, CAST(0 AS INTEGER) AS part, CASE mark WHEN '#####' THEN '##### Khoản ' || regexp_extract(text, '^(\\d+[a-zđ]?)', 1) ELSE coalesce(mark || ' ', '') || text END AS line FROM k
    UNION ALL SELECT doc, pos, 1, regexp_extract(text, '^\\d+[a-zđ]?\\s*\\.\\s+(.*)$', 1) FROM k WHERE mark = '#####'"""


@query("emit_headings", _EMITTED)
def emit_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = formatting.boundaries(raw_blocks(spark, sf_dir)).filter("zone = 'middle'").select("doc", "pos", "kind", "text")
    return formatting.emit(middle)


@query(
    "strip_markers",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 5 WHEN 0 THEN '3.3[3] Mức ' || l_partkey WHEN 1 THEN '10.[15] Mức ' || l_partkey || ' ,' WHEN 2 THEN '[4]4 a' || l_partkey WHEN 3 THEN 'a)2[2] Thành lập ' || l_partkey ELSE 'Điều ' || l_partkey || ' a[16]  x' END AS r FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '3. Mức ' || substr(r, 12) WHEN 1 THEN replace(replace(r, '[15]', ''), ' ,', ',') WHEN 2 THEN substr(r, 6) WHEN 3 THEN 'a) Thành lập ' || substr(r, 18) ELSE replace(r, '[16]  x', ' x') END AS text FROM t""",
)
def strip_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE l_linenumber % 5 WHEN 0 THEN concat('3.3[3] Mức ', l_partkey) WHEN 1 THEN concat('10.[15] Mức ', l_partkey, ' ,') WHEN 2 THEN concat('[4]4 a', l_partkey) WHEN 3 THEN concat('a)2[2] Thành lập ', l_partkey) ELSE concat('Điều ', l_partkey, ' a[16]  x') END")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.strip_markers(text).alias("text"))


_LINES = f"""
t AS ({legal_view.TEXT_SQL}),
l0 AS (SELECT doc, i AS line_no, rtrim(parts[i]) AS line FROM (SELECT doc, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc, string_split(text, chr(10)) AS parts FROM t))),
l AS (SELECT *, CASE WHEN starts_with(line, '<table>') OR starts_with(line, '|') THEN 0 ELSE length(regexp_extract(line, '^(#*)', 1)) END AS hashes FROM l0),
c AS (SELECT *, trim(substr(line, hashes + 1)) AS content FROM l),
p AS (SELECT *, CASE WHEN hashes = 4 THEN 'dieu:' || regexp_extract(content, '^Điều\\s+(\\d+)', 1) WHEN hashes = 1 THEN 'phan:' || content END AS mark FROM c),
g AS (SELECT *, sum(CASE WHEN mark IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS grp FROM p),
n AS (SELECT *, first_value(mark) OVER (PARTITION BY doc, grp ORDER BY line_no) AS parent, trim(string_split(regexp_replace(content, '^Khoản ', ''), '.')[1]) AS num FROM g)
"""


@query(
    "validate_monotonic",
    f"""WITH {_LINES}, k AS (SELECT doc, parent, num, line_no, CAST(num AS INTEGER) <= lag(CAST(num AS INTEGER)) OVER (PARTITION BY doc, parent ORDER BY line_no) AS bad FROM n WHERE hashes = 5),
    a AS (SELECT doc, regexp_extract(content, '^Điều\\s+(\\d+)', 1) AS num, line_no FROM c WHERE hashes = 4),
    b AS (SELECT *, CAST(num AS INTEGER) <= lag(CAST(num AS INTEGER)) OVER (PARTITION BY doc ORDER BY line_no) AS bad FROM a)
    SELECT doc, 'khoan_not_monotonic' AS code, parent || ' -> khoản ' || num AS detail FROM k WHERE bad UNION ALL SELECT doc, 'dieu_not_monotonic', 'Điều ' || num FROM b WHERE bad""",
)
def validate_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.validate_lines(legal_view.lines(spark, sf_dir)).filter("code LIKE '%monotonic'")


@query(
    "validate_headings",
    f"""WITH {_LINES}, art AS (SELECT *, sum(CASE WHEN hashes IN (1, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS ag FROM c),
    e AS (SELECT doc, ag, min(CASE WHEN hashes = 4 THEN content END) AS article, max(CASE WHEN hashes = 5 OR hashes = 0 AND trim(line) <> '' THEN 1 ELSE 0 END) AS holds FROM art GROUP BY doc, ag)
    SELECT doc, 'empty_dieu' AS code, count(*) AS n FROM e WHERE article IS NOT NULL AND holds = 0 GROUP BY doc
    UNION ALL SELECT doc, 'orphan_footnote', CAST(sum(len(regexp_extract_all(text, '\\[\\d{{1,3}}\\]'))) AS BIGINT) AS n FROM t GROUP BY doc HAVING n > 0""",
)
def validate_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting.validate_lines(legal_view.lines(spark, sf_dir)).filter("code NOT LIKE '%monotonic'")
    return found.groupBy("doc", "code").agg(F.count(F.lit(1)).alias("n"))


@query("qc_counts", f"WITH {_LINES} SELECT 'orphan_footnote' AS code, CAST(sum(len(regexp_extract_all(text, '\\[\\d{{1,3}}\\]'))) AS BIGINT) AS n FROM t HAVING n > 0")
def qc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting.orphan_footnotes(legal_view.lines(spark, sf_dir))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc())


@query(
    "setext_escape",
    "SELECT n_nationkey, n_name || chr(10) || chr(10) || '-----' || chr(10) || chr(10) || '===' || chr(10) || 'x' || chr(10) || '--' AS text FROM nation",
)
def setext_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("n_name", F.lit("\n-----\n\n===\nx\n--"))
    return read(spark, sf_dir, "nation").select("n_nationkey", fn.escape_setext(text).alias("text"))


@query(
    "pack_blocks_llm",
    f"""WITH RECURSIVE {RAW_CTE}, s AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos) AS INTEGER) AS i, length(text) AS n FROM raw),
    p(doc, i, g, total) AS (SELECT doc, i, 0, n FROM s WHERE i = 1 UNION ALL SELECT s.doc, s.i, CASE WHEN total + n <= 1250 THEN g ELSE g + 1 END, CASE WHEN total + n <= 1250 THEN total + n ELSE n END FROM p JOIN s ON s.doc = p.doc AND s.i = p.i + 1)
    SELECT doc, CAST(g AS INTEGER) AS g, count(*) AS n_blocks, CAST(sum(n) AS BIGINT) AS n_chars FROM p JOIN s USING (doc, i) GROUP BY doc, g""",
)
def pack_blocks_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks packed for a rewriter of 500 tokens, at 2.5 characters each."""
    limit = int(500 * formatting.CHARS_PER_TOKEN)
    rows = ranking.packed_over_ranges(_raw(legal_view.placed(spark, sf_dir)), ["doc"], ["pos"], F.length("text"), limit)
    return rows.groupBy("doc", F.col("group").cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("size").alias("n_chars"))


@query("serialize_blocks", f"WITH {RAW_CTE} SELECT doc, string_agg(CASE WHEN kind = 'paragraph' THEN m || text || m ELSE text END, chr(10) || chr(10) ORDER BY pos) AS text FROM (SELECT *, CASE WHEN pos % 6 = 0 THEN '***' WHEN pos % 2 = 0 THEN '**' WHEN pos % 3 = 0 THEN '*' ELSE '' END AS m FROM raw) GROUP BY doc")
def serialize_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.serialize(raw_blocks(spark, sf_dir).selectExpr("*", "pos % 2 = 0 AS is_bold", "pos % 3 = 0 AS is_italic"))


@query(
    "assemble_regions",
    f"WITH {ZONE_CTE}, r AS (SELECT doc, zone AS region, pos AS k, CASE WHEN doc % 4 = 1 AND zone = 'front' AND pos = 2 THEN NULL ELSE text END AS result FROM z WHERE zone IN ('front', 'back', 'signature')) SELECT doc, region, CASE WHEN count(*) = count(result) THEN string_agg(result, chr(10) || chr(10) ORDER BY k) END AS text, CASE WHEN count(*) <> count(result) THEN 'llm_failed' END AS qc FROM r GROUP BY doc, region",
)
def assemble_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formatting.boundaries(raw_blocks(spark, sf_dir)).filter("zone IN ('front', 'back', 'signature')")
    lost = (F.col("doc") % 4 == 1) & (F.col("zone") == "front") & (F.col("pos") == 2)
    return formatting.assemble(rows.select("doc", F.col("zone").alias("region"), F.col("pos").alias("k"), F.when(~lost, F.col("text")).alias("result")))


@query(
    "normalize_text",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, ' ', chr(160)), '[ \\t\\n\\r\\f\\v\\x{A0}]+', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents",
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", fn.normalize(F.replace("text", F.lit(" "), F.lit(" "))).alias("text"))


@query(
    "number_sort_key",
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS n, CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS suffix FROM lineitem",
)
def number_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("concat(CAST(l_quantity AS INT), CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END)")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.number_key(number).alias("k")).select("l_orderkey", "l_linenumber", "k.*")


@query(
    "whole_markdown",
    f"""WITH e AS ({_EMITTED}), b AS (SELECT doc, string_agg(line, chr(10) || chr(10) ORDER BY pos, part) AS body FROM e GROUP BY doc),
    {ZONE_CTE}, f AS (SELECT doc, string_agg(CASE WHEN pos = 3 THEN '# ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos) FILTER (zone = 'front') AS front, count(*) FILTER (zone = 'signature') AS n_dropped FROM z GROUP BY doc)
    SELECT doc, front || chr(10) || chr(10) || body || chr(10) AS text, n_dropped FROM f JOIN b USING (doc)""",
)
def whole_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: front with its title, body, and the signature table dropped with a warning."""
    found = whole_files.compose(raw_blocks(spark, sf_dir), whole_files.plain_rewriter)
    dropped = F.filter("warnings", lambda w: w["code"] == whole_files.DROPPED_TABLE)
    return found.select("doc", "text", F.size(dropped).cast("long").alias("n_dropped"))
