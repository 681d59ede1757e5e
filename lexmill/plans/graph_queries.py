"""Queries of the graph of texts and of the causes of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import causes, graph
from lexmill.registry import query
from lexmill.sources.tables import read

# Entities of a document: its distinct words of ten letters or more.
GRAPH_SQL = """
ent AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-zà-ÿ]{10,}'))) AS e FROM documents),
cls AS (SELECT *, min(doc_id) OVER (PARTITION BY e) AS class, count(*) OVER (PARTITION BY e) AS n FROM ent WHERE len(e) > 0),
rep AS (SELECT doc_id, e, len(e) AS n FROM cls WHERE doc_id = class),
tok AS (SELECT doc_id, n, unnest(e) AS t FROM rep),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM tok x JOIN tok y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
edge AS (SELECT a, b, shared, shared / (na + nb - shared) AS score FROM met WHERE shared / (na + nb - shared) >= 0.5)
"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{10,}"), F.lit(0))
    return graph.classes(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), words.alias("entities")))


@query("graph_classes", f"WITH {GRAPH_SQL} SELECT doc_id AS node, class, n FROM cls")
def graph_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select("node", "class", "n")


@query("graph_edges", f"WITH {GRAPH_SQL} SELECT a, b, shared, round(score, 6) AS score FROM edge")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(members(spark, sf_dir)).withColumn("score", F.round("score", 6))


_CLUSTERS = f"""WITH {GRAPH_SQL}, nb AS (SELECT a AS node, b AS other, score FROM edge UNION ALL SELECT b, a, score FROM edge),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS k FROM nb), near AS (SELECT node, other FROM r WHERE k <= 3),
two AS (SELECT node, other FROM near UNION SELECT x.node, y.other FROM near x JOIN near y ON y.node = x.other WHERE y.other <> x.node),
t AS (SELECT node, count(*) AS n_two FROM two GROUP BY node), c AS (SELECT node, count(*) AS n_near, count(*) FILTER (k > 3) AS n_cut FROM r GROUP BY node)"""


@query("graph_clusters", f"{_CLUSTERS} SELECT node, n_near, n_cut, n_two FROM c JOIN t USING (node)")
def graph_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each class, three at most, and what two hops over these reach."""
    return graph.clusters(graph.edges(members(spark, sf_dir)), 3)


@query(
    "graph_quota",
    f"""{_CLUSTERS}, h AS (SELECT coalesce(bool_or(n_two > n_near - n_cut), false) AS abstract, count(*) > 0 AS specific FROM c JOIN t USING (node)),
    w AS (SELECT item_id, unnest([{{'kind': 'single_hop', 'n': item_id % 4, 'held': true}}, {{'kind': 'abstract', 'n': item_id % 3, 'held': abstract}}, {{'kind': 'specific', 'n': item_id % 2, 'held': specific}}], recursive := true) FROM benchmark, h)
    SELECT item_id, kind, n, round((n - 0.5) / sum(n) OVER (PARTITION BY item_id), 9) AS weight FROM w WHERE n > 0 AND held""",
)
def graph_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each item's questions are dealt to the kinds that the graph has clusters for."""
    held = graph.holds(graph.clusters(graph.edges(members(spark, sf_dir)), 3))
    items = read(spark, sf_dir, "benchmark").select("item_id").join(F.broadcast(held))  # one row
    wanted = {"single_hop": F.col("item_id") % 4, "abstract": F.col("item_id") % 3, "specific": F.col("item_id") % 2}
    rows = items.select("item_id", F.explode(graph.dealt(wanted, {k: F.col(k) for k in graph.KINDS})).alias("x")).select("item_id", "x.*")
    return rows.withColumn("weight", F.round("weight", 9))


# Errors: runs of eight events, of which each may name others as cause and context; many go in circles.
ERROR_NAMES = ["RuntimeError", "ConnectTimeout", "ValueError", "ValidationError", "KeyError", "ReadTimeout", "TypeError"]
_NAMES = ", ".join(f"'{n}'" for n in ERROR_NAMES)
EDGES = """SELECT CAST(floor(event_id / 8) AS BIGINT) AS run, event_id % 8 AS src, (event_id % 8 * 3 + 1) % 8 AS dst, 'cause' AS kind FROM {table} WHERE event_id % 3 <> 0
UNION ALL SELECT CAST(floor(event_id / 8) AS BIGINT), event_id % 8, (event_id % 8 + 2) % 8, 'context' FROM {table} WHERE event_id % 5 <> 0"""


@query(
    "cause_graph",
    f"""WITH RECURSIVE er AS (SELECT event_id // 8 AS run, event_id % 8 AS id, [{_NAMES}][1 + event_id % 7] AS name FROM events), ed AS ({EDGES.format(table="events")}), st AS (SELECT run, id FROM er WHERE id < 2),
    step AS (SELECT run, src, coalesce(min(dst) FILTER (kind = 'cause'), min(dst)) AS dst FROM ed GROUP BY run, src),
    way(run, id, root, path) AS (SELECT run, id, id, [id] FROM st UNION ALL SELECT w.run, w.id, s.dst, list_append(w.path, s.dst) FROM way w JOIN step s ON s.run = w.run AND s.src = w.root WHERE NOT list_contains(w.path, s.dst)),
    far AS (SELECT run, id, arg_max(root, len(path)) AS root, max(len(path)) - 1 AS depth FROM way GROUP BY run, id),
    met(run, id, met) AS (SELECT run, id, id FROM st UNION SELECT m.run, m.id, e.dst FROM met m JOIN ed e ON e.run = m.run AND e.src = m.met),
    about AS (SELECT m.run, m.id, count(*) AS n_errors, bool_or(name IN ('ConnectTimeout', 'ReadTimeout')) AS transport, bool_or(name = 'ValidationError') AS semantic, string_agg(DISTINCT name, ' < ' ORDER BY name) AS trace FROM met m JOIN er ON er.run = m.run AND er.id = m.met GROUP BY m.run, m.id)
    SELECT f.run, f.id, f.root, e.name AS root_name, CAST(f.depth AS INTEGER) AS depth, n_errors, transport, semantic, trace FROM far f JOIN er e ON e.run = f.run AND e.id = f.root JOIN about a ON a.run = f.run AND a.id = f.id""",
)
def cause_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and classes of the errors that each run begins with."""
    events = read(spark, sf_dir, "events")
    errors = events.selectExpr("event_id DIV 8 AS run", "event_id % 8 AS id", f"array({_NAMES})[event_id % 7] AS name")
    edges = spark.sql(EDGES.format(table="{events}"), events=events)
    return causes.describe(errors, edges, errors.filter("id < 2").select("run", "id"))
