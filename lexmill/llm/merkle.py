"""Merkle manifest of a dataset: one tree of leaf digests per group, and one tree over the groups' roots.

Every run of `fanout` neighbouring nodes becomes the SHA-256 of their hexadecimal digests, level by level, until one node
is left; the last run may be short. A tree is reduced by superblocks: the nodes whose index has the same quotient by
fanout^k are one bucket, a task collapses a bucket by k levels at once, and the roots of buckets are reduced in the same
way. A proof is the list of the siblings of a leaf and of all nodes above it. Buckets prove their nodes to the bucket's
root (the lower proof), and what is above a bucket is proved once for all its nodes (the upper proof); both are put
together where the bucket's nodes are, so proofs are never shuffled but for those of buckets.

Places come from ranges of the whole order, so a group that holds most rows, or rows that are all alike, go to many tasks.

Leaves of a group ascend by doc_id, null first; rows of the same doc_id by their digests, and equal leaves have places of
their own, so each row has its own proof. Null, empty and very long values are leaves like any other; a value is told
from its absence. A null group is a group, the first. An empty table gives no rows and has no root. Columns besides those
that are hashed don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.ranking import global_row_number

from .common import RID, join_counted, keep

FANOUT = 2
#: Levels that one task collapses: a bucket has FANOUT ** LEVELS nodes at most.
LEVELS = 12
#: The columns that a leaf hashes.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """How many levels of runs lead from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def above(nodes: list[str], fanout: int = FANOUT) -> list[str]:
    """The nodes one level up."""
    return [digest(nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]


def siblings(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The proof of each node over so many levels: the other nodes of its run, then those of the run above, and so on."""
    proofs: list[list[str]] = [[] for _ in nodes]
    own = list(range(len(nodes)))
    for _ in range(levels):
        runs = [nodes[a : a + fanout] for a in range(0, len(nodes), fanout)]
        for proof, at in zip(proofs, own, strict=True):
            run, k = runs[at // fanout], at % fanout
            proof += run[:k] + run[k + 1 :]
        own = [at // fanout for at in own]
        nodes = [digest(run) for run in runs]
    return proofs


def fold(node: str, path: Sequence[tuple[int, int]], proof: Sequence[str], fanout: int = FANOUT) -> str:
    """The root that a node and its proof lead to; path holds, for each tree on the way up, the node's place in it and
    the number of its nodes."""
    used = 0
    for at, n in path:
        while n > 1:
            first = at - at % fanout
            others = min(fanout, n - first) - 1
            run = list(proof[used : used + others])
            run.insert(at - first, node)
            node, used = digest(run), used + others
            at, n = at // fanout, -(-n // fanout)
    return node


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and its text, or a dash if it is null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"i DIV {fanout**levels}L"))


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of each tree (key, i from 0, n of the tree, node), then the roots of their buckets, then of the buckets
    of these, until each tree has one node."""

    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        key, i, n = rows["key"].iloc[0], int(rows["i"].iloc[0]), int(rows["n"].iloc[0])
        left = rows.sort_values("i")["node"].tolist()
        for _ in range(min(levels, height(n, fanout))):
            left = above(left, fanout)
        size = fanout**levels
        return pd.DataFrame({"key": [key], "i": [i // size], "n": [-(-n // size)], "node": left})

    tables = [nodes]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        buckets = _bucketed(tables[-1].select("key", "i", "n", "node"), fanout, levels).groupBy("key", "bucket")
        tables.append(keep(buckets.applyInPandas(collapse, "key string, i long, n long, node string")))
    return tables


def descend(tables: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The first of the tables of climb() with each node's proof, and with what tops has beside. tops: a row for each
    tree, with key, proof (what is above the tree's root) and more."""
    found = tops.withColumn("i", F.lit(0).cast("long"))
    carried = [c for c in found.columns if c not in ("key", "i", "proof")]

    def prove(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("i").drop_columns(["bucket"])
        n = rows["n"][0].as_py()
        rest = upper["proof"][0].as_py()
        lower = siblings(rows["node"].to_pylist(), min(levels, height(n, fanout)), fanout)
        rows = rows.append_column("proof", pa.array([own + rest for own in lower], pa.list_(pa.string())))
        for c in carried:
            rows = rows.append_column(c, pa.array([upper[c][0].as_py()] * rows.num_rows, upper[c].type))
        return rows

    for k in range(len(tables) - 2, -1, -1):
        nodes = _bucketed(tables[k], fanout, levels)
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in tables[k].schema]
        kinds += ["proof array<string>", *(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in carried)]
        uppers = found.select("key", F.col("i").alias("bucket"), "proof", *carried)
        proved = nodes.groupBy("key", "bucket").cogroup(uppers.groupBy("key", "bucket")).applyInArrow(prove, ", ".join(kinds))
        found = keep(proved.select("key", "i", "proof", *carried)) if k else proved
    return found if len(tables) > 1 else tables[0].join(found.drop("i"), "key")


def places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows, which have a key, with their place i in the order within the key, and n, how many the key has. Rows that are
    alike in the order go to different ranges by an id that they have in their files."""
    spread = keep(rows).withColumn(RID, F.monotonically_increasing_id())
    placed = keep(global_row_number(spread, ["key", *order, RID], "__at").drop(RID))
    sizes = keep(placed.groupBy("key").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n")))
    return join_counted(placed, sizes, ["key"]).withColumn("i", F.col("__at") - F.col("__first")).drop("__at", "__first")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", seen: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (digests, from the leaf up), path (place and number of nodes, of the tree and
    of the tree of trees) and folded_root of each row. folded_root is where the digest seen leads, the leaf itself unless
    it is given: it equals root where nothing was changed."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    made = leaf(*(F.col(c) for c in columns))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), made.alias("node"), (made if seen is None else seen).alias("seen"))
    tables = climb(keep(places(rows, ["doc_id", "node"])), fanout, levels)
    # A tree of one leaf has no bucket above it; in the last table every tree has one node.
    subroots = tables[-1].select(F.lit("").alias("key"), F.col("key").alias("tree"), "node")
    over = climb(keep(places(subroots, ["tree"])), fanout, levels)
    roots = over[-1].select("key", F.array().cast("array<string>").alias("proof"), F.col("node").alias("root"))
    tops = keep(descend(over, roots, fanout, levels))
    tops = tops.select(F.col("tree").alias("key"), F.col("node").alias("subroot"), "root", "proof", F.col("i").alias("place"), F.col("n").alias("places"))
    found = descend(tables, tops, fanout, levels)

    @F.arrow_udf("string")
    def folded(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch), strict=True)
            yield pa.array([fold(node, ((i, n), (place, places)), proof, fanout) for node, i, n, place, places, proof in rows], pa.string())

    return found.select(
        "doc_id",
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "proof",
        F.array(F.struct(F.col("i").alias("at"), "n"), F.struct(F.col("place").alias("at"), F.col("places").alias("n"))).alias("path"),
        folded("seen", "i", "n", "place", "places", "proof").alias("folded_root"),
    )


def tampered(docs: DataFrame, columns: Sequence[str] = COLUMNS, every: int = 7) -> Column:
    """The leaf as it is seen when n_chars has grown by 1 in the rows whose crc32 of doc_id is divisible by `every`."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % every == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return leaf(*(changed if c == "n_chars" else F.col(c) for c in columns))


def verify(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and whether each row, some of them tampered with, leads to the root."""
    found = manifest(docs, seen=tampered(docs))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        F.size("proof").cast("long").alias("n_siblings"),
    )


#: crc32 of a string's bytes, for SQL without such a function: a table of 256 numbers made by eight shifts each.
CRC_SQL = """
crc_bits AS (SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a SQL expression, where crc_table is joined."""
    bytes_of = f"list_transform(range(0, 2 * octet_length(encode({text})), 2), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(k + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_of}), lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 + 1 AS INTEGER)])), 4294967295)"


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
part AS (
  SELECT doc_id, lang, n_chars, crc % 7 = 0 AS hit,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM (SELECT *, {crc_sql("doc_id::VARCHAR")} AS crc FROM documents, crc_table)),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM part),
leaves AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
walk AS (
  SELECT rid, lang, 0 AS level, i, n, coalesce(changed, leaf) AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.rid, w.lang, w.level + 1, w.i // 2, (w.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.i % 2 = 0 THEN w.h || s.h ELSE s.h || w.h END), w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.i = xor(w.i, 1)
  WHERE w.n > 1),
rise AS (
  SELECT w.rid, 0 AS level, r.i, r.n, w.h, w.proof, r.h AS subroot
  FROM walk w JOIN subroots r ON r.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.rid, w.level + 1, w.i // 2, (w.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.i % 2 = 0 THEN w.h || s.h ELSE s.h || w.h END), w.proof || coalesce(s.h, ''), w.subroot
  FROM rise w LEFT JOIN tops s ON s.level = w.level AND s.i = xor(w.i, 1)
  WHERE w.n > 1)
SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = t.h AS verified,
  CAST(length(r.proof) // 64 AS BIGINT) AS n_siblings
FROM leaves l JOIN rise r ON r.rid = l.rid AND r.n = 1, (SELECT h FROM tops WHERE n = 1) t
"""
