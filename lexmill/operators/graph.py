"""A graph of texts: nodes that share entities, clusters over two hops, and how questions are dealt to what it holds.

Edges come from a set-similarity join that meets only pairs which share a rare entity: a set's entities are ordered from
the rarest on, and two sets that are similar enough share one of the first few of each. Nodes with the same set are one
class; edges join classes, so copies, however many, add rows of membership and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.ranking import global_row_number
from lexmill.sources.shared import keep

SIMILARITY, DEGREE = 0.5, 100
#: Bits of a map of a set: 64 bytes, which tell sets of some hundred entities apart.
BITS = 512
KINDS = ("single_hop", "abstract", "specific")


def classes(nodes: DataFrame) -> DataFrame:
    """node, class (the smallest node with the same entities) of each node (node, entities) that has an entity."""
    sets = nodes.select("node", F.array_sort(F.array_distinct("entities")).alias("entities")).filter(F.size("entities") > 0)
    digest = F.sha2(F.to_json("entities"), 256)
    named = keep(sets.withColumn("digest", digest))  # texts are scanned once
    first = named.groupBy("digest").agg(F.min("node").alias("class"), F.count(F.lit(1)).alias("n"))
    return named.join(first, "digest").select("node", "class", "n", "entities")


def edges(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, shared, score of each two classes (a < b) whose sets' Jaccard similarity is at least so much.

    Entities that two sets have are numbered from the rarest on. A set meets others by the first of its numbers, with a map
    of BITS that all of them leave; two maps bound what two sets share, so that few pairs but edges leave the join. Only
    these meet the whole sets, as numbers.
    """
    sets = keep(members.filter("node = class").select("class", "entities"))
    tokens = sets.select("class", F.size("entities").alias("n"), F.explode("entities").alias("e"))
    often = tokens.groupBy("e").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")  # what one set has alone joins nothing
    numbered = global_row_number(often, ["df", "e"], "i").select("e", "i")
    words = [f"w{w}" for w in range(BITS // 64)]
    bit = F.expr(f"shiftleft(1L, CAST(i DIV {len(words)} % 64 AS INT))")
    maps = [F.coalesce(F.bit_or(F.when(F.col("i") % len(words) == w, bit)), F.lit(0).cast("long")).alias(name) for w, name in enumerate(words)]
    known = keep(tokens.join(numbered, "e").groupBy("class", "n").agg(F.sort_array(F.collect_list("i")).alias("ids"), *maps))
    # Entities of one set only stand first in the order of rarity; they take up places all the same.
    places = F.greatest(F.lit(0), F.size("ids") - F.ceil(F.col("n") * similarity) + 1).cast("int")
    prefix = known.select("class", "n", F.size("ids").alias("s"), *words, F.explode(F.slice("ids", F.lit(1), places)).alias("i"))
    other = prefix.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("s").alias("t"), *[F.col(w).alias(f"{w}b") for w in words], "i")
    # Each bit that one map alone has stands for an entity that one set alone has. The rest is for a score's rounding.
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}b"))) for w in words), F.lit(0))
    sized = (F.col("class") < F.col("b")) & (F.col("n") >= F.col("m") * similarity) & (F.col("m") >= F.col("n") * similarity)
    near = sized & ((F.col("s") + F.col("t") - apart) * (1 + similarity) >= (F.col("n") + F.col("m")) * (2 * similarity) - 1e-6)
    pairs = prefix.join(other, "i").filter(near).select(F.col("class").alias("a"), "b", "n", "m").distinct()
    both = pairs.join(known.select(F.col("class").alias("a"), F.col("ids").alias("x")), "a").join(known.select(F.col("class").alias("b"), F.col("ids").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    scored = both.select("a", "b", shared.cast("long").alias("shared"), (shared / (F.col("n") + F.col("m") - shared)).alias("score"))
    return scored.filter(F.col("score") >= similarity)


def clusters(found: DataFrame, degree: int = DEGREE) -> DataFrame:
    """node, n_near, n_cut, n_two: its neighbours, how many of them the cap on degrees leaves out (the least similar, ties
    by the larger node), and how many other nodes stand within two hops over those that are left."""
    found = keep(found.select("a", "b", "score"))
    both = found.union(found.select("b", "a", "score")).toDF("node", "other", "score")
    order = W.partitionBy("node").orderBy(F.col("score").desc(), "other")
    ranked = both.withColumn("k", F.row_number().over(order))
    near = keep(ranked.filter(F.col("k") <= degree).select("node", "other"))
    hop = near.select(F.col("node").alias("other"), F.col("other").alias("far"))
    two = near.join(hop, "other").filter("far <> node").select("node", F.col("far").alias("other"))
    within = near.union(two).distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_two"))
    counted = ranked.groupBy("node").agg(F.count(F.lit(1)).alias("n_near"), F.count_if(F.col("k") > degree).alias("n_cut"))
    return counted.join(within, "node")


def holds(about: DataFrame) -> DataFrame:
    """One row of kinds of questions that a graph has clusters for: specific needs an edge, abstract a node with others
    within two hops that aren't all its neighbours."""
    return about.agg(
        F.lit(True).alias("single_hop"),
        F.coalesce(F.bool_or(F.col("n_two") > F.col("n_near") - F.col("n_cut")), F.lit(False)).alias("abstract"),
        F.coalesce(F.bool_or(F.col("n_near") > 0), F.lit(False)).alias("specific"),
    )


def dealt(quota: dict[str, Column], held: dict[str, Column]) -> Column:
    """array of struct(kind, n, weight): kinds that are wanted and held, with weights (n - 0.5) / total, so that rounding
    up total times weight gives n again; kinds without clusters are left out and not made up for."""
    kept = F.array_compact(F.array(*[F.when((quota[k] > 0) & held[k], F.struct(F.lit(k).alias("kind"), quota[k].cast("long").alias("n"))) for k in KINDS]))
    total = F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n"), ((x["n"] - 0.5) / total).alias("weight")))


def valid_sample(question: Column, answer: Column, contexts: Column) -> Column:
    """Whether a made sample can be used: a question and an answer that say something, and a context."""
    said = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return said(question) & said(answer) & F.coalesce(F.exists(contexts, lambda c: F.trim(c) != ""), F.lit(False))


def reusable(units: DataFrame, stored: DataFrame) -> DataFrame:
    """unit and reusable: whether a stored graph (unit, text_sha256) is of the unit's very text (unit, text)."""
    kept = stored.groupBy("unit").agg(F.max("text_sha256").alias("text_sha256"))
    same = F.coalesce(F.sha2("text", 256) == F.col("text_sha256"), F.lit(False))
    return units.join(kept, "unit", "left").select("unit", same.alias("reusable"))
