"""The graph of texts and the causes of errors against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import causes, graph


def made(seed, n=60):
    random.seed(seed)
    sets = [sorted(random.sample("abcdefghijkl", random.randint(0, 6))) for _ in range(n)]
    return [(k, sets[k] if k % 7 else sets[k // 7]) for k in range(n)] + [(900, None), (901, [])]


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8, 1.0])
def test_edges_against_all_pairs(spark, similarity):
    nodes = made(int(similarity * 10))
    members = graph.classes(spark.createDataFrame(nodes, "node long, entities array<string>"))
    first = {}
    for k, e in nodes:
        if e:
            first.setdefault(tuple(e), k)
    assert {(r.node, r["class"]) for r in members.collect()} == {(k, first[tuple(e)]) for k, e in nodes if e}
    want = {}
    for (x, a), (y, b) in itertools.combinations(sorted((k, set(e)) for e, k in first.items()), 2):
        if len(a & b) / len(a | b) >= similarity:
            want[x, y] = (len(a & b), len(a & b) / len(a | b))
    assert {(r.a, r.b): (r.shared, r.score) for r in graph.edges(members, similarity).collect()} == want


def test_clusters_and_quota(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7), (2, 5, 0.6), (2, 6, 0.6)]
    found = {r.node: (r.n_near, r.n_cut, r.n_two) for r in graph.clusters(spark.createDataFrame(rows, "a long, b long, score double"), 2).collect()}
    # 2 keeps 1 and 3; 5 and 6 keep 2; what they reach follows.
    assert found == {1: (1, 0, 2), 2: (4, 2, 3), 3: (2, 0, 3), 4: (1, 0, 2), 5: (1, 0, 3), 6: (1, 0, 3)}
    none = graph.holds(graph.clusters(spark.createDataFrame([], "a long, b long, score double"))).first()
    assert tuple(none) == (True, False, False)
    one = graph.holds(graph.clusters(spark.createDataFrame([(1, 2, 1.0)], "a long, b long, score double"))).first()
    assert tuple(one) == (True, False, True)
    quota = {k: F.lit(n) for k, n in (("single_hop", 3), ("abstract", 5), ("specific", 0))}
    dealt = spark.range(1).select(graph.dealt(quota, {"single_hop": F.lit(True), "abstract": F.lit(True), "specific": F.lit(True)}).alias("d")).first().d
    assert [(x.kind, x.n) for x in dealt] == [("single_hop", 3), ("abstract", 5)]
    import math

    assert all(math.ceil(8 * x.weight) == x.n for x in dealt)


def test_samples_and_stored_graphs(spark):
    rows = spark.createDataFrame([("q", "a", ["c"]), (" ", "a", ["c"]), ("q", None, ["c"]), ("q", "a", [" "]), ("q", "a", None)], "q string, a string, c array<string>")
    assert [r[0] for r in rows.select(graph.valid_sample(F.col("q"), F.col("a"), F.col("c"))).collect()] == [True, False, False, False, False]
    units = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "unit int, text string")
    stored = units.select("unit", F.sha2(F.when(F.col("unit") == 1, "x").otherwise("z"), 256).alias("text_sha256"))
    assert {r.unit: r.reusable for r in graph.reusable(units, stored).collect()} == {1: True, 2: False, 3: False}


def test_causes_in_circles(spark):
    """A circle ends where the way meets itself; a cause goes before a context; both are reached."""
    errors = [("r", k, n) for k, n in enumerate(["RuntimeError", "ValueError", "KeyError", "ReadTimeout", "ValidationError"])] + [("s", 0, "RuntimeError")]
    edges = [("r", 0, 1, "cause"), ("r", 0, 3, "context"), ("r", 1, 2, "context"), ("r", 2, 1, "cause"), ("r", 3, 0, "context")]
    e = spark.createDataFrame(errors, "run string, id long, name string")
    got = {(r.run, r.id): r for r in causes.describe(e, spark.createDataFrame(edges, "run string, src long, dst long, kind string"), e.select("run", "id")).collect()}
    assert (got["r", 0].root, got["r", 0].depth, got["r", 0].n_errors, got["r", 0].transport, got["r", 0].semantic) == (2, 2, 4, True, False)
    assert (got["r", 3].root, got["r", 3].depth) == (2, 3) and got["r", 2].root == 1 and got["r", 1].root == 2
    assert (got["r", 4].root, got["r", 4].n_errors, got["r", 4].semantic) == (4, 1, True) and got["s", 0].trace == "RuntimeError"
    assert causes.roots(e.limit(0).select("run", "id"), spark.createDataFrame([], "run string, src long, dst long, kind string")).collect() == []
