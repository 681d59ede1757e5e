"""What a larger table may not change or multiply: scans, bounds, candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import graph, verification
from lexmill.plans import verification_queries


def test_hard_gate_meets_each_context_once(spark):
    plan = verification_queries.hard_gate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") and plan.count("Join ") == 1 and plan.count("Aggregate [") == 1


def test_invalid_citations_in_a_row_are_those_of_the_join(spark):
    rows = [(1, "[1]【2】[9] [1]", [1, 2]), (2, "x [3]", None), (3, "keine", [1]), (4, "[99999999999]", [1]), (5, None, [1])]
    answers = spark.createDataFrame(rows, "a long, text string, ranks array<int>")
    contexts = answers.select("a", F.explode("ranks").alias("rank"), F.lit("c").alias("chunk_id"))
    joined = verification.citations(answers, contexts, "a").filter("NOT valid").groupBy("a").count()
    want = {r["a"]: r["count"] for r in joined.collect()}
    got = {r.a: r.n for r in answers.select("a", verification.n_invalid(F.col("text"), F.col("ranks")).alias("n")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0} and {a: n for a, n in got.items() if n} == want


@pytest.mark.parametrize(
    ("text", "loose"),
    [
        ("a1 2b _3 4", [("4", False)]),
        ("12 phần  trăm, 13 phần, 14 phần trămx", [("12", True), ("13", False), ("14", False)]),
        ("15%x 16 ngàyx 17\tNGÀY. 18 ngày_ 19năm", [("15", True), ("16", False), ("17", True), ("18", False)]),
    ],
)
def test_units_stand_behind_whole_numbers(spark, text, loose):
    found = spark.range(1).select(verification.unverified(F.lit(text), F.array()).alias("x")).first().x
    assert [tuple(x) for x in found] == loose


@pytest.mark.parametrize("bits", [64, 512])
def test_pairs_that_cannot_reach_leave_the_join_by_their_maps(spark, monkeypatch, bits):
    monkeypatch.setattr(graph, "BITS", bits)
    rng = np.random.default_rng(3)
    base = [rng.choice(400, 30, replace=False) for _ in range(8)]
    rows = [(k, [f"e{x}" for x in {*rng.choice(base[k % 8], rng.integers(1, 30), replace=False), *rng.integers(0, 4000, k % 9)}]) for k in range(120)]
    found = graph.edges(graph.classes(spark.createDataFrame(rows, "node long, entities array<string>")))
    sets = {}
    for k, e in rows:
        sets.setdefault(frozenset(e), k)
    named = sorted((k, e) for e, k in sets.items())
    want = {(a, b, len(x & y), len(x & y) / len(x | y)) for a, x in named for b, y in named if a < b and len(x & y) / len(x | y) >= 0.5}
    assert want and {tuple(r) for r in found.collect()} == want
    assert "bit_count" in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_texts_with_marks_go_to_python(spark, monkeypatch):
    def checked(texts):
        assert all(t is None or "\u0301" in t for t in texts), "a text without a mark was sent"
        return texts.map(lambda t: t and t.replace("e\u0301", "\u00e9"))

    monkeypatch.setattr(text, "compose", checked)
    rows = spark.createDataFrame([("plain",), ("e\u0301t",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(text.nfc(F.col("t"))).collect()] == ["plain", "\u00e9t", None, ""]


def test_a_number_is_named_once_whatever_its_separators(spark):
    found = spark.range(1).select(verification.unverified(F.lit("Xem 1.234.567 đồng, số 1234567."), F.array()).alias("x")).first().x
    assert [tuple(x) for x in found] == [("1.234.567", True)]
