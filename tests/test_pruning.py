"""Searches that leave out what can't be among the best, against exhaustive ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import bm25, fusion, ranking
from lexmill.plans import retrieval_queries


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pruned_sparse_search(spark):
    """The same hits, and few pairs scored, at several bounds; questions with too few hits for a threshold, too."""
    sf = "/root/testdata/sf0.01"
    corpus, asked = retrieval_queries._corpus(spark, sf), retrieval_queries._questions(spark, sf)
    rare = spark.createDataFrame([(-1, ["zzz-unknown"]), (-2, [])], "item_id long, terms array<string>")
    asked = asked.unionByName(rare)
    fitted, weights = bm25.index_of(corpus, "doc_id", asked.select(F.explode("terms").alias("term")))
    wanted = bm25.query_weights(asked, "item_id", fitted)
    columns = ("item_id", "doc_id", "score", "rank")
    exhaustive = rows(bm25.search(weights, "doc_id", wanted, "item_id", 5), *columns)
    every = weights.join(wanted.select("item_id", "term"), "term").select("item_id", "doc_id").distinct().count()
    for block, seed in ((4, 100), (32, 10)):
        postings, bounds = bm25.blocked(corpus, "doc_id", weights, block)
        found = bm25.search_pruned(postings, bounds, "doc_id", wanted, "item_id", 5, seed=seed)
        assert rows(found.hits, *columns) == exhaustive
        if block == 4:
            assert found.scored.count() < every / 4


def test_ties_and_few_hits(spark):
    """Equal documents tie by key; a question that fewer documents match than wanted gets them all."""
    docs = spark.createDataFrame([(k, ["a"] * (1 + k % 2) + (["b"] if k > 17 else [])) for k in range(20)], "d long, terms array<string>")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["a", "b"])], "q long, terms array<string>")
    weights, fitted = bm25.document_weights(docs, "d"), bm25.fit(docs)
    wanted = bm25.query_weights(asked, "q", fitted)
    postings, bounds = bm25.blocked(docs, "d", weights, 3)
    got = bm25.search_pruned(postings, bounds, "d", wanted, "q", 4, seed=2).hits
    assert rows(got, "q", "d", "score", "rank") == rows(bm25.search(weights, "d", wanted, "q", 4), "q", "d", "score", "rank")


def _random_search(spark, rng, n_docs=90, n_questions=12):
    docs = spark.createDataFrame([(d, [f"t{t}" for t in rng.integers(0, 14, rng.integers(1, 9))]) for d in range(n_docs)], "d long, terms array<string>")
    asked = spark.createDataFrame([(q, [f"t{t}" for t in rng.integers(0, 16, 4)]) for q in range(n_questions)], "q long, terms array<string>")
    fitted, weights = bm25.index_of(docs, "d")
    wanted = bm25.query_weights(asked, "q", fitted)
    return docs, weights, wanted, rows(bm25.search(weights, "d", wanted, "q", 5), "q", "d", "score", "rank")


@pytest.mark.parametrize("asked", [200_000, 7])
def test_pruning_shuffles_no_pairs_and_no_bounds(spark, monkeypatch, asked):
    """Postings meet the questions in tasks, questions broadcast or dealt, in many small pieces and tiles."""
    docs, weights, wanted, want = _random_search(spark, np.random.default_rng(7))
    for name, value in (("ASKED", asked), ("DEALT", 60), ("MET", 16), ("MET_BOUNDED", 24), ("TILE", (5, 6))):
        monkeypatch.setattr(bm25, name, value)
    for block in (1, 9):
        postings, bounds = bm25.blocked(docs, "d", weights, block)
        found = bm25.search_pruned(postings, bounds, "d", wanted, "q", 5, seed=6)
        assert rows(found.hits, "q", "d", "score", "rank") == want
        assert "Aggregate [q" not in found.hits._jdf.queryExecution().optimizedPlan().toString()
        assert {r[:2] for r in want} <= set(rows(found.scored, "q", "d"))


def test_pruned_search_with_other_keys(spark):
    docs, weights, wanted, want = _random_search(spark, np.random.default_rng(8))
    name = F.format_string("d%03d", "d").alias("d")
    postings, bounds = bm25.blocked(docs.select(name, "terms"), "d", weights.select(name, "term", "weight"))
    found = bm25.search_pruned(postings, bounds, "d", wanted, "q", 5)
    assert rows(found.hits, "q", "d", "score", "rank") == sorted((q, f"d{d:03d}", s, r) for q, d, s, r in want)


def test_pruned_search_tokenises_once(spark, monkeypatch):
    """Only the table of counts is made from texts; numbering by length reads what is written."""
    made = []
    monkeypatch.setattr(bm25, "global_row_number", lambda df, *a: made.append(df._jdf.queryExecution().optimizedPlan().toString()) or ranking.global_row_number(df, *a))
    retrieval_queries.pruned_hits(spark, "/root/testdata/sf0.001", 5)
    assert len(made) == 1 and "regexp_extract_all" not in made[0]


def test_tokens_by_the_plain_pattern(spark):
    """Every code point alone, before, between and after letters."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = spark.createDataFrame([(" ".join(f"a{chr(c)}b {chr(c)} {chr(c)}- -{chr(c)}1 {chr(c)}x" for c in points[i : i + 200]),) for i in range(0, len(points), 200)], "t string")
    piece = f"[^{text.WHITE[1:-1]}]"
    plain = F.regexp_extract_all(F.lower("t"), F.lit(f"{piece}*[\\p{{L}}\\p{{N}}]{piece}*"), F.lit(0))
    assert texts.filter(text.tokens(F.col("t")) != plain).count() == 0
    assert texts.select(F.explode(plain)).count() > 3_000_000
