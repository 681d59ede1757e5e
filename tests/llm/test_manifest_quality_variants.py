"""Merkle manifest, quality trees and spelling variants against plain versions, and on the edge cases of their docstrings."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import boosting, merkle, variants
from lexmill.llm import queries as llm_queries

from .test_operators import CLASHES, EDGE, LONG, SCHEMA, SF


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in (*CLASHES, "i", "node", "bucket", "proof", "tree", "seen", "m", "a")})


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    values = [row[c] for c in merkle.COLUMNS]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fanout):
    """The root, and the proof of each node, by walking up from each."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][a : a + fanout]) for a in range(0, len(levels[-1]), fanout)])
    proofs = []
    for at in range(len(nodes)):
        proof = []
        for level in levels[:-1]:
            first = at - at % fanout
            proof += [level[k] for k in range(first, min(first + fanout, len(level))) if k != at]
            at //= fanout
        proofs.append(proof)
    return levels[-1][0], proofs


def plain_manifest(rows, fanout):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r["doc_id"]))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: plain_tree([x[2] for x in sorted(by[lang], key=lambda x: x[:3])], fanout) for lang in langs}
    root, over = plain_tree([trees[lang][0] for lang in langs], fanout)
    out = []
    for lang, rest in zip(langs, over):
        for x, proof in zip(sorted(by[lang], key=lambda x: x[:3]), trees[lang][1]):
            out.append((repr(x[3]), x[2], trees[lang][0], root, tuple(proof + rest)))
    return sorted(out)


def got_manifest(docs, **how):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, tuple(r.proof)) for r in merkle.manifest(docs, **how).collect())


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest_against_plain_trees(spark, fanout, levels):
    random.seed(fanout * 10 + levels)
    rows = [(random.choice([None, k, k % 7]), f"text {k % 50}", random.choice(["en", "en", "en", "zz", "é", None, "a"]), None, k % 5 or None) for k in range(150)]
    rows += [(9, "lone", "only", "s", 1), (None, None, "nulls", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got_manifest(docs, fanout=fanout, levels=levels) == plain_manifest([r.asDict() for r in docs.collect()], fanout)


def test_manifest_edges(spark, edge):
    assert got_manifest(edge) == plain_manifest([r.asDict() for r in edge.select(*merkle.COLUMNS).collect()], 2)
    assert merkle.verify(edge.limit(0)).collect() == [] == merkle.manifest(edge.limit(0)).collect()
    rows = merkle.verify(edge).collect()
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert r.verified == (r.folded_root == r.root) == (not hit or r.doc_id == 1)  # 1 has no n_chars to change
    # One row, and rows that are all alike.
    one = spark.createDataFrame([(7, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and list(r.proof) == []
    alike = one.crossJoin(spark.range(9).select())
    assert len(got_manifest(alike, levels=1)) == 9 and got_manifest(alike, levels=1) == plain_manifest([one.first().asDict()] * 9, 2)


# Quality


@pytest.fixture(scope="module")
def marked(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


def test_quality_of_held_out_rows(spark, marked):
    docs, labels = marked
    rows = boosting.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    # Labels of held-out rows teach nothing.
    other = labels.withColumn("quality", F.when(boosting.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in boosting.classify(docs, other).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_trees_against_a_walk(spark, marked):
    """Flat arrays give what a walk from node to node gives, and growing lowers the loss."""
    docs, labels = marked
    found = boosting.measured(docs)
    trees = boosting.learn(found, labels)
    x = np.array([r.x for r in found.limit(300).collect()])
    inner = trees.statistic.shape[1]
    for row, score in zip(x, trees.scores(x)):
        margin = trees.base
        for t in range(len(trees.statistic)):
            at = 0
            while at < inner:
                at = 2 * at + (2 if row[trees.statistic[t, at]] > trees.cut[t, at] else 1)
            margin += trees.value[t, at - inner]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-9
    y = np.array([float(v[0] > np.median(x[:, 0])) for v in x])
    losses = [-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))) for p in (boosting.grow(x, y, np.ones(len(x)), n).scores(x) for n in (1, 5, 30))]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.1


def test_quality_edges(spark, edge, marked):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (None, 1), (2, None), (6, 0), (6, 1)], "doc_id long, quality int")
    rows = boosting.classify(edge, labels).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in EDGE)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] and len({r.score for r in rows if r.doc_id == 3}) == 1
    assert boosting.classify(edge.limit(0), labels).collect() == []
    assert {r.score for r in boosting.classify(edge, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in boosting.classify(edge, labels.filter("quality = 1 AND doc_id <> 6")).collect()} == {1}
    assert boosting.measures(None) == boosting.measures("") == boosting.measures(" \n") == [0.0] * len(boosting.STATISTICS)
    named = dict(zip(boosting.STATISTICS, boosting.measures("AB cd.\nAB 12 ###\nAB cd.")))
    assert named["repeated_lines"] == pytest.approx(1 / 3) and named["distinct_words"] == pytest.approx(4 / 7) and named["symbol_words"] == pytest.approx(1 / 7)
    assert named["upper_words"] == pytest.approx(3 / 7) and named["lines_with_end"] == pytest.approx(2 / 3) and named["longest_word"] == 3
    assert all(np.isfinite(boosting.measures(LONG)))


# Spelling variants


def plain_words(rows, every=variants.EVERY):
    found = collections.Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for word in re.findall("[A-Za-zÀ-ÿ]+", low):
            k = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if k % every == 0:
                word = word[: k % len(word)] + word[k % len(word) + 1 :]
            if len(word) >= 5:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    form, count = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], count[w], words.get(form[w])))
    return sorted(out, key=repr)


def got_variants(words, **how):
    return sorted((tuple(r) for r in variants.variants(words, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("limit", [variants.PARTITION, 40, 3])
def test_variants_against_all_pairs(spark, limit):
    random.seed(limit)
    words = {"".join(random.choices("abé", k=random.randint(5, 8))): random.choice([3, 4, 6, 6, 30, 100]) for _ in range(220)}
    words |= {"x" * k: 3 * 2**k for k in range(5, 12)} | {"q" * 400 + "abc": 5, "q" * 401 + "abc": 50, "q" * 400 + "abd": 7}
    got = got_variants(spark.createDataFrame(list(words.items()), "word string, n long"), limit=limit)
    assert got == plain_variants(words)
    assert max(len(r[2]) - len(r[0]) for r in got) >= 6  # a way of several forms


def test_vocabulary(spark, edge, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert dict(variants.vocabulary(docs).collect()) == want
    monkeypatch.setattr(variants, "COUNTED", 50)  # counts are sent on again and again
    assert dict(variants.vocabulary(docs).collect()) == want
    got = dict(variants.vocabulary(edge, every=3).collect())
    assert got == plain_words([(r[0], r[1]) for r in EDGE], 3) and len(got) >= 2


def test_variants_edges(spark, edge):
    empty = variants.vocabulary(edge.limit(0))
    assert empty.collect() == [] == variants.variants(empty).collect()
    assert variants.vocabulary(edge.filter("text IS NULL OR doc_id = 2")).collect() == []
    one = spark.createDataFrame([("alone", 4)], "word string, n long")
    assert got_variants(one) == [("alone", None, "alone", 4, 0, None)]
    # Ties of n go to the smallest word; a form must be twice as frequent.
    tied = spark.createDataFrame([("abcde", 3), ("abcdf", 6), ("abcdé", 6), ("abcdg", 5)], "word string, n long")
    by = {r[0]: r for r in got_variants(tied)}
    assert by["abcde"][1] == "abcdf" and by["abcdg"][1] is None and by["abcdf"][4] == 3


def test_near_words_of_a_trie():
    random.seed(3)
    words = list({"".join(random.choices("ab", k=random.randint(0, 7))) for _ in range(90)})
    want = {frozenset((a, b)) for a in words for b in words if near(a, b)}
    got = [frozenset((words[i], words[k])) for i, k in variants.near(words)]
    assert len(got) == len(set(got)) and set(got) == want


def test_queries_are_registered():
    names = set(llm_queries.QUERIES)
    assert {"op11_merkle_manifest", "op12_quality_classifier", "op13_spelling_variants"} <= names
    assert {"op11_merkle_manifest", "op13_spelling_variants"} <= set(llm_queries.ORACLES)
