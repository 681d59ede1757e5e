"""Full retrieval against a version that scores every chunk for every question in plain Python."""

import collections
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.operators import citation, fusion, models
from lexmill.plans import pipeline_queries as plans

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [w for w in text.lower().split() if any(c.isalnum() for c in w)]


def vector(text):
    out = np.zeros(64)
    for t in tokens(text):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        out[(h - (1 << 64) if h >> 63 else h) % 64] += 1
    n = math.sqrt(float(out @ out))
    return out / n if n else out


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def ranked(scores, k):
    return sorted(scores, key=lambda c: (-scores[c], c))[:k]


def brute(chunks, questions, scorer, use_mmr, n=5):
    terms = {c: tokens(f"{r.breadcrumb} {r.content}") + list(r.structural) for c, r in chunks.items()}
    vecs = {c: vector(r.content) for c, r in chunks.items()}
    df = collections.Counter(t for ts in terms.values() for t in set(ts))
    avg = sum(map(len, terms.values())) / len(terms)
    idf = {t: math.log((len(terms) - m + 0.5) / (m + 0.5) + 1) for t, m in df.items()}
    out = {}
    for q in questions:
        branches, sparse = [], []
        own = vector(q.text)
        for text, more in ((q.hypothetical, []), (q.text, list(q.structural))):
            if text is None:
                continue
            asked = set(tokens(text) + more)
            score = {}
            for c, ts in terms.items():
                tf = collections.Counter(ts)
                hit = [t for t in asked if t in tf]
                if hit:
                    score[c] = round(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ts) / avg)) for t in hit), 6)
            sparse = ranked(score, 20)
            v = vector(text)
            dense = ranked({c: round(cosine(v, x), 6) for c, x in vecs.items()}, 20)
            fused = collections.defaultdict(float)
            for found in (dense, sparse):
                for k, c in enumerate(found, 1):
                    fused[c] += 1 / (60 + k)
            place = {c: k for k, c in enumerate(dict.fromkeys(dense + sparse))}
            order = sorted(fused, key=lambda c: (-round(fused[c], 12), place[c]))[:20]
            if use_mmr:
                left, picked = list(order), []
                while left and len(picked) < 10:
                    value = lambda c: round(0.5 * cosine(vecs[c], own) - 0.5 * max((cosine(vecs[c], vecs[p]) for p in picked), default=0.0), 9)  # noqa: B023, E731
                    picked.append(max(left, key=lambda c: (value(c), -left.index(c))))  # noqa: B023
                    left.remove(picked[-1])
                order = picked
            branches.append(order[:10])
        if q.numbers:
            branches.append(sparse[:10])
        united = list(dict.fromkeys(c for b in branches for c in b))
        score = {c: scorer(q.text, f"{chunks[c].breadcrumb}\n{chunks[c].content}") for c in united}
        if any(s is None for s in score.values()):
            woven = dict.fromkeys(b[k] for k in range(10) for b in branches if k < len(b))
            out[q.query_id] = [(chunks[c].chunk_id, None) for c in woven][:n]
        else:
            best = sorted(united, key=lambda c: (-score[c], united.index(c)))
            out[q.query_id] = [(chunks[c].chunk_id, round(score[c], 6)) for c in best[:n]]
    return out


def standin(query, passage):
    asked = set(tokens(query))
    return len(asked & set(tokens(passage))) / len(asked) * 20 - 10 if asked else -10.0


@pytest.fixture(scope="module")
def corpus(spark):
    rows = plans.short_chunks(spark, SF)
    rows = rows.withColumns({"c": F.xxhash64("chunk_id"), "structural": citation.document_terms(F.col("breadcrumb"), F.lit(None).cast("string"))}).cache()
    asked = plans.asked_of_chunks(spark, SF).unionByName(spark.createDataFrame([(-1, "Điều 1 khoản 2 quy định gì", None), (-2, "", "mức lương"), (-3, "zzz", None)], "query_id long, text string, hypothetical string"))
    text = F.col("text")
    numbers, parts = citation.article_numbers(text), citation.clause_numbers(text)
    cited = asked.withColumns({"numbers": numbers, "structural": citation.query_terms(numbers, parts, citation.detect_document(text))})
    return rows, {r.c: r for r in rows.collect()}, asked, cited.collect()


@pytest.mark.parametrize("use_mmr", [True, False])
def test_retrieval_against_brute_force(spark, corpus, use_mmr):
    chunks, by_id, asked, cited = corpus
    assert any(r.numbers for r in cited) and any(r.hypothetical for r in cited)
    got = collections.defaultdict(dict)
    for r in plans.retrieve(chunks, asked, use_mmr=use_mmr).collect():
        got[r.query_id][r.pos] = (r.chunk_id, r.score)
    want = brute(by_id, cited, standin, use_mmr)
    assert {q: [found[k] for k in sorted(found)] for q, found in got.items()} == {q: x for q, x in want.items() if x}


def test_no_scores_weave_the_branches(spark, corpus):
    chunks, by_id, asked, cited = corpus
    silent = models.Plugs(scorer=lambda q, p: F.lit(None).cast("double"))
    got = collections.defaultdict(dict)
    for r in plans.retrieve(chunks, asked, silent).collect():
        got[r.query_id][r.pos] = (r.chunk_id, r.score)
    want = brute(by_id, cited, lambda q, p: None, True)
    assert {q: [found[k] for k in sorted(found)] for q, found in got.items()} == {q: x for q, x in want.items() if x}


def test_a_hit_without_metadata_raises(spark, corpus):
    chunks, _, asked, _ = corpus
    postings = spark.createDataFrame([("gone", "điều_1", 1.0)], "chunk_id string, term string, weight double")
    terms = spark.createDataFrame([("điều_1", 1, 2.0)], "term string, df long, idf double")
    with pytest.raises(Exception, match="no metadata of a hit"):
        plans.retrieve(chunks, asked.filter("query_id = -1"), use_mmr=False, index=(postings, terms)).collect()


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fusion, "QUERY_BLOCK", block)
    monkeypatch.setattr(fusion, "VECTOR_GROUP", 50)
    rng = np.random.default_rng(3)
    vectors = [(int(k), [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(300)] + [(300, [0.0] * 4)]
    queries = [(int(k), [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(30)]
    schema = "{} long, vec array<double>"
    got = fusion.dense_search(spark.createDataFrame(vectors, schema.format("d")), "d", spark.createDataFrame(queries, schema.format("q")), "q", 6).collect()
    want = {(q, k): (d, s) for q, v in queries for k, (d, s) in enumerate(sorted(((d, round(cosine(np.array(v), np.array(x)), 6)) for d, x in vectors), key=lambda p: (-p[1], p[0]))[:6], 1)}
    assert {(r.q, r["rank"]): (r.d, r.score) for r in got} == want
