"""What must not grow with the tables: tiles of products, candidates of a label; and orders that keys leave open."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.catalog import ORACLES, QUERIES
from lexmill.operators import bm25, formatting, fusion, ranking, units
from lexmill.plans import retrieval_queries
from lexmill.sources import legal_view


def test_products_are_made_in_tiles(monkeypatch):
    monkeypatch.setattr(fusion, "TILE", (7, 16))
    seen = []
    divide = np.divide
    monkeypatch.setattr(fusion.np, "divide", lambda a, b, **k: seen.append(a.shape) or divide(a, b, **k))
    rng = np.random.default_rng(5)
    q, v = rng.integers(-2, 3, (30, 4)).astype(float), rng.integers(-2, 3, (200, 4)).astype(float)
    keys, ids, scores = fusion._best(np.arange(30), q, iter([(np.arange(120), v[:120]), (np.arange(120, 200), v[120:])]), 5, 6)
    assert max(a for a, _ in seen) <= 7 and max(b for _, b in seen) <= 16
    norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
    whole = np.rint(np.divide(q @ v.T, norm, out=np.zeros_like(norm), where=norm != 0) * 10**6)
    want = [(k, int(d), whole[k, d] / 10**6) for k in range(30) for d in np.lexsort((np.arange(200), -whole[k]))[:5]]
    assert list(zip(keys.tolist(), ids.tolist(), scores.tolist())) == want


def test_label_hits_meet_neighbours_only(spark, tmp_path):
    rows = [(k * 3 % 1000, k % 4 if k % 7 else None) for k in range(300)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    label = dict(rows)
    want = {
        (q, d, k)
        for q in label
        if q % 25 == 0 and label[q] is not None
        for k, d in enumerate(sorted((d for d in label if label[d] == label[q]), key=lambda d: (abs(d - q), d))[:5], 1)
    }
    got = retrieval_queries.label_hits(spark, str(tmp_path), 5)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == want
    # A join by label alone would meet every pair of it.
    assert "own" in got._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_equal_keys_have_one_order(spark, tmp_path):
    spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "S", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "C", 0, 1.0)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    rows = legal_view.blocks(spark, str(tmp_path)).filter(F.col("block").rlike("^(#{4,5} (Điều|1)|Điều này|C )")).orderBy("pos").collect()
    assert [r.block[:6] for r in rows] == ["#### Đ", "##### ", "C được", "Điều n"]


def test_groups_are_given_by_their_starts(spark):
    sizes = F.array(*[F.lit(x).cast("long") for x in (3, 4, 9, 1, 1, 1, 12, 2)])
    row = spark.range(1).select(units.pack(sizes, 10).alias("p"), units.merge(sizes, 5, 10).alias("m")).first()
    assert row.p == [0, 2, 3, 6, 7] and row.m == [0, 2, 3, 6, 7]


@pytest.mark.parametrize("asked", [200_000, 7])
def test_search_shuffles_no_pairs(spark, monkeypatch, asked):
    for name, value in (("ASKED", asked), ("DEALT", 50), ("MET", 16), ("TILE", (3, 4))):
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(2)
    docs = {(d, f"t{t}"): float(rng.integers(1, 9)) / 8 for d in range(60) for t in rng.choice(12, 4, replace=False)}
    questions = {(q, f"t{t}"): float(rng.integers(1, 9)) / 4 for q in range(10) for t in rng.choice(14, 3, replace=False)}
    frame = lambda rows, key: spark.createDataFrame([(*k, v) for k, v in rows.items()], f"{key} long, term string, weight double")
    found = bm25.search(frame(docs, "d"), "d", frame(questions, "q"), "q", 5)
    want = set()
    for q in range(10):
        scores = {}
        for (d, t), w in docs.items():
            if (q, t) in questions:
                scores[d] = scores.get(d, 0) + w * questions[q, t]
        want |= {(q, d, round(s, 6), k) for k, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    assert {(r.q, r.d, r.score, r["rank"]) for r in found.collect()} == want
    # A join by term with a sum per pair would shuffle pairs.
    assert "Aggregate [q" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_carried_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(g, k, int(rng.integers(0, 9)) if rng.random() < 0.1 else None) for g, n in ((1, 300), (2, 1), (3, 90)) for k in range(n)]
    ranged = ranking.in_ranges(spark.createDataFrame(rows, "g int, k int, x int"), ["g"], ["k"])
    found = ranking.over_ranges(ranged, ["g"], ["k"], sums={"s": F.coalesce("x", F.lit(0))}, lasts={"l": F.col("x")})
    assert ranged.filter("g = 1").select("__p").distinct().count() > 1
    want, sums, lasts = set(), {}, {}
    for g, k, x in rows:
        sums[g], lasts[g] = sums.get(g, 0) + (x or 0), lasts.get(g) if x is None else x
        want.add((g, k, sums[g], lasts[g]))
    assert {(r.g, r.k, r.s, r.l) for r in found.collect()} == want


def test_headings_are_validated_by_ranges(spark):
    sf = "/root/testdata/sf0.001"
    whole = {(r.doc, k, line) for r in legal_view.texts(spark, sf).collect() for k, line in enumerate(r.text.split("\n"), 1)}
    lines = legal_view.lines(spark, sf)
    assert {(r.doc, r.line_no, r.raw) for r in lines.collect()} == whole
    # A text in one row, and a join by document alone, grow with the document and with its square.
    assert "collect_list" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert "rs#" in [x for x in legal_view._parts(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "ns#" not in x][0]
    text = "# Phần I\n" + "\n".join(f"#### Điều {k}. x\n##### Khoản {k}\ny [1]" for k in range(1, 200)) + "\n#### Điều 7. leer\n<table>\n# a"
    got = [(r.code, r.detail) for r in formatting.validate(spark.createDataFrame([(1, text)], "doc long, text string")).collect()]
    assert sorted(got) == [("dieu_not_monotonic", "Điều 7"), *[("orphan_footnote", "[1]")] * 199]


def test_partial_hits_grow_with_cores_not_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        docs = spark.range(200).selectExpr("id AS d", "concat('t', id % 7) AS term", "1.0 AS weight").withColumn("weight", F.col("weight").cast("double"))
        found = bm25.search(docs, "d", docs.filter("d < 5").withColumnRenamed("d", "q"), "q", 3)
        dealt = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in x]
        assert len(dealt) == 1 and dealt[0].rstrip().endswith(f"], {spark.sparkContext.defaultParallelism}")
        assert {(r.q, r.d) for r in found.collect()} == {(q, q + 7 * k) for q in range(5) for k in range(3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["emit_headings", "parse_breadcrumb", "serialize_blocks", "pack_blocks_llm"])
def test_only_the_order_of_tied_blocks_is_open(spark, tmp_path, name):
    # Customer 0 goes to supplier 0, so their blocks have the same keys; with the block as a last key the SQL has one order.
    con = duckdb.connect()
    for t in ("nation", "supplier", "customer"):
        own = "SELECT * REPLACE (CASE WHEN c_custkey = 0 THEN (SELECT s_nationkey FROM s WHERE s_suppkey = 0) ELSE c_nationkey END AS c_nationkey) FROM t" if t == "customer" else "FROM t"
        con.sql(f"CREATE OR REPLACE VIEW t AS FROM '/root/testdata/sf0.01/{t}.parquet'")
        con.sql("CREATE OR REPLACE VIEW s AS FROM '/root/testdata/sf0.01/supplier.parquet'")
        con.sql(f"COPY ({own}) TO '{tmp_path}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    keys = "ORDER BY a, m, s, c, k"
    sql = ORACLES[name].replace(f"{keys})", f"{keys}, block)")
    assert sql != ORACLES[name]
    found = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("budget", [0, 7, 40])
def test_groups_are_packed_over_ranges(spark, budget):
    rng = np.random.default_rng(budget)
    draw = lambda: None if (x := rng.random()) < 0.05 else int(rng.choice([0, 1, 3, 5, 8, 50], p=[0.2, 0.3, 0.2, 0.15, 0.1, 0.05]))
    sizes = {g: [draw() for _ in range(n)] for g, n in ((1, 400), (2, 1), (3, 90), (4, 60))} | {5: [0] * 40, 6: [None, 0, 0, 50, 0, 1]}
    ranged = ranking.in_ranges(spark.createDataFrame([(g, k, x) for g, v in sizes.items() for k, x in enumerate(v)], "g int, k int, x int"), ["g"], ["k"])
    assert ranged.filter("g = 1").select("__p").distinct().count() > 1
    want = set()
    for g, v in sizes.items():
        group, total = 0, v[0]
        for k, x in enumerate(v):
            if k and (total is None or x is None or total + x > budget):
                group, total = group + 1, x
            elif k:
                total += x
            want.add((g, k, x, group))
    got = ranking.packed_over_ranges(ranged, ["g"], ["k"], F.col("x"), budget).collect()
    assert len(got) == len(want) and {(r.g, r.k, None if r["size"] is None or np.isnan(r["size"]) else r["size"], r.group) for r in got} == want


def test_no_document_is_packed_in_one_row(spark):
    plan = QUERIES["pack_blocks_llm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # What is listed for a document are its ranges.
    assert [x for x in plan.split("\n") if "collect_list" in x] and all("least" in x for x in plan.split("\n") if "collect_list" in x)


@pytest.mark.parametrize("seed", [0, 40, 10_000])
def test_what_questions_share_is_searched_once(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    docs = [(d, t, float(rng.integers(1, 9)) / 8) for d in range(120) for t in [*(f"c{x}" for x in rng.choice(5, 3, replace=False)), *(f"r{x}" for x in rng.choice(40, 2, replace=False))]]
    weight = {f"{a}{x}": float(rng.integers(1, 9)) / 4 for a in "cr" for x in range(45)}
    shares = [("c0", "c1"), ("c2", "c3", "c4"), ()]
    asked = [(q, t, weight[t]) for q in range(40) for t in [*shares[q % 3], *(f"r{x}" for x in rng.choice(44, 1 + q % 2, replace=False))]]
    known, questions = spark.createDataFrame(docs, "d long, term string, weight double"), spark.createDataFrame(asked, "q long, term string, weight double")
    whole, seen = bm25.search, []
    monkeypatch.setattr(bm25, "search", lambda *a, **k: seen.append(a[2].select("q").distinct().count()) or whole(*a, **k))
    questions = questions.unionByName(questions.withColumn("q", F.col("q") + 100))  # each once more
    got = {tuple(r) for r in bm25.search_shared(known, "d", questions, "q", 4, seed=seed).select("q", "d", "score", "rank").collect()}
    assert got == {tuple(r) for r in whole(known, "d", questions, "q", 4).select("q", "d", "score", "rank").collect()} and len(got) > 40
    # With rare terms set aside, one search for each way in which questions begin; with all of them rare, none.
    assert len(seen) == 1 and seen[0] in {0: range(3, 41), 40: [2], 10_000: [0]}[seed]


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    known = spark.createDataFrame([(d, rng.integers(-2, 3, 4).astype(float).tolist()) for d in range(80)], "d long, vec array<double>")
    asked = spark.createDataFrame([(q, [float(q % 3), 1.0, 0.0, -1.0]) for q in range(50)], "q long, vec array<double>")
    whole, seen = fusion.dense_search, []
    monkeypatch.setattr(fusion, "dense_search", lambda *a, **k: seen.append(a[2].count()) or whole(*a, **k))
    got = fusion.dense_search_once(known, "d", asked, "q", 5).select("q", "d", "score", "rank").collect()
    assert len(got) == 250 and {tuple(r) for r in got} == {tuple(r) for r in whole(known, "d", asked, "q", 5).select("q", "d", "score", "rank").collect()}
    assert seen == [3]
