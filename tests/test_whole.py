"""What queries once left out: each test fails on the code before its finding was settled."""

import re

from pyspark.sql import functions as F

from lexmill.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def replayed(text):
    """The reference's pieces: four words each, no white space lost."""
    out, current, n = [], [], 0
    for piece in re.findall(r"\s+|\S+", text):
        if not piece.isspace() and n == 4:
            out.append("".join(current))
            current, n = [], 0
        current.append(piece)
        n += not piece.isspace()
    return out + ["".join(current)] if current else out


def test_replay_takes_every_text(spark, tmp_path):
    rows = [(1, "a b  c\nd e "), (2, "  lead a b c d e"), (10, "x"), (13, " \n "), (20, ""), (21, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), SF):
        got = {}
        for r in QUERIES["replay_pieces"](spark, folder).orderBy("doc_id", "k").collect():
            got.setdefault(r.doc_id, []).append(r.piece)
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        assert got == {k: pieces for k, t in texts.items() if (pieces := replayed(t or ""))}


def test_unit_keys_of_long_ids(spark, tmp_path):
    ids = [7, 9999, 10000, 123456, 123457]
    spark.createDataFrame([(k, "vi") for k in ids], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.unit_key, r.graph_path) for r in QUERIES["unit_keys"](spark, str(tmp_path)).collect()}
    assert got == {k: (f"vi.md#{k}", f"kg/vi_{k:04d}.json") for k in ids}


def test_every_term_has_an_id(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, "b a rare b"), (2, "a é Z"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: r.term_id for r in QUERIES["bm25_term_ids"](spark, str(tmp_path)).collect()}
    assert got == {"a": 0, "b": 1, "rare": 2, "z": 3, "é": 4}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    terms = sorted((r[0] for r in con.sql(f"SELECT term FROM ({ORACLES['bm25_fit_terms']})").fetchall()), key=str.encode)
    assert {r.term: r.term_id for r in QUERIES["bm25_term_ids"](spark, SF).collect()} == {t: k for k, t in enumerate(terms)}


def test_cache_sees_a_hot_key_in_order_of_time(spark, tmp_path):
    """More requests of one key than a chunk holds, in files that run against time."""
    from lexmill.plans.pipeline_queries import _run
    from lexmill.streaming import turns

    at, n, size = "CAST(timestamp_seconds(1700000000 + id * 7) AS TIMESTAMP) AS ts", 600, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(n).selectExpr("7L AS k", at, "IF(id % 3 = 0, concat('v', id), NULL) AS value")
    rows.orderBy(F.xxhash64("ts")).repartition(5).write.parquet(f"{tmp_path}/e")
    before = spark.conf.get(size)
    spark.conf.set(size, "50")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e")
        got = {(int(r.ts.timestamp()) - 1700000000) // 7: r.hit for r in _run(spark, turns.cached_answers(stream, "k", "ts", 10)).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == {i: f"v{i - 1}" if i % 3 == 1 else None for i in range(n) if i % 3}
