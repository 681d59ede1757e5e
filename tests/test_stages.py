"""Stages that break off and go on, batches that never cut a job, embedding in two phases, guards."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import stages
from lexmill.sources import files


def test_a_stage_goes_on_where_it_was(spark, tmp_path):
    schema, path = "k long, value long, error string", f"file://{tmp_path}/log"
    cases = spark.createDataFrame([(k,) for k in range(10)], "k long")
    upstream = spark.createDataFrame([(k, "bad" if k == 9 else None) for k in range(1, 10)], "k long, error string")
    seen = []

    def work(df):
        seen.append(sorted(r.k for r in df.collect()))
        return df.select("k", (F.col("k") * 2).alias("value"), F.when(F.col("k") % 4 == 0, "boom").alias("error"))

    one = stages.run_stage(cases, path, schema, ["k"], work, upstream).first()
    assert seen == [list(range(1, 9))] and (one.done, one.errors, one.pending, one.missing_upstream) == (6, 2, 0, 2)
    stages.run_stage(cases, path, schema, ["k"], work, upstream)
    stages.run_stage(cases, path, schema, ["k"], work, upstream, retry_failed=True)
    assert seen[1:] == [[], [4, 8]]


def test_batches_never_cut_a_job(spark):
    jobs = spark.createDataFrame([(k, [f"{k}a", f"{k}b"][: 1 + k % 2]) for k in range(60)], "k long, texts array<string>").coalesce(1)

    def embed(texts):
        assert len(texts) <= stages.BATCH
        if "13a" in texts:
            raise OSError
        return [[float(len(t))] for t in texts]

    rows = {r.k: r for r in stages.packed(jobs, "k", "texts", embed).collect()}
    assert len(rows) == 60 and rows[13].error == "OSError" and rows[13].vectors is None
    assert all(len(r.vectors) == 1 + k % 2 for k, r in rows.items() if r.error is None) and sum(r.error is None for r in rows.values()) > 40


def test_two_phases(spark, tmp_path):
    made = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", None), (3, "b", [0.0, 1.0])], "chunk_id long, source_document string, vec array<double>")
    assert tuple(stages.embed_summary(made, "chunk_id").first()) == (3, 2, 1, [2])
    folder, index = f"file://{tmp_path}/c", f"file://{tmp_path}/i"
    assert stages.refresh_index(spark, folder, index, 2) == 0
    stages.checkpoint_embeddings(made, folder)
    stages.checkpoint_embeddings(spark.createDataFrame([(4, "b", [1.0, 1.0])], made.schema), folder)
    assert stages.refresh_index(spark, folder, index, 2) == 2 and {r.chunk_id for r in spark.read.parquet(index).collect()} == {1, 4}
    with pytest.raises(Exception, match="another dimension"):
        stages.refresh_index(spark, folder, index, 3)
    assert spark.read.parquet(index).count() == 2


def test_a_broken_swap_leaves_the_table_before_it(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.write_swapped(spark.range(3), f"file://{path}")
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert files.read_swapped(spark, f"file://{path}").count() == 3
    files.write_swapped(spark.range(5), f"file://{path}")
    assert files.read_swapped(spark, f"file://{path}").count() == 5 and not (tmp_path / "t.old").exists()


def test_guards(spark):
    stages.check_scope([])
    stages.check_scope(["a.md"], append=True, retry_skipped=True)
    for flag in ("append", "retry_skipped"):
        with pytest.raises(ValueError, match=flag):
            stages.check_scope([], **{flag: True})
    every, some = spark.range(5), spark.range(2)
    assert stages.quota_units(every, some, None) is every and stages.quota_units(every, some, 3) is some
