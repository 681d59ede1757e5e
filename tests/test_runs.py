"""Runs that are killed after any commit end with the same tables; the nine commands of an evaluation and their codes."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill import __main__ as main
from lexmill.operators import evaluation, runs
from lexmill.sources import files, snapshots


class Killed(BaseException):
    pass


def made(spark, folder, calls):
    cases = spark.createDataFrame([(f"c{k}", k) for k in range(12)], "case_id string, v long")

    def first(batch, _):
        calls.append(("first", sorted(r.case_id for r in batch.collect())))
        return batch.select("case_id", (F.col("v") * 2).alias("twice"), F.when(F.col("v") == 5, "boom").alias("error"))

    def second(batch, good):
        calls.append(("second", sorted(r.case_id for r in batch.collect())))
        return batch.select("case_id").join(good["first"], "case_id").select("case_id", (F.col("twice") + 1).alias("more"), F.lit(None).cast("string").alias("error"))

    stages = [runs.Stage("first", (), "case_id string, twice long, error string", first), runs.Stage("second", ("first",), "case_id string, more long, error string", second)]
    return runs.Run(spark, folder, cases, ["case_id"], stages, batches=3)


def whole(run):
    return [sorted(map(tuple, run.records(s).collect()), key=str) for s in run.stages]


def test_a_run_killed_after_any_commit(spark, tmp_path, monkeypatch):
    calls = []
    run = made(spark, f"file://{tmp_path}/whole", calls)
    summaries = [run.do(s).first() for s in run.stages]
    assert [(s.done, s.errors, s.pending, s.missing_upstream) for s in summaries] == [(11, 1, 0, 0), (11, 0, 0, 1)]
    want, commit, n = whole(run), snapshots.commit, len(calls)
    for at in range(n):
        for after in (False, True):
            folder, left = f"file://{tmp_path}/killed{at}{after}", [at]

            def breaks(*args, left=left, after=after, **more):
                left[0] -= 1
                if left[0] < 0 and not after:
                    raise Killed
                out = commit(*args, **more)
                if left[0] < 0:
                    raise Killed
                return out

            again = []
            run = made(spark, folder, again)
            with monkeypatch.context() as m:
                m.setattr(snapshots, "commit", breaks)
                with pytest.raises(Killed):
                    for s in run.stages:
                        run.do(s)
            for s in run.stages:
                run.do(s)
            assert whole(run) == want
            assert len(again) == n + (not after)  # the batch that was cut off is done again, no other
    calls.clear()
    run = made(spark, f"file://{tmp_path}/whole", calls)
    run.do("first")
    assert calls == []
    run.do("first", retry_failed=True)
    assert calls == [("first", ["c5"])]
    with pytest.raises(runs.InputError):
        run.do("third")


def test_streams_commit_each_batch_once(spark, tmp_path, monkeypatch):
    for k in range(3):
        spark.createDataFrame([(f"u{k}{i}",) for i in range(4)], "unit_key string").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    folder, checkpoint = f"file://{tmp_path}/ledger", f"{tmp_path}/checkpoint"
    stream = lambda: spark.readStream.schema("unit_key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    commit, left = snapshots.commit, [1]

    def breaks(*args, **more):
        out = commit(*args, **more)
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("killed behind the commit")
        return out

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", breaks)
        with pytest.raises(Exception, match="killed"):
            runs.run_stream(stream(), folder, checkpoint, lambda b: b)
    found = runs.run_stream(stream(), folder, checkpoint, lambda b: b)
    assert sorted(r.unit_key for r in found.collect()) == sorted(f"u{k}{i}" for k in range(3) for i in range(4))


def test_recovery_from_raw_rows(spark, tmp_path):
    raw = spark.createDataFrame([("a",), ("b",), ("b",)], "unit_key string")
    progress = spark.createDataFrame([("a", 1, 10, "done")], "unit_key string, made long, tokens long, status string")
    got = sorted(map(tuple, runs.recover(spark, f"file://{tmp_path}/p", raw, progress).collect()))
    assert got == [("a", 1, 10, "done"), ("b", 2, None, "done")]


def test_stages_of_an_evaluation(spark, tmp_path, capsys):
    folder = str(tmp_path)
    assert main.main(["eval", "hyde", folder]) == runs.WRONG_INPUT
    case = {"case_id": "q1", "user_input": "lương tối thiểu vùng", "reference": "lương tối thiểu vùng là mức thấp nhất", "reference_contexts": ["x"], "synthesizer_name": "single", "source_document": "L", "source_section": "1"}
    (tmp_path / "testset.json").write_text(json.dumps([case, case | {"case_id": "q2", "user_input": "thuế thu nhập", "reference": "thuế"}]))
    rows = [(f"c{k}", "L", f"L - Điều {k}. x", t, False, None) for k, t in enumerate(["lương tối thiểu vùng là mức thấp nhất", "thuế thu nhập cá nhân", "nghỉ hằng năm"])]
    files.write_swapped(spark.createDataFrame(rows, "chunk_id string, source_document string, breadcrumb string, content string, has_table boolean, raw_table string"), f"{folder}/chunks")
    assert main.main(["eval", "nothing", folder]) == runs.WRONG_INPUT
    for stage in ("hyde", "embed", "retrieve", "generate", "score-recall", "score-answers", "score-precision", "status", "report"):
        assert main.main(["eval", stage, folder]) == runs.DONE, stage
    said = capsys.readouterr().out
    assert "'metric': 'score-recall', 'dimension': 'overall', 'value': 'all', 'mean': 1.0, 'n': 2" in said
    run = runs.Run(spark, f"{folder}/run", files.read_testset(spark, f"{folder}/testset.json"), ["case_id"], evaluation.stages(lambda asked: asked))
    assert {r.case_id: r.chunk_ids[0] for r in run.records("retrieve").collect()} == {"q1": "c0", "q2": "c1"}
