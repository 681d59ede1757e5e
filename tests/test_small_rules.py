"""Rules of a few lines each: rewriting with one retry, usage, caches, selectors, validation, progress, checkpoints."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.operators import conversation, planning, stages


def test_a_rewrite_is_tried_again_only_where_it_was_cut_off(spark):
    history = [("user", "lương tối thiểu là gì"), ("assistant", "là mức thấp nhất")]
    turns = [(1, "còn vùng 2?", history), (2, "thế còn?", []), (3, "và Điều 5?", history), (4, "rồi sao?", history), (5, "sao nữa?", history), (6, "gì?", None)]
    df = spark.createDataFrame(turns, "turn int, query string, history array<struct<role:string,text:string>>")
    asked = []

    def ask(rows):
        asked.append(sorted(r.turn for r in rows.collect()))
        k = len(asked)
        answers = {1: ("", "length") if k == 1 else ("lương tối thiểu vùng 2", "stop"), 3: ("theo Điều 99", "stop"), 4: ("", "length"), 5: (None, "error")}
        return rows.sparkSession.createDataFrame([(t, *answers[t]) for t in asked[-1]], "turn int, raw string, finish string")

    got = {r.turn: (r.text, r.reason, r.calls) for r in conversation.condense(df, "turn", ask).collect()}
    assert asked == [[1, 3, 4, 5], [1, 4]]
    assert got == {
        1: ("lương tối thiểu vùng 2", "ok", 2), 2: ("thế còn?", "no_history", 0), 3: ("và Điều 5?", "unknown_citation", 1),
        4: ("rồi sao?", "finish_length", 2), 5: ("sao nữa?", "call_failed", 1), 6: ("gì?", "no_history", 0),
    }


def test_usage_of_providers(spark):
    raw = ['{"input_tokens": 5, "output_tokens": 2, "output_token_details": {"reasoning": 1}}', '{"prompt_tokens": 7}', "{}", None, '{"completion_tokens_details": {"reasoning_tokens": 3}}']
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(conversation.provider_usage(F.col("raw")).alias("u")).collect()
    assert [None if r.u is None else tuple(r.u) for r in rows] == [(5, 2, 1), (7, None, None), None, None, (None, None, 3)]


def test_an_empty_list_is_never_kept(spark):
    cache = spark.createDataFrame([("a", ["x"], 100), ("b", ["y"], 90_000)], "k string, value array<string>, expires_at long")
    found = spark.createDataFrame([("a", ["z"], 50), ("b", [], 95_000), ("c", [], 1), ("d", None, 1), ("e", ["w"], 2)], "k string, value array<string>, at long")
    got = {r.k: (r.value, r.expires_at) for r in conversation.store_retrievals(cache, found, "k", 3600).collect()}
    assert got == {"a": (["z"], 3650), "b": (["y"], 90_000), "e": (["w"], 3602)}


def test_selectors(spark):
    rows = [("a.md", 1), ("a.md", 2), ("luật ố.md", 1), ("luật ố.md", 3)]
    units = spark.createDataFrame([(d, k, f"{d}#{k}") for d, k in rows], "document string, index long, unit_key string")
    pick = lambda *only: sorted(r.unit_key for r in planning.select(units, list(only)).collect())
    assert pick() == sorted(f"{d}#{k}" for d, k in rows)
    assert pick("a") == ["a.md#1", "a.md#2"] and pick("a.md#2", "luật ố#3") == ["a.md#2", "luật ố.md#3"]
    assert pick("luật ố") == ["luật ố.md#1", "luật ố.md#3"]  # decomposed marks
    for bad, said in (("b", "there are a.md, luật ố.md"), ("a#7", "a.md has units 1 to 2"), ("luật ố#2", "has units 1 to 3"), ("a#x", "a.md has units")):
        with pytest.raises(ValueError, match=said):
            planning.select(units, ["a", bad])


def test_rows_of_a_final_file(spark):
    schema = "position long, case_id string, user_input string, reference string, reference_contexts array<string>"
    good = [(1, "a", "q", "r", ["c"]), (2, "b", "q", "r", ["c"])]
    bad = [(3, "a", "q", "r", ["c"]), (4, None, " ", "r", []), (5, "e", "q", "r", [" "])]
    got = {r.position: r.problem for r in planning.invalid_rows(spark.createDataFrame(good + bad, schema)).collect()}
    assert got == {3: "repeated case_id", 4: "empty: case_id, user_input, reference_contexts", 5: "empty: reference_contexts"}
    review = spark.createDataFrame([(1, "drop"), (2, "keep")], "pos long, verdict string")
    assert [r.case_id for r in planning.finalized(spark.createDataFrame(good, schema), review).collect()] == ["b"]
    with pytest.raises(ValueError, match="row 3: repeated"):
        planning.finalized(spark.createDataFrame(good + bad, schema), review)


def test_sources_of_new_cases(spark):
    new = spark.createDataFrame([("u1", 1, "q1"), ("u1", 2, "q2"), ("u2", 3, "q2"), ("u2", 4, "old")], "unit_key string, position long, user_input string")
    units = spark.createDataFrame([("u1", "a.md", "Chương I"), ("u2", "b.md", "Chương II")], "unit_key string, document string, title string")
    old = spark.createDataFrame([("old",)], "user_input string")
    got = sorted((r.user_input, r.source_document, r.source_section) for r in planning.attached(new, units, old).collect())
    assert got == [("q1", "a.md", "Chương I"), ("q2", "a.md", "Chương I")]


def test_progress_files(spark, tmp_path):
    path = f"{tmp_path}/progress.json"
    assert planning.load_progress(spark, path).collect() == []
    (tmp_path / "progress.json").write_text(json.dumps([{"unit_key": "a", "made": 1, "tokens": None, "status": "done"}]))
    assert [tuple(r) for r in planning.load_progress(spark, path).collect()] == [("a", 1, None, "done")]
    for text in ('[{"unit_key": "a", "status": "odd"}]', '[{"unit_key": "a", "made": 1'):
        (tmp_path / "other.json").write_text(text)
        with pytest.raises(Exception, match="corrupt|MALFORMED|Malformed"):
            planning.load_progress(spark, f"{tmp_path}/other.json").collect()


def test_files_of_a_first_phase(spark, tmp_path):
    for name in ("B.json", "a.json", "c.txt"):
        (tmp_path / name).write_text("[]")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.json").write_text("[]")
    got = [(r.position, r.source.rsplit("/", 1)[1], r.target) for r in stages.checkpoint_plan(spark, str(tmp_path), "/out/").orderBy("position").collect()]
    assert got == [(1, "a.json", "/out/a.json"), (2, "B.json", "/out/B.json")]
    assert stages.checkpoint_plan(spark, f"{tmp_path}/none", "/out").collect() == []
