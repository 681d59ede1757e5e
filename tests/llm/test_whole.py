"""What the operators once left out: each test fails on the code before its finding was settled."""

import pytest

import corpus_pipeline
from lexmill.llm import decontaminate, lines, simhash, toxicity
from lexmill.llm.common import keep


def test_repeated_lines_go_whole(spark):
    short = "Of to on oust. Ndth ennd. Is.\nTHONRE!! THE!! ESER!!\nYes.\n"
    inside = "a passage of five words and more."
    rows = [(1, short + "Own line of one."), (2, short), (3, f"Yes. {inside} No.\n{inside}"), (4, f"New. {inside} Old.\nOWN  line of One.\n \n")]
    got = {r.doc_id: r for r in lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), runs=5).collect()}
    assert {k: r.text for k, r in got.items()} == {1: rows[0][1], 2: "", 3: f"Yes. {inside} No.\n", 4: "New. Old.\n \n"}
    assert [tuple(s) for s in got[2].spans] == [(0, len(short))] and got[1].n_removed == 0


def test_op7_leaves_no_copy(spark):
    """Every word of an exact later copy of a whole document goes, and every later copy of a line."""
    from lexmill.llm import queries

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen, copies = set(), 0
    stays = {r.doc_id: r.text for r in queries.op7_unit_dedup(spark, sf).collect()}
    for k in sorted(texts):
        if texts[k] in seen:
            copies += 1
            assert not (stays[k] or "").split()
        seen.add(texts[k])
    assert copies and stays.keys() == texts.keys()
    left = [" ".join(x.lower().split()) for t in stays.values() for x in (t or "").split("\n") if x.split()]
    assert len(left) == len(set(left))


def test_disguises_of_any_length_and_spacing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    for written in ("st" + 45 * "u" + "pid", "stuupid", "s t u p ! d", "s  t  u  p  i  d", "s.t*u_p i d"):
        assert "stupid" in toxicity.restored_words(f"so {written}", model, {}), written
    assert "idiot" in toxicity.restored_words("iddiot", model, {})
    assert toxicity.restored_words("a $ $", model, {}) & {"as", "ass"}
    assert "idiot" in toxicity.restored_words("y o u a r e a n i d i o t", model, {})
    assert {"you", "idiot"} <= toxicity.restored_words("y o u  a r e  a n  i d i o t", model, {})
    assert {"will", "speech"} <= toxicity.restored_words("will speech", model, {})
    assert len(toxicity.restore("a1" * 50_000, model)) >= 50_000


@pytest.mark.parametrize(
    ("stage", "module", "name"),
    [
        ("drop_toxic", toxicity, "score"),
        ("dedup_line_windows", lines, "repeated_windows"),
        ("keep_one_of_each_group", simhash, "near_duplicates"),
        ("drop_contaminated", decontaminate, "decontaminate"),
    ],
)
def test_ids_hold_when_splits_change(spark, tmp_path, monkeypatch, stage, module, name):
    """Files are read in other splits once a stage's operator is done, as after executors are lost or join."""
    sf, size = "/root/testdata/sf0.001", "spark.sql.files.maxPartitionBytes"
    spark.read.parquet(f"{sf}/documents.parquet").repartition(6, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    run, inner = getattr(corpus_pipeline, stage), getattr(module, name)
    read = lambda: spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r.doc_id, r.text) for r in run(spark, read(), sf).collect())
    before = spark.conf.get(size)

    def moved(*args, **more):
        out = keep(inner(*args, **more))
        spark.conf.set(size, "1000")
        return out

    monkeypatch.setattr(module, name, moved)
    try:
        assert sorted((r.doc_id, r.text) for r in run(spark, read(), sf).collect()) == want
    finally:
        spark.conf.set(size, before)
