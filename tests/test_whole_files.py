"""Whole files: front, body and back put together, files that fail kept apart, chunks of all regions in order."""

import collections
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill import __main__ as main
from lexmill.operators import models, whole_files
from lexmill.sources import docx

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PARTS = ["CỘNG HÒA", "NGHỊ ĐỊNH", "VỀ LƯƠNG", "Căn cứ Luật", "Chương I", "QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "1. Nội dung một", "2. Nội dung hai"]


def document(paragraphs, signed=True, back=()):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('Nơi nhận: A')}</w:tc><w:tc>{p('B')}</w:tc></w:tr></w:tbl>" if signed else ""
    body = "".join(map(p, paragraphs)) + table + "".join(map(p, back))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docx")
    (path / "a.docx").write_bytes(document(PARTS, back=["Chú thích [1]", "cuối"]))
    (path / "b.docx").write_bytes(b"no archive")
    (path / "c.docx").write_bytes(document([]  , signed=False))
    (path / "d.docx").write_bytes(document(["LUẬT", "Điều 1. Một", "1. Chỉ một"], signed=False))
    (path / "~$a.docx").write_bytes(b"lock")
    return path


def by_name(df):
    return {r.path.rsplit("/", 1)[1]: r for r in df.collect()}


def test_files_that_fail_leave_the_others_whole(spark, folder, tmp_path):
    found = main.to_markdown(spark, str(folder))
    good, failed = whole_files.write_apart(found, f"{tmp_path}/out")
    assert {k: r.error for k, r in by_name(failed).items()} == {"b.docx": "BadZipFile", "c.docx": "empty"}
    rows = by_name(good)
    assert rows["a.docx"].text == (
        "CỘNG HÒA\n\nNGHỊ ĐỊNH\n\n# VỀ LƯƠNG\n\nCăn cứ Luật\n\n## Chương I. QUY ĐỊNH CHUNG\n\n#### Điều 1. Phạm vi\n\n"
        "##### Khoản 1\n\nNội dung một\n\n##### Khoản 2\n\nNội dung hai\n\n---\n\nChú thích [1]\n\ncuối\n"
    )
    assert rows["d.docx"].text == "LUẬT\n\n#### Điều 1. Một\n\n##### Khoản 1\n\nChỉ một\n"
    codes = {k: [w.code for w in r.warnings] for k, r in rows.items()}
    assert codes["a.docx"][:1] == [whole_files.DROPPED_TABLE] and whole_files.NO_TITLE in codes["d.docx"]


def test_a_region_that_fails_goes_whole(spark, folder):
    """The title stays where the text before it is lost; the back is lost alone."""

    def some_fail(text):
        if "CỘNG HÒA" in text or "cuối" in text:
            raise ConnectionError
        return text.upper()

    rows = by_name(main.to_markdown(spark, str(folder), whole_files.calling(some_fail, 2), front="F: %s", tokens=3))
    text, codes = rows["a.docx"].text, [w.code for w in rows["a.docx"].warnings]
    assert text.startswith("# VỀ LƯƠNG\n\nF: CĂN CỨ LUẬT\n\n## Chương I") and "---" not in text
    assert codes.count(whole_files.FRONT_FAILED) == 1 and whole_files.BACK_FAILED in codes


def test_equal_prompts_are_called_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def client(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise TimeoutError
        return text + "!"

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["same"] * 50 + ["bad"] * 3 + ["other", None])], "k int, t string").repartition(4)
    got = models.called_once(rows, "t", client, 2).collect()
    calls = collections.Counter(open(log).read().split())
    assert calls == {"same": 1, "bad": 2, "other": 1}
    assert collections.Counter((r.t, r.result, r.error, r.attempts) for r in got) == {("same", "same!", None, 1): 50, ("bad", None, "TimeoutError", 2): 3, ("other", "other!", None, 1): 1, (None, None, "null_text", 0): 1}
    few = models.called_once(rows, "t", str, 2, budget=4).collect()
    assert len({r.t for r in few if r.error is None}) == 2 and {r.error for r in few} == {None, "over_budget", "null_text"}


def test_chunks_of_all_regions(spark, tmp_path):
    text = "VĂN BẢN HỢP NHẤT\n\n# LUẬT A\n\nCăn cứ " + "x " * 30 + "\n\n#### Điều 1. Một\n\n##### Khoản 1\n\nNội dung\n\n##### Khoản 2\n\nHai\n\n---\n\nchú thích. cuối\n"
    (tmp_path / "a.md").write_text(text)
    (tmp_path / "b.md").write_text("#### Điều 1. Chỉ\n\n##### Khoản 1\n\nthân")
    found = main.to_chunks(spark, str(tmp_path), 20).orderBy("doc", "place").collect()
    mine = [r for r in found if r.doc.endswith("a.md")]
    assert [r.place.region for r in mine] == sorted(r.place.region for r in mine)
    assert [r.breadcrumb for r in mine if r.place.region == 1] == ["VĂN BẢN HỢP NHẤT LUẬT A - Điều 1. Một - Khoản 1", "VĂN BẢN HỢP NHẤT LUẬT A - Điều 1. Một - Khoản 2"]
    front, back = ([r for r in mine if r.place.region == k] for k in (0, 2))
    assert len(front) > 1 and front[0].breadcrumb == f"VĂN BẢN HỢP NHẤT LUẬT A (phần 1/{len(front)})"
    assert " ".join(" ".join(r.content for r in front).split()) == " ".join(text.split("####")[0].split())
    assert [(r.breadcrumb, r.content) for r in back] == [(f"VĂN BẢN HỢP NHẤT LUẬT A - {whole_files.BACK_SUFFIX}", "chú thích. cuối")]
    assert [r.content for r in found if r.doc.endswith("b.md")] == ["thân"]
    assert len({r.chunk_id for r in found}) == len(found)


def test_read_docx_has_errors(spark, folder):
    assert docx.read_docx(spark, str(folder)).filter("error IS NOT NULL").count() == 2
