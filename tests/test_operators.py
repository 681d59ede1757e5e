"""Single operators on literal inputs with hand-computed results, and seeded properties."""

import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as fn
from lexmill.operators import bm25, chunking, citation, conversation, formatting, fusion, models, planning, ranking, reporting, throttle, units, verification
from lexmill.sources import docx, files, xlsx


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("query", "numbers"),
    [
        ("Điều 36 khoản 2 quy định gì", [36]), ("điều36", [36]), ("Điều thứ 5", [5]), ("Điều 36.2", [36]), ("Điều 3, 5 và 7", [3, 5, 7]),
        ("Điều 3 đến Điều 5", [3, 5]), ("Điều 3 và 5 ngày", [3]), ("điều 5 tháng", []), ("chiều 5", []), ("điều 2024", []), ("điều kiện 5", []),
        ("Điều IV", []), ("Đ.3", []), ("khoản 3", []), ("Điều 36 người lao động", [36]), ("Điều 3, 5.000 đồng", [3]), ("Điều 7 và Điều 7", [7]), ("", []),
    ],
)
def test_article_numbers(spark, query, numbers):
    assert one(spark, citation.article_numbers(F.col("q")), q=query) == numbers


def test_clauses_breadcrumbs_documents(spark):
    assert one(spark, citation.clause_numbers(F.col("q")), q="khoản 4, khoản 1, khoản 4, khoản 2, khoản 9") == [4, 1, 2]
    crumb = citation.breadcrumb_numbers(F.col("b"))
    for b, want in [
        ("LUẬT - Điều 7. Tên - Khoản 2 (phần 1/3)", (7, 2)), ("LUẬT - Điều 48a. Tên", (None, None)), ("X - Điều 7. T - Khoản 3a", (7, None)), ("", (None, None)),
        ("X - Khoản 2 - Điều 7", (7, None)),
    ]:
        assert tuple(one(spark, crumb, b=b)) == want
    detect = citation.detect_document(F.col("q"))
    assert one(spark, detect, q="Theo NGHỊ ĐỊNH hướng dẫn bộ luật lao động") == "nd_dkld"
    assert one(spark, detect, q="luat bhxh quy dinh") == "bhxh"
    assert one(spark, detect, q="luật BHXH và luật BHYT") is None
    assert one(spark, detect, q="bảo hiểm xã hội") is None


def test_text_functions(spark):
    for raw, want in [("3.3[3] Mức", "3. Mức"), ("10.[15] Mức", "10. Mức"), ("a)2[2]Thành", "a) Thành"), ("[4]4 a", "a"), ("Xã hội[16].", "Xã hội."), ("1.[2]Bảo", "1. Bảo")]:
        if raw != "3.3[3] Mức":
            assert one(spark, fn.strip_markers(F.col("t")), t=raw) == want
    assert one(spark, fn.strip_markers(F.col("t")), t="3.3[3] Mức") == "3. Mức"
    assert one(spark, fn.normalize(F.col("t")), t=" é  a b ") == "é a b"
    assert one(spark, fn.fold(F.col("t")), t="  Điều  KIỆN ") == "dieu kien"
    assert one(spark, fn.query_key_text(F.col("t")), t="  A  b ?!. ") == " a b"
    assert one(spark, fn.kind_of_line(F.col("t")), t="Điều 2 của Luật") is None
    assert one(spark, fn.kind_of_line(F.col("t")), t="Phần thứ nhất") == "part"
    keys = [one(spark, fn.number_key(F.col("t")), t=x) for x in ("48", "48a", "48b", "49")]
    assert [tuple(k) for k in keys] == sorted(tuple(k) for k in keys)


def test_bm25_formula(spark):
    rows = [(1, "lương tối thiểu"), (2, "điều 5 khoản 3"), (3, "lương lương hưu")]
    found = bm25.terms(spark.createDataFrame(rows, "d long, t string"), "d", "t")
    idf = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    avgdl, dl, tf = 10 / 3, 3, 2
    weights = {(r.d, r.term): r.weight for r in bm25.document_weights(found, "d").collect()}
    assert weights[3, "lương"] == pytest.approx(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))
    assert {r.term: r.idf for r in bm25.fit(found).collect()}["lương"] == pytest.approx(idf)
    asked = bm25.terms(spark.createDataFrame([(9, "Điều 5 khoản 3"), (8, "vắng")], "q long, t string"), "q", "t")
    hits = bm25.search(bm25.document_weights(found, "d"), "d", bm25.query_weights(asked, "q", bm25.fit(found)), "q", 5).collect()
    assert [(r.q, r.d, r["rank"]) for r in hits] == [(9, 2, 1)]


def test_fusion_and_mmr(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q long, d string, rank int")
    sparse = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "q long, d string, rank int")
    got = {r["rank"]: (r.d, r.rrf_score) for r in fusion.rrf(dense, sparse, "q", "d").collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["b", "a", "c"] and got[1][1] == pytest.approx(1 / 62 + 1 / 61)
    rows = [(1, "a", 1, [1.0, 0.2], [1.0, 1.0]), (1, "a2", 2, [1.0, 0.19], [1.0, 1.0]), (1, "b", 3, [0.2, 1.0], [1.0, 1.0]), (1, "n", 4, None, [1.0, 1.0])]
    c = spark.createDataFrame(rows, "q long, d string, pos int, vec array<double>, qvec array<double>")
    assert [r.d for r in fusion.mmr(c, "q", "d", 2).orderBy("rank").collect()] == ["a", "b"]
    for scores, low in [([], False), ([None], False), ([-7.3, -7.8], True), ([-7.0, -6.5], False), ([-6.8], False), ([None, -6.9], True)]:
        df = spark.createDataFrame([(s,) for s in scores], "s double")
        assert df.agg(fusion.low_relevance(F.col("s"))).first()[0] is low
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, fusion.cosine(zero, F.array(F.lit(1.0), F.lit(0.0)))) == 0.0


def test_report_scenario(spark):
    rows = [(1, 0.9, None, "x"), (2, 0.8, None, "y"), (3, float("nan"), None, "z"), (4, 0.5, "e", "w")]
    left = spark.createDataFrame(rows, "k long, score double, error string, context string")
    right = spark.createDataFrame([(1, 0.8, None, "x"), (2, 0.8, None, "q"), (3, 1.0, None, "z"), (5, 0.1, None, "w")], left.schema)
    r = reporting.paired(left, right, "k").first()
    assert (r.paired, r.excluded, r.wins, r.losses, r.ties, r.identical, r.mean_left, r.mean_right) == (2, 3, 1, 0, 1, 1, 0.85, 0.8)
    answers = spark.createDataFrame(
        [("answered", False, 0.9), ("answered", True, None), ("insufficient_evidence", False, None), ("unable_to_verify", False, None), ("error", False, None)],
        "outcome string, repair_used boolean, score double",
    )
    a = reporting.answer_group(answers).first()
    assert (a.refusal_rate, a.repair_rate, a.mean_answered, a.n_null, a.mean_end_to_end, a.n_end_to_end) == (0.4, 0.2, 0.9, 1, 0.3, 3)
    assert one(spark, reporting.average_precision(F.array(*[F.lit(x) for x in (1, 0, 1)]))) == pytest.approx((1 + 2 / 3) / 2)


def test_allocation_and_packing(spark):
    rows = spark.createDataFrame([(k, w) for k, w in enumerate([3, 3, 3, 1])], "k long, w long")
    got = {r.k: r.share for r in ranking.largest_remainder(rows, [], F.col("w"), F.lit(10), ["k"]).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 1}
    assert planning.question_mix(157) == {"single_hop": 125, "multi_hop_abstract": 16, "multi_hop_specific": 16}
    assert one(spark, ranking.packed_groups(F.array(*[F.lit(x) for x in (3, 4, 5, 20, 1)]), 9)) == [0, 0, 1, 2, 3]
    many = spark.range(5000).withColumn("v", F.col("id") % 7)
    got = ranking.global_running(many, ["v", "id"], F.col("v"), "s").orderBy("v", "id").select("v", "s").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.s == total


def test_split_content():
    lead = "Người lao động được:"
    text = lead + "\n\n" + "\n\n".join(f"{c}) " + " ".join(f"{c}{k}" for k in range(6)) for c in "abc")
    parts = chunking.split_content(text, 17)
    assert [labels for _, labels in parts] == [["a", "b"], ["c"]] and all(t.startswith(lead) for t, _ in parts)
    long = "a) " + ". ".join(" ".join(f"w{j}{k}" for k in range(5)) for j in range(4)) + "."
    parts = chunking.split_content(long, 10)
    assert [x[1] for x in parts] == [["a"]] * 3 and all(len(t.split()) <= 10 for t, _ in parts)
    assert chunking.split_content("a b c. d e f. g h i.", 6) == [("a b c. d e f.", []), ("g h i.", [])]


def test_tables(spark):
    raw = "| A | B<br>C |\n|:--|---|\n| 1 | 2 | 3 |\n| x |  |"
    assert one(spark, chunking.standard_table(F.col("r")), r=raw) == "1 - BC: 2 - : 3\nx - BC: "
    assert one(spark, chunking.standard_table(F.col("r")), r="<table><td>a<br>b</td><td> </td><td>&lt;c</td></table>") == "a b <c"


def test_emit(spark):
    rows = [(1, "Phụ lục I"), (2, "DANH MỤC (Kèm theo Nghị định)"), (3, "28. Thành phố"), (4, "Chương I"), (5, "QUY ĐỊNH"), (6, "Điều 1. Phạm vi"), (7, "1. Nội dung"), (8, "a) điểm")]
    blocks = spark.createDataFrame([("d", k, "paragraph", t) for k, t in rows], "doc string, pos int, kind string, text string")
    got = [r.line for r in formatting.emit(blocks).orderBy("pos", "part").collect()]
    assert got == ["# Phụ lục I — DANH MỤC", "(Kèm theo Nghị định)", "##### 28. Thành phố", "## Chương I. QUY ĐỊNH", "#### Điều 1. Phạm vi", "##### Khoản 1", "Nội dung", "a) điểm"]


def test_validate(spark):
    text = "##### Khoản 1\n####### sâu\n#### Điều 2. A\n##### Khoản 2\n##### Khoản 2\n#### Điều 1. B\n# Phụ lục I\n##### 1. x [3]"
    got = {(r.code, r.detail) for r in formatting.validate(spark.createDataFrame([(1, text)], "doc long, text string")).collect()}
    assert got == {
        ("heading_level_skip", "dòng 1: Khoản 1"), ("heading_too_deep", "dòng 2: #######"), ("khoan_not_monotonic", "dieu:2 -> khoản 2"),
        ("dieu_not_monotonic", "Điều 1"), ("empty_dieu", "Điều 1. B"), ("orphan_footnote", "[3]"),
    }
    assert [r.code for r in formatting.validate(spark.createDataFrame([(1, "x")], "doc long, text string")).collect()] == ["no_heading"]


def test_recursive_split_keeps_words():
    for seed in range(40):
        random.seed(seed)
        text = "".join("từ " * random.randint(1, 80) + random.choice(["\n\n", "\n", ". ", "; "]) for _ in range(random.randint(1, 60)))
        pieces = units.recursive_split(text, 50)
        assert all(len(p.split()) <= 50 for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())


def test_throttle_against_brute_force(spark):
    random.seed(5)
    calls = sorted((random.randint(0, 300), k, random.randint(1, 4000)) for k in range(60))
    df = spark.createDataFrame([("b", k, s, n) for s, k, n in calls], "b string, k long, s long, n long")
    got = {r.k: r.start for r in throttle.delays(df, "b", "s", "n", "k", 8000, 30).collect()}
    done = []
    for s, k, n in calls:
        t = max(s, done[-1][0] if done else 0)
        while True:
            live = [(a, m) for a, m in done if t - a < 60]
            if len(live) + 1 <= 27 and sum(m for _, m in live) + n <= 7200:
                break
            t = live[0][0] + 60
        done.append((t, n))
        assert got[k] == t
    for header, want in [(None, 15.0), ("nan", 15.0), ("0.2", 1.0), ("500", 60.0), ("7.5", 7.5)]:
        df = spark.createDataFrame([(header,)], "h string")
        assert df.select(throttle.retry_after(F.col("h"))).first()[0] == want


def test_conversation(spark):
    rows = [(1, 1, "assistant", "mồ côi"), (1, 2, "user", "một"), (1, 3, "assistant", "trả lời [1]" + conversation.SOURCES_MARK + "x"), (1, 4, "assistant", "thừa"), (1, 5, "user", "hai"), (1, 6, "user", " ba ")]
    w = conversation.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert w.query == "ba" and [(m.role, m.text) for m in w.history] == [("user", "một"), ("assistant", "trả lời"), ("user", "hai")]
    pieces = one(spark, conversation.replay_pieces(F.col("t")), t=" a b  c d e\nf ")
    assert "".join(pieces) == " a b  c d e\nf " and len(pieces) == 2


def test_verification(spark):
    loose = verification.unverified(F.col("a"), F.array(F.col("e")))
    got = one(spark, loose, a="1. Mức 4.960.000 đồng [9], 30 ngày, 7 lần, 5.", e="4 960 000 và 12")
    assert [(v.value, v.sensitive) for v in got] == [("30", True), ("7", False)]
    assert one(spark, verification.cited(F.col("t")), t="[2] x【1】[2]") == [2, 1]
    assert one(spark, verification.clearly_not_research(F.col("t")), t="Xin chào!") and not one(spark, verification.clearly_not_research(F.col("t")), t="dịch câu này là gì")


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = (
        "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Điều 1.</w:t></w:r></w:p><w:p/>"
        f"<w:tbl><w:tr>{cell('A')}{cell('B|')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl><w:tbl><w:tr>{cell('x &lt;')}</w:tr></w:tbl>"
    )
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "A.DOCX").write_bytes(buffer.getvalue())
    (tmp_path / "d" / "~$A.docx").write_bytes(b"x")
    (tmp_path / "d" / "bad.docx").write_bytes(b"no zip")
    rows = docx.read_docx(spark, f"file://{tmp_path}/d").orderBy("path", "pos").collect()
    good = [r for r in rows if r.error is None]
    assert [(r.pos, r.kind, r.is_bold) for r in good] == [(1, "paragraph", True), (2, "table", False), (3, "table", False)]
    assert good[1].text == "| A | B\\| |\n| --- | --- |\n| 1 |  |" and "<td>x &lt;</td>" in good[2].text
    assert [r.error for r in rows if r.error] == ["BadZipFile"]

    sheet = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {sheet}><si><t>recall</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {sheet}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>0.5</v></c></row><row r="3"><c r="A3"/></row></sheetData></worksheet>')
    (tmp_path / "x.xlsx").write_bytes(buffer.getvalue())
    r = xlsx.metric_means(xlsx.read_xlsx(spark, f"file://{tmp_path}"), ["recall"]).first()
    assert (r["mean"], r.n) == (0.5, 1)

    log = tmp_path / "log.jsonl"
    lines = [{"k": 1, "v": 1}, {"k": 2, "v": 2}, {"k": 1, "v": 3}]
    log.write_text("\n".join(map(json.dumps, lines)) + '\n{"k": 3, "v"')
    assert {(r.k, r.v) for r in files.read_log(spark, f"file://{log}", "k int, v int", ["k"]).collect()} == {(1, 3), (2, 2)}
    log.write_text('{"k": 1, "v": 1}\n{bro\n{"k": 2, "v": 2}\n')
    with pytest.raises(Exception, match="broken line"):
        files.read_log(spark, f"file://{log}", "k int, v int", ["k"]).collect()

    chunks = spark.createDataFrame([("c1", "LUẬT - Điều 1. A", "nội dung"), ("c2", "LUẬT - Điều 2. B", "khác")], "chunk_id string, breadcrumb string, content string")
    assert files.save_index(chunks, f"file://{tmp_path}/ix") == 2
    postings, _, _ = files.load_index(spark, f"file://{tmp_path}/ix")
    assert postings.filter("term = 'điều_1'").first().chunk_id == "c1"
    with pytest.raises(FileNotFoundError):
        files.load_index(spark, f"file://{tmp_path}/none")


def test_models(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(60)], "k long, t string").coalesce(1)
    calls = {"n": 0}

    def client(texts):
        calls["n"] += 1
        if "t30" in texts:
            raise OSError
        return [[1.0, 2.0]] * len(texts)

    rows = models.embed(df, "k", "t", client).collect()
    assert sum(r.vec is None for r in rows) == 25 and {r.error for r in rows} == {None, "OSError"}
    assert one(spark, F.size(models.standin_encoder(F.col("t"))), t="a b") == models.DIMENSION


def test_command_line(spark, tmp_path, capsys):
    from lexmill import __main__ as cli

    assert cli.main(["queries"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert cli.main(["chunk", "x"]) == 2
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "luat.md").write_text("**LUẬT**\n\n# THỬ\n\n## Chương I\n\n#### Điều 1. Phạm vi\n\n##### Khoản 1\n\nMức lương tối thiểu.\n\n---\n\nhết")
    assert cli.main(["chunk", f"file://{tmp_path}/md", f"file://{tmp_path}/chunks"]) == 0
    rows = spark.read.parquet(f"file://{tmp_path}/chunks").collect()
    assert [(r.breadcrumb, r.content) for r in rows] == [("LUẬT THỬ - Chương I - Điều 1. Phạm vi - Khoản 1", "Mức lương tối thiểu.")]
    assert cli.main(["index", f"file://{tmp_path}/chunks", f"file://{tmp_path}/ix"]) == 0
    assert cli.main(["search", f"file://{tmp_path}/ix", "mức lương"]) == 0
    assert rows[0].chunk_id in capsys.readouterr().out
