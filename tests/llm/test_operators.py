"""Operators against brute-force versions, and on the edge cases that each docstring defines."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import decontaminate, langid, licenses, lines, quality, simhash, suffixes, toxicity
from lexmill.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, fp string, key string"
#: Names that an operator might use itself, and one that must be quoted.
CLASHES = ("gone", "__lines", "__gone", "row", "a.b", "lines", "n", "z", "spans", "toxic", "place", "h")
LONG = " ".join(f"word{k % 977} and text" for k in range(20_000))
EDGE = [
    (1, None, None, None, None, "x", "x", "x", "x"),
    (2, "", "en", "s", 0, None, None, None, None),
    (None, "no id, some words here", "en", "s", 5, "a", "b", "c", "d"),
    (3, "same text again\nwith two lines\nand a third one\n" * 12, "en", "s", 5, "a", "b", "c", "d"),
    (3, "same text again\nwith two lines\nand a third one\n" * 12, "en", "s", 5, "a", "b", "c", "d"),
    (4, LONG, "en", "s", 5, "a", "b", "c", "d"),
    (5, LONG + " tail", "fr", "s", 5, "a", "b", "c", "d"),
    (6, " \n\t   \u0000 é😀", "de", "s", 5, "a", "b", "c", "d"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = spark.createDataFrame(EDGE, SCHEMA)
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# Edge cases: every operator takes them, and gives one row per document


OPERATORS = {
    "licenses": lambda d, s: licenses.scan_licenses(d),
    "quality": lambda d, s: quality.judge(quality.measure(d)),
    "decontaminate": lambda d, s: decontaminate.decontaminate(d, s.createDataFrame([(1, None), (2, ""), (3, "same text again"), (None, "word3 and text")], "item_id long, text string")),
    "suffixes": lambda d, s: suffixes.digests(d),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.learn(d, s.createDataFrame([(3, 1), (4, 0), (None, 1), (2, None)], "doc_id long, toxic int"))),
    "units": lambda d, s: lines.dedup_units(d),
    "lines": lambda d, s: lines.line_report(d),
    "langid": lambda d, s: langid.identify(d),
    "simhash": lambda d, s: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases(spark, edge, name):
    rows = OPERATORS[name](edge, spark).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in EDGE)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, edge, name):
    assert OPERATORS[name](edge.limit(0), spark).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_cases(spark, edge, stage):
    found = dict(corpus_pipeline.STAGES)[stage](spark, edge, SF)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == edge.columns
        assert all(r[c] == f"own {c}" for r in found.collect() for c in CLASHES)
    assert found.count() > 0
    assert dict(corpus_pipeline.STAGES)[stage](spark, edge.limit(0), SF).count() == 0


def test_edge_results(spark, edge):
    by = {r.doc_id: r for r in licenses.scan_licenses(edge).collect()}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].labels, by[1].score) == (0, 0, None, "", 0.0)
    by = {r.doc_id: r for r in quality.judge(quality.measure(edge)).collect()}
    assert by[1].base_failed and not by[1].kept and by[2].n_words == 0
    found = lines.line_report(edge).collect()
    assert [r.n_removed for r in found if r.doc_id in (1, 2)] == [0, 0] and next(r for r in found if r.doc_id == 1).text is None
    twins = sorted(r.n_removed for r in found if r.doc_id == 3)
    assert twins[1] == 36 and twins[0] < 36  # the second copy goes whole
    by = {r.doc_id: r for r in suffixes.digests(edge).collect()}
    assert by[1].n_bytes == 0 and by[3].n_removed > 0 and by[4].n_removed > 0.9 * by[4].n_bytes
    near = {r.doc_id: r for r in simhash.near_duplicates(edge).collect()}
    assert near[1].fingerprint == "0" * 16 and near[1].component_id == near[2].component_id == 1
    assert near[5].component_id == 4
    by = {r.doc_id: r for r in langid.identify(edge).collect()}
    assert by[1].lang_pred == by[2].lang_pred == "und" and by[1].score == 0


# Licences


def test_license_base_against_brute_force(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for r in docs.collect():
        w = words(r.text)
        hits = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base) == (len(w), len(hits))
        assert (g.first_word, g.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert g.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def parsed(text):
    return licenses.to_postfix(licenses.tokenize(text)[0])


def test_expressions():
    e = parsed("(MIT OR Apache-2.0) AND GPL-2.0-or-later WITH Classpath-exception-2.0 then more")
    assert e == ["MIT", "Apache-2.0", "or", "GPL-2.0-or-later", "Classpath-exception-2.0", "with", "and"]
    assert licenses.evaluate(e) == ({"mit", "apache", "gpl"}, 0.5)
    assert licenses.evaluate(["MIT", "AGPL-3.0-only", "or"])[1] == 1.0
    for bad in ("", "AND MIT", "(MIT", "()", "of the author", "not-a-license"):
        assert parsed(bad) == []
    assert parsed("MIT OR") == parsed("MIT and so on") == parsed("MIT. More") == ["MIT"]
    row = licenses.scan("Code.\nSPDX-License-Identifier: BSD-3-Clause OR MIT\nmore text")
    assert row[5] == "bsd,mit" and row[8] == ["BSD-3-Clause MIT or"]
    assert licenses.scan("CC BY CC  by, cc-BY")[1:4] == (3, 0, 4)


@pytest.mark.parametrize(
    ("text", "labels", "unknown"),
    [
        ("The license expression of the author", "", 0),
        ("we discuss a license expression below", "", 0),
        ("SPDX-License-Identifier: MIT. More", "mit", 0),
        ("SPDX-License-Identifier: MIT/Apache-2.0", "apache,mit", 0),
        ("SPDX-License-Identifier: not-a-license", "", 1),
        ("license-expression = 'BSD-2-Clause'", "bsd", 0),
        ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note OR MIT", "gpl,mit", 0),
        ("SPDX-License-Identifier: GPL-3.0-only WITH Own-note-1 AND MIT", "gpl,mit", 1),
        ("SPDX-License-Identifier: (LGPL-2.1+ WITH SHL-2.1) AND (MIT OR GPL-2.0 WITH GPL-CC-1.0) ends", "gpl,lgpl,mit", 0),
        ("SPDX-License-Identifier: GPL-2.0 with thanks to all", "gpl", 0),
        ("SPDX-License-Identifier: LicenseRef-Own", "licenseref-own", 0),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of", "mit", 0),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", 0),
    ],
)
def test_labels_of_plain_prose(text, labels, unknown):
    row = licenses.scan(text)
    assert (row[5], row[10]) == (labels, unknown)


def brute_labels(text):
    """Labels by a search of word lists and a recursive descent over what stands behind a tag's colon."""
    w = words(text)
    found = {
        label
        for phrases in (licenses.BASE_PHRASES, licenses.NOTICE_PHRASES)
        for p, label in phrases.items()
        for k in range(len(w))
        if w[k : k + len(p.split())] == p.split()
    }
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    edge = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    for tag in licenses.TAGS:
        for m in re.finditer(rf"(?<!{edge})(?i:{gap.join(tag.split())})[\"']?[ \t]*[:=][ \t]*[\"']?(.*)", text or ""):
            tokens = re.findall(r"[()/]|[A-Za-z0-9](?:[A-Za-z0-9.+:\-]*[A-Za-z0-9+])?|[^ \t]", m.group(1))
            best: set = set()
            for n in range(1, len(tokens) + 1):
                got = brute_or(tokens[:n])
                best = got if got is not None else best
            found |= best
    return ",".join(sorted(found))


def brute_or(tokens):
    """The labels of tokens that are a whole expression, else None."""
    if not tokens:
        return None
    if len(tokens) == 1:
        label = licenses.family(tokens[0]) if tokens[0].lower() not in licenses.PRECEDENCE else None
        return None if label is None else {label}
    if len(tokens) > 2 and tokens[-2].lower() == "with" and ("exception" in tokens[-1].lower() or re.search(r"[0-9-]", tokens[-1]) or tokens[-1].lower() == "llgpl"):
        return brute_or(tokens[:-2])
    if tokens[0] == "(" and tokens[-1] == ")" and (inside := brute_or(tokens[1:-1])) is not None:
        return inside
    for k in range(1, len(tokens) - 1):
        if tokens[k].lower() in ("and", "or", "/"):
            a, b = brute_or(tokens[:k]), brute_or(tokens[k + 1 :])
            if a is not None and b is not None:
                return a | b
    return None


def test_labels_against_brute_force(docs):
    random.seed(7)
    pieces = ["Linux-syscall-note", "SHL-2.1", "MIT", "Apache-2.0", "or", "AND", "(", ")", "/", "with", "Classpath-exception-2.0", "GPL-2.0+", "nonsense", "CC0-1.0.", "LicenseRef-x"]
    made = [f"x SPDX-License-Identifier: {' '.join(random.choices(pieces, k=random.randint(1, 7)))}" for _ in range(400)]
    for text in made + [r.text for r in docs.collect()]:
        assert licenses.scan(text)[5] == brute_labels(text), text


# Quality


def test_ablation(docs):
    ledger = quality.measure(docs).toPandas()
    names = quality.POLICIES["v1"]
    bits = {r.name: 1 << r.bit for r in quality.RULES}
    everything = sum(bits[n] for n in names)
    for r in quality.ablation(quality.measure(docs)).collect():
        b = ledger.failed_bits & everything
        assert r.n_failed == ((b & bits[r.rule]) != 0).sum()
        assert r.n_failed_alone == (b == bits[r.rule]).sum()
        assert r.n_kept_without == ((b & ~bits[r.rule]) == 0).sum()


# Suffix arrays


def test_deep_shallow_sorts():
    random.seed(1)
    for _ in range(500):
        base = bytes(random.choice(b"ab") for _ in range(40))
        found = [base[: random.randint(0, 40)] + bytes(random.choice(b"a\0b") for _ in range(random.randint(0, 30))) for _ in range(random.randint(1, 30))]
        order = suffixes.deep_shallow(found, 0, random.choice([0, 8, 16]))
        assert [found[i] for i in order] == sorted(found)


@pytest.mark.parametrize("block", [2048, 3])
def test_suffix_dedup_against_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    extra = [(10_000 + k, "ab" * 300 + str(k)) for k in range(8)] + [(20_000, None), (20_001, "x" * 199), (20_002, "y" * 201)]
    # Blocks of a Thue-Morse word and of its complement, which agree in many digests that are sums of powers.
    thue = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    extra += [(30_000, thue), (30_001, thue.translate({97: "b", 98: "a"})), (30_002, thue[512:1024] + thue[:512]), (30_003, "x" + thue[1024:1300])]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r for r in suffixes.digests(df).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    seen = collections.Counter(b[k : k + 200] for b in texts.values() for k in range(len(b) - 199))
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


# Toxicity


def test_deobfuscation_and_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    chars = toxicity.CharModel(toxicity.np.frombuffer(model.counts, toxicity.np.int64))
    for written, meant in [("1d10t", "idiot"), ("m0r0n", "moron"), ("st.u.p.i.d", "stupid"), ("stuuupid", "stupid"), ("$cum", "scum")]:
        assert toxicity.restore(written, chars) == meant
    assert toxicity.restore("plain", chars) is None
    assert "loser" in toxicity.restored_words("what a l o s e r you are", chars, {})


def enumerated(word, model):
    """The likeliest reading by every path through the lattice."""
    best = None
    for choice in itertools.product(*toxicity.lattice(word)):
        letters = "".join(x for x, _ in choice)
        codes = [0, 0, *(model.known.get(c, 1) for c in letters), 0]
        score = sum(p for _, p in choice)
        score += sum(float(model.log[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:]))
        best = max(best, (score, letters)) if best else (score, letters)
    return best


def test_viterbi_against_enumeration(spark, docs):
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    random.seed(5)
    for _ in range(300):
        word = "".join(random.choice(random.choice(["ab01$!|*6eett", "aabt"])) for _ in range(random.randint(1, 8)))
        score, letters = enumerated(word, model)
        got = toxicity.viterbi(word, model)
        same = [s for choice in itertools.product(*toxicity.lattice(word)) if "".join(x for x, _ in choice) == got for s in [sum(p for _, p in choice)]]
        codes = [0, 0, *(model.known.get(c, 1) for c in got), 0]
        assert abs(max(same) + sum(float(model.log[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:])) - score) < 1e-3, (word, got, letters)


def test_labels_held_twice(spark):
    """A row that repeats counts once, a doc_id with both labels teaches nothing, texts of one doc_id count once."""
    texts = [(k, ("vile fool " if k % 2 else "kind friend ") + f"word{k}") for k in range(60)]
    labels = [(k, k % 2) for k in range(60)]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    more = spark.createDataFrame([*texts, *texts[:20], (500, "vile fool"), (500, "zzz"), (None, "x")], "doc_id long, text string")
    twice = spark.createDataFrame([*labels, *labels, (500, 0), (500, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    a = toxicity.learn(plain, spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = toxicity.learn(more, twice)
    assert abs(a.bias - b.bias) < 1e-6 and toxicity.np.allclose(a.weights, b.weights, atol=1e-6)


# Units


def brute_units(texts, runs):
    """What stays of texts in order, and how many units and sentences go, by sets of plain strings."""
    seen, known, out = set(), set(), []
    for text in texts:
        kept, n, rests = [], 0, set()
        for line in re.findall(r"[^\n]*\n|[^\n]+", text):
            name = " ".join(line.lower().split())
            if not name:
                kept.append(line)
            elif name in seen or name in rests:
                n += 1
            else:
                seen.add(name)
                body = line.strip()
                at = line.index(body)
                sentences = [""]
                for s in re.findall(r".+?(?:(?<=[.!?;])\s+|$)", body, re.S):
                    if 0 < len(sentences[-1].split()) < 5 and len(s.split()) < 5:
                        sentences[-1] += s
                    else:
                        sentences.append(s)
                sentences = sentences[1:]
                marks = []
                for s in sentences:
                    x = " ".join(s.lower().split())
                    marks.append(x in known)
                    known.add(x)
                left = ""
                for gone, group in itertools.groupby(zip(marks, sentences), key=lambda p: p[0]):
                    group = [s for _, s in group]
                    if gone and sum(len(s.split()) for s in group) >= runs:
                        n += len(group)
                    else:
                        left += "".join(group)
                rest = " ".join(left.lower().split())
                if left != body:
                    if not rest or rest in seen or rest in rests:
                        continue
                    rests.add(rest)
                kept.append(line[:at] + left + line[at + len(body) :])
        out.append(("".join(kept), n))
    return out


@pytest.mark.parametrize("runs", [25, 5, 1])
def test_units_against_brute_force(spark, docs, runs):
    random.seed(6)
    some = ["Yes.", "No; never.", "A passage of five words.", "so it  goes!", "Why?"]
    made = [(100_000 + k, "".join(random.choice(some) + random.choice([" ", "\n", " \n\n", "  "]) for _ in range(random.randint(0, 12)))) for k in range(150)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    want = brute_units([r.text or "" for r in rows], runs)
    got = {r.doc_id: r for r in lines.dedup_units(df, runs=runs).collect()}
    for r, (text, n) in zip(rows, want):
        g = got[r.doc_id]
        assert (g.text or "", g.n_removed) == (text, n), r.doc_id
        left, at = [], 0
        for s in g.spans:
            left.append(r.text[at : s["start"]])
            at = s["end"]
        assert "".join(left) + (r.text or "")[at:] == text


def test_a_short_line_is_no_copy_of_a_sentence(spark):
    rows = [(1, "One here. And. Another there."), (2, "And.\nYes."), (3, "Yes. And so on.\nand.")]
    got = {r.doc_id: r.text for r in lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "Yes. And so on.\n"}


def test_paragraphs(spark):
    rows = [(1, "One line\nand two.\n\nAnother.\n"), (2, "Fresh.\n \none  LINE\nand two.\n\n\nAnother. Not")]
    got = {r.doc_id: r for r in lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), kind="paragraph", runs=None).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "Fresh.\n \nAnother. Not" and (got[2].n_units, got[2].n_removed) == (3, 1)


def test_many_lines_that_repeat(spark):
    """The work follows the lines, however many of them go."""
    text = "\n".join(f"line {k % 50_000}" for k in range(100_000))
    [r] = lines.line_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_lines, r.n_removed) == (100_000, 50_000)


# Languages


def brute_phrases(text, sample):
    known = set(sample)
    n = i = 0
    while i < len(text):
        n += 1
        j = i + 1
        while text[i] in known and j < len(text) and text[i : j + 1] in sample:
            j += 1
        i = j
    return n


@pytest.mark.parametrize("dense", [4 << 20, 10])
def test_cross_parsing_against_brute_force(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    random.seed(2)
    samples = {x: "".join(random.choice(c) for _ in range(300)) for x, c in (("aa", "abcd "), ("bb", "bcde "), ("cc", "ab"))}
    model = langid.Model(samples)
    texts = ["".join(random.choice("abcdez ") for _ in range(random.randint(1, 900))) for _ in range(30)]
    texts += ["".join(random.choice("ab") for _ in range(5000)), "ab" * 2500, "z" * 700, samples["cc"][20:200] * 6, ""]
    folded = [langid.fold(t) for t in texts]
    plain = ["".join(map(chr, f)) for f in folded]
    known = ["".join(map(chr, langid.fold(samples[n]))) for n in model.names]
    want = [[brute_phrases(t, s) for s in known] for t in plain]
    for segment in (512, 64, 7, 2):
        assert model.phrases(folded, segment).tolist() == want


def test_large_alphabets_stay_small():
    """A sample of a language with thousands of letters makes no table of states by letters."""
    random.seed(8)
    text = "".join(chr(0x4E00 + random.randrange(2400)) for _ in range(langid.SAMPLE_CHARS))
    made = langid.Model({"zh": text, "en": "of the and to in " * 1900})
    size = sum(x.nbytes for a in made.automata for x in (a.letters, a.begin, a.table, a.keys, getattr(a, "to", None)) if x is not None)
    assert size < 20e6 and made.predict([text[700:720] + text[90:95], "in the"])[0] == ["zh", "en"]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97 and all(0 <= r.score <= 1 for r in rows)


# SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    found = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in fps}


def test_simhash_against_brute_force(docs):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    rows = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("bucket", [4096, 4])
def test_links_of_crowded_buckets(spark, bucket):
    random.seed(3)
    found = {0}
    for _ in range(300):
        x = random.choice(sorted(found))
        for b in random.sample(range(64), random.randint(1, 4)):
            x ^= 1 << b
        found.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in found], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, bucket=bucket)).collect()}
    want = brute_components({x: x for x in found})
    by_want, by_got = collections.defaultdict(set), collections.defaultdict(set)
    for x in found:
        by_want[want[x]].add(signed(x))
        by_got[roots.get(signed(x), signed(x))].add(signed(x))
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


# Queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(llm_queries.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_pipeline_against_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect() if r.predicted}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    # Lines covered by later occurrences of three lines.
    seen, new = set(), {}
    for i in sorted(left):
        parts = (left[i] or "").split("\n")
        full = [k for k, x in enumerate(parts) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:]):
            window = tuple(parts[k].strip(" \t\n\x0b\x0c\r") for k in (a, b, c))
            if window in seen:
                gone |= {a, b, c}
            seen.add(window)
        new[i] = "\n".join(x for k, x in enumerate(parts) if k not in gone)
    roots = brute_components({i: brute_fingerprint(t) for i, t in new.items()})
    firsts = {i: t for i, t in new.items() if roots[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(13, len(w))
        windows |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    final = set()
    for i, t in firsts.items():
        w, hit = words(t), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
        if not (hit and 20 * len(hit) >= len(w)):
            final.add(i)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == final and len(rows) == len(final)
    from lexmill.llm import bpe

    for r in rows:
        assert r.round_trip and bpe.decode_bytes(r.ids) == firsts[r.doc_id].encode() and r.n_tokens == len(r.ids)


def test_decontamination_by_shuffle(spark, docs, monkeypatch):
    """The ways with few and with many windows, and with a bitmap of its largest size, agree."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(decontaminate.decontaminate(docs, items).collect())
    monkeypatch.setattr(decontaminate, "FEW", 0)
    monkeypatch.setattr(decontaminate, "BITMAP", 1 << 17)
    assert sorted(decontaminate.decontaminate(docs, items).collect()) == want and any(r.n_hit for r in want)
    monkeypatch.setattr(decontaminate, "BITMAP", 1)
    monkeypatch.setattr(decontaminate, "LARGEST", 1)
    assert sorted(decontaminate.decontaminate(docs, items).collect()) == want
