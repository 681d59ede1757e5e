import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import bpe

TEXTS = [
    None, "", "  x 　y", "áé  \n\n z <|endoftext|> x", "𝟘½Ⅷ ١٢", "'S 'Ll x'll it's", "\x00\x01 \x85 ​﻿\x1c\x1d \x1f",
    "😀👨‍👩‍👧 x  ", "a" * 5000, " " * 3000 + "x", "\n \n\t x\r\n",
]


@pytest.fixture(scope="module")
def ranks():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})


def test_ids_are_those_of_the_rank_file(spark, ranks):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], None)], "doc_id long, text string, ids string")
    rows = bpe.digests(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        ids = ranks.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.round_trip


def test_offsets_and_decoding(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    encoded = bpe.encode(docs)
    for r in encoded.collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert "".join(bpe.decode_stream(r.ids)) == text
        for k, a, b in zip(r.ids, r.starts, r.ends):
            piece = bpe.decode_bytes([k])
            assert piece in text[a:b].encode()
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded).collect()}
    assert got == {k: (t or "").encode() for k, t in enumerate(TEXTS)}
    assert bpe.encode(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_random_texts(ranks, text):
    codec = bpe.load(bpe.default_path())
    [pieces] = codec.take([text], False)
    ids = ranks.encode_ordinary(text)
    assert codec.encoded(pieces) == struct.pack(f"<{len(ids)}I", *ids)
    assert codec.decoded(ids) == text.encode()
