"""Byte-level BPE encoding and decoding.

Whole texts are split by the public pattern, and the tokenizers library encodes each piece; a worker remembers the
pieces it has met, so the library sees each of them about once and what is left per text is a lookup. The vocabulary is
a file of ranks: a token's rank is its id, and any two tokens that make up a third are a merge, in order of its rank. A byte-level
vocabulary writes each byte as one printable character; the table of these is made from its public rule, and decoding
reverses it. Offsets of tokens come in characters of the text, so a token that holds a part of a character has the
offsets of all of it.

Null texts encode as empty. Empty texts have no ids. Repeated rows give repeated results. Lone surrogates cannot reach
here: Spark strings are UTF-8. The path of the vocabulary is a parameter; each Python worker loads it once.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are taken in slices of about so many characters: memory follows the slice, not the batch.
SLICE_CHARS = 2_000_000
#: Bytes of pieces and their ids that a worker remembers, beside those of one slice; beyond it starts anew.
MEMO = 128 << 20
#: What the pattern's white space is: the Unicode property, which Python's \\s differs from.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def splitter(pattern: str | None = None) -> regex.Pattern:
    """The pattern, with white space spelled out."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    pattern = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(pattern)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """A vocabulary with what this process has encoded by it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        char = {b: c for c, b in byte_of_char().items()}
        spelled = {raw: "".join(map(char.__getitem__, raw)) for raw in ranks}
        merges = [
            (spelled[raw[:k]], spelled[raw[k:]])
            for raw in sorted(ranks, key=ranks.__getitem__)
            for k in range(1, len(raw))
            if raw[:k] in ranks and raw[k:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={spelled[raw]: k for raw, k in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = splitter().findall
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for raw, k in ranks.items():
            self.pieces[k] = raw
        #: Ids of a piece as little-endian 32-bit numbers, and the places of its tokens.
        self.ids: dict[str, bytes] = {}
        self.places: dict[str, list[tuple[int, int]]] = {}
        self.held = 0

    def take(self, texts: list[str], offsets: bool) -> list[list[str]]:
        """The pieces of each text, all of them remembered from here on."""
        split = [self.split(t) for t in texts]
        if self.held > MEMO:
            self.ids.clear()
            self.places.clear()
            self.held = 0
        known = self.places if offsets else self.ids
        fresh = [p for p in set().union(*split) if p not in known]
        if fresh:
            [e] = self.tokenizer.encode_batch([fresh], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(e.word_ids), np.arange(len(fresh)), side="right").tolist()
            places = e.offsets if offsets else []
            # An entry takes about 150 bytes beside its characters and ids, and a place about 130.
            self.held += sum(map(len, fresh)) * 2 + len(raw) + 150 * len(fresh) + 130 * len(places)
            for p, a, b in zip(fresh, [0, *ends], ends):
                self.ids[p] = raw[4 * a : 4 * b]
                if offsets:
                    self.places[p] = places[a:b]
        return split

    def encoded(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, pieces))

    def decoded(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about SLICE_CHARS characters; a longer text stands alone."""
    part: list[str] = []
    size = 0
    for t in texts:
        if part and size + len(t) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def decode_bytes(ids: Iterable[int], path: str | None = None) -> bytes:
    return load(path or default_path()).decoded(ids)


def decode_stream(ids: Iterable[int], path: str | None = None) -> Iterator[str]:
    """The text of each id in turn; a character split over several ids comes with its last one, and bytes that are no
    UTF-8 come as U+FFFD."""
    pieces, reader = load(path or default_path()).pieces, codecs.getincrementaldecoder("utf-8")("replace")
    for k in ids:
        yield reader.decode(pieces[k])
    if rest := reader.decode(b"", True):
        yield rest


def encode(docs: DataFrame, path: str | None = None, offsets: bool = True, check: bool = False) -> DataFrame:
    """doc_id, ids and, if wanted, starts and ends of each token in characters, and round_trip: whether the ids decode
    to the bytes of the text."""
    path = path or default_path()
    kinds = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}
    kinds |= {"starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())} if offsets else {}
    kinds |= {"round_trip": pa.bool_()} if check else {}
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", round_trip boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            keys, at = batch.column(0), 0
            for part in slices([t or "" for t in batch.column(1).to_pylist()]):
                split = codec.take(part, offsets)
                ids = [np.frombuffer(codec.encoded(p), "<i4") for p in split]
                columns = [keys.slice(at, len(part)), pa.array(ids, kinds["ids"])]
                if offsets:
                    starts, ends = [], []
                    for pieces in split:
                        a, b, here = [], [], 0
                        for piece in pieces:
                            for x, y in codec.places[piece]:
                                a.append(here + x)
                                b.append(here + y)
                            here += len(piece)
                        starts.append(a)
                        ends.append(b)
                    columns += [pa.array(starts, kinds["starts"]), pa.array(ends, kinds["ends"])]
                if check:
                    columns.append(pa.array([codec.decoded(k.tolist()) == t.encode() for k, t in zip(ids, part, strict=True)]))
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of each row of ids; null ids decode to no bytes."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            out = [codec.decoded(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass over the texts and returns the digests of both ways per document: n_tokens,
    ids_sha256, decoded_sha256 and whether the decoded bytes are those of the text."""
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            keys, at = batch.column(0), 0
            for part in slices([t or "" for t in batch.column(1).to_pylist()]):
                n, of_ids, of_bytes, same = [], [], [], []
                for text, pieces in zip(part, codec.take(part, False), strict=True):
                    raw = codec.encoded(pieces)
                    back = codec.decoded(np.frombuffer(raw, "<u4").tolist())
                    n.append(len(raw) // 4)
                    of_ids.append(hashlib.sha256(raw).hexdigest())
                    of_bytes.append(hashlib.sha256(back).hexdigest())
                    same.append(back == text.encode())
                columns = [keys.slice(at, len(part)), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes), pa.array(same)]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
