"""Suffix-array dedup of repeated byte strings, with deep-shallow sorting.

Every byte covered by a string of LENGTH bytes that also starts anywhere else goes. Suffixes of the whole corpus are too
many to sort, so a sparse suffix array is built, of those suffixes that can matter:

1. Each string of LENGTH bytes has an anchor: the leftmost of its runs of GRAM bytes whose digest is smallest. Equal
   strings have their anchors at the same place, so strings are told apart within the class of their anchor's digest.
   Strings that follow one another mostly share an anchor; the bytes that they cover are the anchor's context.
2. Anchors whose digest is found once in the corpus are dropped. Equal contexts, by 128 bits of a digest of their bytes,
   are counted: where a context is found twice, all its strings are repeated, and only one copy of it goes on. A passage
   with a million copies is one row here; its copies are told by their places from contexts that are found once, so they
   never meet in a join.
3. Within a class, what follows the anchors is sorted by suffix and what precedes them by reversed prefix: multikey
   quicksort over eight bytes at a time down to a shallow depth, blind tries for groups that still agree. From the two
   orders and the lengths of common prefixes, the strings at each distance before the anchor fall into equal ones.
4. A class of many different contexts is dealt into blocks of bounded size. Each block is sorted by itself and then
   sends one digest per distinct string; digests that several blocks send mark strings that a block saw but once.

Null texts have no bytes. Texts under LENGTH bytes lose nothing. Repeated rows are documents of their own and repeat each
other. Long texts are read in pieces that overlap by LENGTH - 1 bytes, so memory does not follow the longest text much;
a cut only makes two contexts of one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, RID, hold, join_counted, keep, numbered

LENGTH, GRAM = 200, 40
#: Different contexts that are sorted in one go.
BLOCK = 2048
#: Bytes that multikey quicksort looks at before the blind tries take over.
SHALLOW = 16
#: Parts that the rows of a hot anchor are dealt into.
SALTS = 64
#: Strings of a text that are digested in one go.
PIECE = 1 << 20


# Sorting


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """The members in the order of their strings, by a trie whose inner nodes know only a place and the bytes there.

    A string goes down blindly to some leaf; its common prefix with that leaf alone tells where it branches off.
    """
    # Inner node: [place, {byte or -1: child}]; leaf: list of members with equal strings, wrapped in a tuple.
    root: object = ([members[0]],)
    for m in members[1:]:
        s = strings[m]
        node = root
        while isinstance(node, list):
            place, children = node
            child = children.get(s[place] if place < len(s) else -1)
            node = next(iter(children.values())) if child is None else child
        leaf = strings[node[0][0]]
        shared = common(s, leaf)
        if shared == len(s) == len(leaf):
            node[0].append(m)
            continue
        mine = s[shared] if shared < len(s) else -1
        parent, node = None, root
        while isinstance(node, list) and node[0] < shared:
            parent = (node[1], s[node[0]])
            node = node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == shared:
            node[1][mine] = ([m],)
        else:
            other = leaf[shared] if shared < len(leaf) else -1
            new = [shared, {mine: ([m],), other: node}]
            if parent is None:
                root = new
            else:
                parent[0][parent[1]] = new
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(node[0])
    return out


def deep_shallow(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices of the strings in their order; known: bytes that all of them share."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), known)]
    while stack:
        members, depth = stack.pop()
        if len(members) == 1:
            out.append(members[0])
        elif depth >= known + shallow:
            out.extend(blind_trie(strings, members))
        else:
            # A key that ends with the string is padded with zeros and then smaller by its length.
            keys = {m: (strings[m][depth : depth + 8].ljust(8, b"\0"), min(8, len(strings[m]) - depth)) for m in members}
            pivot = sorted((keys[members[0]], keys[members[len(members) // 2]], keys[members[-1]]))[1]
            less, same, more = [], [], []
            for m in members:
                k = keys[m]
                (same if k == pivot else less if k < pivot else more).append(m)
            if more:
                stack.append((more, depth))
            if pivot[1] < 8:  # all of these have ended
                stack.extend([([m], depth) for m in reversed(same)])
            else:
                stack.append((same, depth + 8))
            if less:
                stack.append((less, depth))
    return out


def _order(strings: list[bytes], known: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string, and for each rank the bytes shared with the rank before."""
    if len(strings) == 2:
        swap = strings[1] < strings[0]
        return np.array([int(swap), int(not swap)]), np.array([0, common(*strings)])
    order = deep_shallow(strings, known)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array([0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))])


def repeated_starts(contexts: list[bytes], anchors: list[int], widths: list[int], length: int = LENGTH, gram: int = GRAM):
    """For contexts of one anchor: the class of the string that starts so many bytes (row) before the anchor of each
    context (column), -1 where none starts there, and whether another context has an equal string there."""
    n = len(contexts)
    after = [c[a:] for c, a in zip(contexts, anchors, strict=True)]
    before = [c[:a][::-1] for c, a in zip(contexts, anchors, strict=True)]
    first = after[0][:gram]
    known = gram if all(x.startswith(first) for x in after) else 0
    rank_a, shared_a = _order(after, known)
    rank_b, shared_b = _order(before, 0)
    a, w = np.array(anchors), np.array(widths)
    far = np.arange(a.max() + 1)[:, None]
    classes = (shared_a < length - far).cumsum(1)[:, rank_a] * (n + 1) + (shared_b < far).cumsum(1)[:, rank_b]
    classes = np.where((far <= a) & (far > a - w), classes, -1 - np.arange(n))
    order = classes.argsort(1, kind="stable")
    ordered = np.take_along_axis(classes, order, 1)
    twin = np.zeros(classes.shape, bool)
    equal = ordered[:, 1:] == ordered[:, :-1]
    twin[:, 1:] |= equal
    twin[:, :-1] |= equal
    repeated = np.empty_like(twin)
    np.put_along_axis(repeated, order, twin, 1)
    return classes, repeated


# Anchors


@functools.cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and the powers of an odd base and of its inverse modulo 2**64."""
    numbers = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
    base = 0x9E3779B97F4A7C15
    up, down = np.full(size + 1, base, np.uint64), np.full(size + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return numbers, np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = a.size
    blocks = np.full(-(-n // w) * w, ~np.uint64(0))
    blocks[:n] = a
    blocks = blocks.reshape(-1, w)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors_of(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each context of a text: digest of its anchor, where it starts, how far after that its anchor stands, and how
    many strings start in it."""
    parts = []
    for at in range(0, len(raw) - length + 1, PIECE):
        data = np.frombuffer(raw, np.uint8, min(PIECE + length - 1, len(raw) - at), at)
        numbers, up, down = _tables(PIECE + length if data.size > 65536 else 65536)
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(numbers[data] * up[: data.size], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * down[: sums.size - gram])
        # The place stands in the low bits, so the leftmost of equal digests is smallest.
        low = np.uint64(21)
        packed = (grams >> low << low) | np.arange(grams.size, dtype=np.uint64)
        place = (_sliding_min(packed, length - gram + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        width = np.diff(np.append(start, place.size))
        anchor = place[start]
        parts.append((grams[anchor].view(np.int64), start + at, anchor - start, width))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def contexts_of(raw: bytes, start: np.ndarray, far: np.ndarray, width: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """128 bits of each context, two numbers to a row: a digest of its bytes, seeded with its shape."""
    digest, view = xxhash.xxh3_128_digest, memoryview(raw)
    shape = (far * 1024 + width).tolist()
    found = b"".join([digest(view[a:b], seed) for a, b, seed in zip(start.tolist(), (start + width + length - 1).tolist(), shape)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


def _spot(start, far, width):
    """Place of a context in one number."""
    return start << 16 | far << 8 | (width - 1)


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    for t in texts.cast(pa.binary()).to_pylist():
        yield t or b""


def _in_parts(docs: DataFrame, columns: list[str], of_text) -> DataFrame:
    """Rows of longs that of_text gives, as one array per column, for a RID and the bytes of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def flush() -> pa.RecordBatch:
            joined = [np.concatenate(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in joined], names=columns)

        for batch in batches:
            for rid, raw in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                if len(raw) >= LENGTH:
                    out.append(of_text(rid, raw))
                    size += out[-1][0].size
                    if size > 200_000:
                        yield flush()
                        size = 0
        if out:
            yield flush()

    return docs.select(RID, "text").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def anchors(docs: DataFrame) -> DataFrame:
    """key (digest of an anchor) and n (how often a text has it); docs has RID and text."""
    return _in_parts(docs, ["key", "n"], lambda rid, raw: np.unique(anchors_of(raw)[0], return_counts=True))


def contexts(docs: DataFrame) -> DataFrame:
    """RID, key (digest of the anchor), c and d (digest of the context) and spot; docs has RID and text."""

    def of_text(rid: int, raw: bytes) -> tuple[np.ndarray, ...]:
        key, start, far, width = anchors_of(raw)
        found = contexts_of(raw, start, far, width)
        return np.full(key.size, rid, np.int64), key, found[:, 0], found[:, 1], _spot(start, far, width)

    return _in_parts(docs, [RID, "key", "c", "d", "spot"], of_text)


# Dedup


def _packed(docs: DataFrame) -> DataFrame:
    """RID, doc_id and the compressed bytes of each text, for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([zip_(b) for b in _bytes(part.column(2))], pa.binary())], names=[RID, "doc_id", "z"]
                )

    return docs.select(RID, "doc_id", "text").mapInArrow(run, f"{RID} long, doc_id long, z binary")


def _cut(rows: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts: rows has RID, z and wanted, of key, block, c, n, blocks and spot."""
    names = ["key", "block", "c", RID, "start", "n", "blocks", "far", "width", "bytes"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            for rid, z, wanted in zip(*batch.columns, strict=True):
                rid, raw = rid.as_py(), unzip(z.as_py())
                for w in wanted.as_py():
                    start, far, width = w["spot"] >> 16, w["spot"] >> 8 & 255, (w["spot"] & 255) + 1
                    out.append((w["key"], w["block"], w["c"], rid, start, w["n"], w["blocks"], far, width, raw[start : start + width + LENGTH - 1]))
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.select(RID, "z", "wanted").mapInArrow(
        run, f"key long, block int, c long, {RID} long, start long, n long, blocks int, far int, width int, bytes binary"
    )


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sorted_blocks(found: DataFrame) -> DataFrame:
    """RID, s and e (in bytes) of runs of repeated strings of contexts that are found once; and for strings of keys in
    several blocks one row per distinct string, with its digests g and h, and without RID where it only testifies."""
    names = [RID, "s", "e", "g", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def close(group: list[dict]) -> None:
            blocks = group[0]["blocks"]
            if len(group) < 2 and blocks < 2:
                return
            raws, far, width = [r["bytes"] for r in group], [r["far"] for r in group], [r["width"] for r in group]
            classes, repeated = repeated_starts(raws, far, width)
            for k, r in enumerate(group):
                if r["n"] == 1:
                    starts = np.zeros(r["width"], bool)
                    rows = np.arange(max(0, r["far"] - r["width"] + 1), r["far"] + 1)
                    starts[r["far"] - rows] = repeated[rows, k]
                    out.extend((r[RID], r["start"] + a, r["start"] + b - 1 + LENGTH, None, None) for a, b in _runs(starts))
            if blocks > 1:
                for d in range(classes.shape[0]):
                    _, firsts = np.unique(classes[d], return_index=True)
                    for k in firsts.tolist():
                        if classes[d, k] >= 0:
                            r = group[k]
                            at = r["far"] - d
                            x = xxhash.xxh3_128_digest(r["bytes"][at : at + LENGTH])
                            # A string that this block has twice, or whose context is repeated, is settled.
                            settled = bool(repeated[d, k]) or r["n"] > 1
                            s = r["start"] + at
                            out.append((None if settled else r[RID], s, s + LENGTH, int.from_bytes(x[:8], signed=True), int.from_bytes(x[8:], signed=True)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group and (r["key"], r["block"]) != (group[0]["key"], group[0]["block"]):
                    close(group)
                    group = []
                    if len(out) > 50_000:
                        yield flush()
                group.append(r)
        if group:
            close(group)
        yield flush()

    return (
        found.repartition("key", "block")
        .sortWithinPartitions("key", "block", "c", RID, "start")
        .mapInArrow(run, f"{RID} long, s long, e long, g long, h long")
    )


def _of_keys(rows: DataFrame, often: DataFrame) -> DataFrame:
    """The rows whose key is among often (key and n, a row a key), and a column salt. Rows are made once and are many, so
    those of a hot key, of which there are HOT at most, are salted rather than read a second time."""
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = often.filter(F.col("n") * HOT > F.lit(total)).select("key", F.lit(True).alias("hot"))
    parts = F.array(*[F.lit(k) for k in range(SALTS)])
    sides = often.join(F.broadcast(hot), "key", "left").select("key", F.explode(F.when(F.col("hot"), parts).otherwise(F.array(F.lit(0)))).alias("salt"))
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64(RID, "spot"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return rows.join(F.broadcast(hot), "key", "left").withColumn("salt", dealt).drop("hot").join(sides, ["key", "salt"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """RID and spans (start and end, in bytes, unordered) of what is repeated; docs has RID, doc_id and text."""
    often = keep(anchors(docs).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"))
    found = hold(_of_keys(contexts(docs), often).drop("salt"))
    distinct = hold(found.groupBy("key", "c", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(RID, "spot")).alias("one")))
    several = hold(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    mixed = join_counted(distinct, several, ["key"], "m").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    wanted = mixed.select(
        F.col(f"one.{RID}").alias(RID),
        F.struct("key", F.pmod("c", "blocks").cast("int").alias("block"), "c", "n", "blocks", F.col("one.spot").alias("spot")).alias("w"),
    )
    listed = wanted.groupBy(RID).agg(F.collect_list("w").alias("wanted"))
    ordered = hold(_sorted_blocks(_cut(_packed(docs).drop("doc_id").join(listed, RID))))
    # Strings of one class in several blocks.
    sent = ordered.filter("g IS NOT NULL")
    shared = sent.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "h")
    across = sent.filter(F.col(RID).isNotNull()).join(shared, ["g", "h"]).select(RID, "s", "e")
    alone = ordered.filter("g IS NULL").select(RID, "s", "e").unionByName(across)
    # Whatever isn't the one place of a context that is found once is a copy.
    once = distinct.filter("n = 1").select(F.col(f"one.{RID}").alias(RID), F.col("one.spot").alias("spot"))
    start = F.shiftright("spot", 16)
    copied = found.select(RID, "spot").join(once, [RID, "spot"], "left_anti").select(
        RID, start.alias("s"), (start + F.col("spot").bitwiseAND(F.lit(255)) + LENGTH).alias("e")
    )
    spans = hold(alone.unionByName(copied).groupBy(RID).agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    spans.count()
    for held in (ordered, several, distinct, found):
        held.unpersist()
    return spans


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes and spans (start and end of each removed run) per document."""
    return _finish(docs, lambda raw, kept, spans: kept, pa.binary(), "kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 per document."""
    done = _finish(docs, lambda raw, kept, spans: hashlib.sha256(kept).hexdigest(), pa.string(), "kept_sha256 string")
    return done.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )


def _finish(docs: DataFrame, result, kind: pa.DataType, column: str) -> DataFrame:
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, results, removed = [], [], []
                for z, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw, gone = unzip(z), merge(spans)
                    ends = [0, *(x for span in gone for x in span), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                    sizes.append(len(raw))
                    results.append(result(raw, kept, gone))
                    removed.append([{"s": s, "e": e} for s, e in gone])
                span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(results, kind)],
                    names=["doc_id", "n_bytes", "spans", column.split()[0]],
                )

    return (
        _packed(rows).join(repeated_spans(rows), RID, "left").select("doc_id", "z", "spans")
        .mapInArrow(run, f"doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, {column}")
    )
