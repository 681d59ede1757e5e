"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has a bit set where over half of the shingle hashes have it. Two fingerprints that differ in at most
DISTANCE of 64 bits agree on at least BLOCKS - DISTANCE of BLOCKS blocks, so they meet in a bucket for one choice of
that many blocks. Equal fingerprints are one node; what is joined are distinct fingerprints only.

Rows of a hot bucket or fingerprint are joined without a shuffle. No bucket is gathered whole: one that holds more than BUCKET fingerprints is dealt into parts, and each pair of parts is
a task's work of bounded size. A task compares fingerprints by XOR and bit count and emits a star for each group it has
found, never all pairs. Stars of all tasks meet in connected components by large-star and small-star steps, as joins and
minima whose edges are written to the shared folder after each round.

Texts that are null or have no words have fingerprint zero, which links like any other. With fewer words than a shingle
has, the whole sequence is the one shingle. Repeated rows share a fingerprint and so a component. A null doc_id is never
a component's name unless the whole component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, join_counted, keep

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Blocks of a fingerprint: with 6, a bucket's key has 32 bits or so, enough for billions of fingerprints.
BLOCKS = 6
#: Fingerprints of a bucket that are compared with one another in one go.
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    ones = np.zeros(64, np.int64)
    rows = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for a in range(0, n, 4096):
        ones += np.unpackbits(rows[a : a + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """A signed 64-bit mask for each choice of blocks - distance of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def groups(found: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars (root, member) over the distinct fingerprints that hang together within one part of a bucket."""
    rest = found
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        waiting, members = [root], []
        while waiting and rest.size:
            near = np.bitwise_count(rest ^ waiting.pop()) <= distance
            if near.any():
                waiting.extend(rest[near])
                members.append(rest[near])
                rest = rest[~near]
        if members:
            members = np.concatenate(members)
            yield np.full(members.size, root), members


def links(nodes: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp of nodes that connect all which differ in few enough bits."""
    masks = block_masks(blocks, distance)
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(masks)]))
    keyed = nodes.select("fp", key.alias("b")).select("fp", "b.t", "b.k")
    sizes = keep(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # A bucket of several parts is seen once for each two of them; a bucket of one part once.
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")), lambda x: x != F.col("part"))
    ))
    dealt = (
        join_counted(keyed, sizes, ["t", "k"])
        .withColumn("parts", F.ceil(F.col("n") / bucket))
        .withColumn("part", part)
        .withColumn("other", other)
        .select("t", "k", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key: tuple | None = None
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            if held:
                found = np.unique(np.concatenate(held))
                if found.size == 2:
                    if (int(found[0]) ^ int(found[1])).bit_count() <= distance:
                        out.append((found[:1], found[1:]))
                elif found.size > 2:
                    out.extend(groups(found, distance))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = [0, *cut.tolist()]
            for a, b in zip(starts, [*starts[1:], len(fps)]):
                now = tuple(int(k[a]) for k in keys)
                if now != held_key:
                    close()
                    held, held_key = [], now
                held.append(fps[a:b])
            if out:
                yield _edges(out)
                out.clear()
        close()
        if out:
            yield _edges(out)

    return dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _edges(stars: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ends = [np.concatenate([s[k] for s in stars]).view(np.int64) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and root, its component's smallest node, for every node of the undirected edges (a, b)."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        # A task's edges shrink to stars; it holds one number per node that it has met, up to a bound.
        def stars() -> pa.RecordBatch:
            rows = [(x, top(x)) for x in list(parent) if top(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:
                yield stars()
                parent.clear()
        yield stars()

    def both(df: DataFrame) -> DataFrame:
        return df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(df.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def smallest(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))

    now = keep(edges.mapInArrow(forest, "a long, b long"))
    before = None
    while True:
        # Large star: every neighbour above u moves to the smallest node near u.
        # A root has as many neighbours as its component has nodes; its rows stay where they are.
        around = both(now)
        large = join_counted(around, keep(smallest(around)), ["u"]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: u and its neighbours below it move to the smallest of them.
        down = keep(large.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        least = keep(smallest(down))
        small = join_counted(down, least, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = keep(small.filter("a <> b").distinct())
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(after) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = tuple(after)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable over links) and component_size for every row."""
    found = keep(fingerprints(docs, shingle))
    nodes = keep(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp"), distance=distance, blocks=distance + 3))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    # One row per distinct fingerprint meets the rows of all documents; those of a fingerprint that very many share stay.
    classes = keep(named.select("fp", "n", "root").join(sizes, "root").select("fp", "n", "component_id", "component_size"))
    return join_counted(found, classes, ["fp"]).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", "component_size")


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
