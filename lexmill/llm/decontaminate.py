"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is WINDOW consecutive words of an item, or all words of a shorter one. A document holds a window if it holds all
its shingles of SHINGLE words at the right places, so one necessary shingle per window is enough to find candidates: the
rarest, by counts over all documents. That is the prefix of a set join with containment 1. The place of the shingle in
the window then gives the one start that the window can have; starts that leave the document fall to the length bound,
and what is left is verified word by word.

One pass over the texts keeps, per document, its word count and those places whose shingle may stand in an item, by a
bitmap. It has SPARE bits for each shingle of the items, up to LARGEST longs (6.7 million shingles); beyond, a fuller
bitmap lets more places through and loses none, so the exact join behind it does more of the work. Everything after
works on these places.

Nulls have no words: a document without words is never hit, and an item without words hits none. Repeated items count
once; windows of an item without item_id hit words but list no item. Repeated documents are judged each on its own.
Documents that share one passage meet its window in a join with one row on its side, which is broadcast where there are
FEW windows and dealt over SALTS tasks elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, alnum_words, keep, numbered

WINDOW, SHINGLE = 13, 5
#: Contaminated: at least one word hit, and a share of all words as 1 : SHARE.
SHARE = 20
#: Longs of the bitmap, least and most (256 KB and 8 MB); each shingle sets two bits.
BITMAP, LARGEST = 1 << 15, 1 << 20
#: Bits of the bitmap for each shingle: two of ten are set at most, so one in thirty passes by chance.
SPARE = 10
#: Windows that are broadcast, of 13 words at most. Beyond that, rows of a shingle are dealt over SALTS tasks, so that
#: one that very many documents share doesn't fill one of them.
FEW, SALTS = 20_000, 16


def shingles(words: Column, n: Column, size: int) -> Column:
    """Digest and start (from 1) of each run of so many words."""
    starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), F.slice(words, i, size)).alias("sh"))
    )


def _bits(sh: Column, longs: int) -> list[tuple[Column, Column]]:
    """Places in a bitmap of so many longs, a power of two, of a shingle: index of a long, and a bit of it. Each place
    has 26 bits of the digest of its own."""
    out = []
    for k in (0, 26):
        h = F.shiftrightunsigned(sh, k)
        out.append((F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(longs - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")))
    return out


def _bit(word: Column, k: Column) -> Column:
    return F.call_function("getbit", word, k)


def bitmap(found: DataFrame) -> tuple[Column, int]:
    """A constant array of longs with the bits of the column sh, and how many longs it has: LARGEST at most."""
    wanted = found.agg(F.approx_count_distinct("sh")).first()[0] * SPARE // 64
    longs = min(max(BITMAP, 1 << wanted.bit_length()), LARGEST)
    places = found.select(F.explode(F.array(*[F.struct(i.alias("i"), b.alias("b")) for i, b in _bits(F.col("sh"), longs)])).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.b"))
    rows = places.groupBy(F.col("p.i").alias("i")).agg(F.bit_or(one).alias("w")).collect()  # LARGEST rows at most
    words = [0] * longs
    for r in rows:
        words[r["i"]] = r["w"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), longs  # folded into one constant


def may_hold(bits: tuple[Column, int], sh: Column) -> Column:
    words, longs = bits
    (i, a), (j, b) = _bits(sh, longs)
    return (_bit(F.get(words, i), a) == 1) & (_bit(F.get(words, j), b) == 1)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words of a window and how many they are; equal windows of an item once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("k", F.least(F.lit(window), F.size("words")))
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1), lambda i: F.slice("words", i, F.col("k")))
    return items.select("item_id", F.explode(F.array_distinct(cut)).alias("win")).distinct()


def places(docs: DataFrame, sizes: list[int], bits: tuple[Column, int]) -> DataFrame:
    """One row per document: RID, doc_id, n_words, words (null without places) and places (at, size, sh)."""
    split = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), alnum_words(F.col("text")).alias("words"))
    found = F.flatten(
        F.array(
            *[
                F.transform(
                    F.filter(shingles(F.col("words"), F.size("words"), s), lambda x: may_hold(bits, x["sh"])),
                    lambda x, s=s: F.struct(x["at"].alias("at"), F.lit(s).alias("size"), x["sh"].alias("sh")),
                )
                for s in sizes
            ]
        )
    )
    return split.select(RID, "doc_id", "words", F.size("words").alias("n_words"), found.alias("places")).select(
        RID, "doc_id", "n_words", F.when(F.size("places") > 0, F.col("words")).alias("words"), "places"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids (sorted as strings) per document."""
    found = keep(windows(benchmark, window))
    size = F.least(F.lit(shingle), F.size("win"))
    # Shingles are as long as the shortest items force them to be: SHINGLE sizes at most.
    sizes = sorted(r[0] for r in found.select(size).distinct().collect())
    of_size = [
        found.select("win").distinct().filter(size == s).select("win", F.explode(shingles(F.col("win"), F.size("win"), s)).alias("x"))
        for s in sizes
    ]
    if not of_size:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(alnum_words(F.col("text"))).alias("n_words"))
        return _report(rows.withColumns({"n_hit": F.lit(0), "item_ids": F.array().cast("array<string>")}))
    inside = of_size[0]
    for more in of_size[1:]:
        inside = inside.unionByName(more)
    inside = keep(inside.select("win", F.col("x.at").alias("at"), F.col("x.sh").alias("sh")))

    placed = keep(places(docs, sizes, bitmap(inside)))
    counts = placed.select(F.explode("places.sh").alias("sh")).groupBy("sh").agg(F.count(F.lit(1)).alias("n"))
    # The prefix of each window: its rarest shingle. A window with a shingle that no document has occurs nowhere.
    ranked = inside.join(counts, "sh", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("sh"), F.col("at"))).alias("p"))
    prefix = keep(ranked.filter("p.n > 0").select("win", F.size("win").alias("k"), F.col("p.sh").alias("sh"), F.col("p.at").alias("off")))

    rare = bitmap(prefix.select("sh"))
    picked = F.filter("places", lambda x: may_hold(rare, x["sh"]))
    around = F.greatest(F.col("p.at") - (window - 1), F.lit(1))
    tokens = (
        placed.filter("words IS NOT NULL")
        .select(RID, "n_words", "words", F.explode(picked).alias("p"))
        .select(RID, "n_words", F.col("p.sh").alias("sh"), F.col("p.at").alias("at"), around.alias("base"), F.slice("words", around, F.lit(2 * window + shingle)).alias("near"))
    )
    start = F.col("at") - F.col("off") + 1
    if prefix.count() <= FEW:
        met = tokens.join(F.broadcast(prefix), "sh")
    else:
        dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = tokens.withColumn("salt", F.pmod(F.xxhash64(RID, "at"), F.lit(SALTS)).cast("int")).join(dealt, ["sh", "salt"])
    hits = (
        met
        .withColumn("start", start)
        .filter((F.col("start") >= 1) & (F.col("start") + F.col("k") - 1 <= F.col("n_words")))
        .filter(F.slice("near", F.greatest(F.col("start") - F.col("base") + 1, F.lit(1)), F.col("k")) == F.col("win"))
        .select(RID, "start", "k", "win")
    )
    hits = keep(hits)
    spans = hits.groupBy(RID).agg(
        F.array_sort(F.collect_set(F.struct((F.col("start") - 1).alias("s"), (F.col("start") + F.col("k") - 1).alias("e")))).alias("spans")
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["e"], x["e"]).alias("e"),
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"]))).cast("long").alias("n"),
        ),
    )["n"]
    listed = (
        hits.select(RID, "win").distinct().join(found.filter("item_id IS NOT NULL"), "win").select(RID, "item_id").distinct()
        .groupBy(RID).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    )
    return _report(
        placed.select(RID, "doc_id", "n_words").join(spans.select(RID, merged.alias("n_hit")), RID, "left").join(listed, RID, "left")
    )


def _report(rows: DataFrame) -> DataFrame:
    ids = F.coalesce(F.col("item_ids"), F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long"),
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
        F.array_join(ids, ",").alias("item_ids"),
    )


#: DuckDB, for the rows of decontaminate(documents, benchmark).
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), w AS (
  SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, words, least(13, len(words)) AS k, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)
), g AS (
  SELECT rid, k, i, array_to_string(words[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM w) WHERE len(words) >= k)
), h AS (SELECT rid, i, g.k, item_id FROM g JOIN w ON g.win = w.win AND g.k = w.k),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
l AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS item_ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(item_ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, coalesce(item_ids, '') AS item_ids
FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid)
"""
