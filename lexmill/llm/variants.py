"""Spelling variants: words of a vocabulary that differ by one code point, grouped under the commonest form.

The vocabulary is a trie, and it is joined with itself by active-node sets: the nodes at distance one from a node follow
from those of its parent (the same letter below an active node, the letter left out, replaced, or one more put in), so one
walk down the trie meets all near words of every word.

The trie is partitioned by prefix. Two near words of m code points, or m and m + 1, share the first half, or else the
edit stands in it and they share the last half; so a word goes to a partition by its first half, and to one by its last
half, where the trie is that of what stands between. A partition that holds more than PARTITION code points is halved
again in the same way, around the place of the edit, until one code point is left between: then the alphabet bounds it.
No partition is ever cut, and each is joined by one task.

Texts that are null or have no letters give no words. A null doc_id counts as an empty one. Words of any length take
part; repeated rows count as often as they stand there. Ties of form go to the smallest word in code-point order. Empty
tables give no rows. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, join_counted, keep
from .merkle import CRC_SQL, crc_sql

#: Words have so many code points at least, and stand in the texts so often at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run loses a code point where this divides its hash.
EVERY = 97
#: A form is so many times as frequent as its variant, at least.
TIMES = 2
#: Code points that a partition of the trie holds at most, unless one code point is left between.
PARTITION = 32_768
#: Code points of words that a task counts before it sends counts on.
COUNTED = 4_000_000

KEYS = ["m", "a", "b", "head", "tail"]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word and n: the lower-cased runs of letters, with a code point left out where `every` divides the crc32 of
    doc_id, a colon and the run, that are long and frequent enough. Each task adds up what it reads."""
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")  # shorter runs can't become longer

    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                low = text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).decode("utf-8", "surrogatepass")
                for word, n in Counter(m.group() for m in run.finditer(low)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    before = total.get(word, 0)
                    total[word] = before + n
                    size += 0 if before else len(word)
                if size > COUNTED:
                    yield flush(total)
                    total.clear()
                    size = 0
        yield flush(total)

    found = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return found.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def partitions(words: DataFrame, least_length: int = LEAST_LENGTH, limit: int = PARTITION) -> DataFrame:
    """The words with the partitions of the trie that they belong to: m, the length of the shorter word of a pair, and
    the head of a and the tail of b code points that all words of the partition share."""
    long = F.length("word")
    m = F.explode(F.filter(F.array(long - 1, long), lambda x: x >= least_length))
    rows = words.select("word", "n", m.alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    between = F.col("m") - F.col("a") - F.col("b")
    done = None
    while True:
        half = F.expr("(m - a - b) DIV 2").cast("int")
        part = F.explode(F.array(
            F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")),
            F.struct(F.col("a").alias("a"), (F.col("b") + between - half).alias("b")),
        ))
        rows = rows.select("word", "n", "m", part.alias("x")).select("word", "n", "m", "x.a", "x.b")
        rows = keep(rows.withColumn("head", F.expr("left(word, a)")).withColumn("tail", F.expr("right(word, b)")))
        size = F.sum(F.length("word") - F.col("a") - F.col("b"))
        sizes = keep(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("together"), size.alias("size")).filter("together > 1"))
        large = (F.col("size") > limit) & (between > 1)
        met = join_counted(rows, sizes, KEYS, "together")
        small = met.filter(~large).select("word", "n", *KEYS)
        done = small if done is None else done.unionByName(small)
        if sizes.filter(large).isEmpty():
            return done
        rows = met.filter(large)


def near(words: list[str]) -> Iterator[tuple[int, int]]:
    """The places of each two of distinct words at distance one, by active-node sets over their trie."""
    below: list[dict[str, int]] = [{}]
    ends = [-1]
    for k, word in enumerate(words):
        at = 0
        for c in word:
            at_next = below[at].get(c)
            if at_next is None:
                at_next = below[at][c] = len(below)
                below.append({})
                ends.append(-1)
            at = at_next
        ends[at] = k
    waiting = [(0, set(below[0].values()))]
    while waiting:
        node, active = waiting.pop()
        if (k := ends[node]) >= 0:
            for x in active:
                if ends[x] > k:
                    yield k, ends[x]
        children = below[node]
        for c, child in children.items():
            found = {below[x][c] for x in active if c in below[x]}
            found.update(children.values())
            found.discard(child)
            found.update(below[child].values())
            found.add(node)
            waiting.append((child, found))


def pairs(words: DataFrame, least_length: int = LEAST_LENGTH, limit: int = PARTITION) -> DataFrame:
    """Each two words at distance one, once: word, n, other, other_n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        held: list[tuple[str, int]] = []
        out: list[tuple[str, int, str, int]] = []

        def close() -> None:
            if len(held) > 1:
                m, a, b = key[:3]
                for i, k in near([w[a : len(w) - b] for w, _ in held]):
                    (w, n), (x, p) = sorted((held[i], held[k]))
                    if min(len(w), len(x)) == m:  # else the pair belongs to another partition, too
                        out.append((w, n, x, p))

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n", "other", "other_n"])

        for batch in batches:
            for word, n, *now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(now) != key:
                    close()
                    held, key = [], tuple(now)
                held.append((word, n))
            if len(out) > 50_000:
                yield flush()
        close()
        yield flush()

    dealt = partitions(words, least_length, limit).repartition(*KEYS).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(run, "word string, n long, other string, other_n long").distinct()


def variants(words: DataFrame, times: int = TIMES, least_length: int = LEAST_LENGTH, limit: int = PARTITION) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word; words has word and n, and each word once."""
    words = keep(words)
    found = keep(pairs(words, least_length, limit))
    both = found.unionByName(found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"),
    )
    named = keep(named.select("word", "f.form", "n", "n_near", "f.form_n"))
    roots = last(named.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last(steps: DataFrame) -> DataFrame:
    """Each word with the last one that its steps (word, root) lead to. The ways double every round; counts double at
    every step, so a way has no circle, and a few rounds do."""
    now = keep(steps)
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = keep(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return now
        now = after.select("word", "root")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[A-Za-zÀ-ÿ]+')) AS word FROM documents)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT word, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || word")} AS h FROM runs, crc_table),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, (list(other ORDER BY other_n DESC, other))[1] AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
named AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {TIMES} * w.n THEN b.other END AS form,
    CASE WHEN b.other_n >= {TIMES} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
ways AS (
  SELECT word, word AS root, form AS further FROM named
  UNION ALL
  SELECT w.word, w.further, x.form FROM ways w JOIN named x ON x.word = w.further)
SELECT n.word, n.form, w.root, n.n, n.n_near, n.form_n FROM named n JOIN ways w ON w.word = n.word AND w.further IS NULL
"""
