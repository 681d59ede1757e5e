"""Quality of texts by gradient-boosted trees over document statistics.

Every whole text is measured once (STATISTICS), and the measures, a few numbers a document, are written. Trees of one
depth are grown level by level on histograms of binned statistics with the gradients of the logistic loss, over a sample
of labelled rows whose size is bounded: SAMPLE_ROWS of each label, in the order of a hash of their ids, weighted back to
the true shares. All trees lie in three flat arrays (statistic, cut and value, in heap order), so rows go down all trees
at once, in numpy, a level a step.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. A doc_id that labels hold several times
counts once; one with both labels teaches nothing; of several texts with one doc_id the one of smallest measures teaches.
Where rows of only one label are left, every score is next to that label; where none are, 0.5.

Null and empty texts have measures of zero and are scored like any other. Texts are measured whole, however long. Rows
are scored alone: ties and repeated rows change nothing. An empty table gives no rows, and columns besides doc_id and
text don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, labelled

SAMPLE_ROWS = 4_000
TREES, DEPTH, RATE = 60, 4, 0.2
#: Bins of a statistic, the pull of values to zero, and the least sum of second derivatives in a node.
BINS, RIDGE, LEAST = 64, 1.0, 1e-3
CUT = 0.5

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digits", "stops", "symbols", "wide", "blank",
    "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "line_words", "lines_with_end", "symbol_words",
    "letterless_words", "upper_words", "entropy",
)

_KIND = np.zeros(256, np.int64)  # 0: control and white space
for _b in range(33, 256):
    _c = chr(_b)
    _KIND[_b] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in ".,;:!?'\"()-" else 6 if _b > 127 else 5
_SYMBOLS = b"#*$%&|<>@^~_=+\\/{}[]`"
_UPPER = bytes(range(65, 91))
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def measures(text: str | None) -> list[float]:
    """The STATISTICS of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 7)
    n, size = len(words), len(raw)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[6])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    often = Counter(words)
    share = counts[counts > 0] / size
    return [
        math.log1p(size),
        math.log1p(n),
        (size - kinds[0]) / n,
        float(max(map(len, often))),
        kinds[2] / letters,
        kinds[3] / size,
        kinds[4] / size,
        kinds[5] / size,
        kinds[6] / size,
        kinds[0] / size,
        len(often) / n,
        max(often.values()) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        sum(k for w, k in often.items() if w[-1] in _SYMBOLS) / n,
        sum(k for w, k in often.items() if not w.translate(None, _NO_LETTERS)) / n,
        sum(k for w, k in often.items() if w[0] in _UPPER and w.isupper()) / n,
        float(-(share * np.log2(share)).sum()),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the measures, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


class Trees:
    """Trees of one depth in heap order: the children of node k are 2 k + 1, taken up to the cut, and 2 k + 2."""

    def __init__(self, base: float, statistic: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.statistic, self.cut, self.value = base, statistic, cut, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of measures."""
        n_trees, inner = self.statistic.shape
        tree, row = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), n_trees), np.int64)
        while n_trees and at.size and at[0, 0] < inner:
            at = 2 * at + 1 + (x[row, self.statistic[tree, at]] > self.cut[tree, at])
        margin = np.full(len(x), self.base) + self.value[tree, at - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Trees that lower the weighted logistic loss of labels y, one after another."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j]) for j in range(width)], 1)
    base = math.log((weight @ y) / (weight @ (1 - y)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    statistic, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    rows = np.arange(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            m = 2**level
            best, chosen, bound = np.full(m, 1e-9), np.zeros(m, np.int64), np.full(m, BINS)
            for j in range(width):
                place = node * BINS + binned[:, j]
                g = np.bincount(place, slope, m * BINS).reshape(m, BINS).cumsum(1)
                h = np.bincount(place, bend, m * BINS).reshape(m, BINS).cumsum(1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                gain[(h < LEAST) | (h_all - h < LEAST)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(m), k]
                better = top > best
                best[better], chosen[better], bound[better] = top[better], j, k[better]
            split = bound < BINS
            at = np.flatnonzero(split)
            statistic[t, m - 1 + at] = chosen[at]
            cut[t, m - 1 + at] = [edges[chosen[k]][min(bound[k], len(edges[chosen[k]]) - 1)] for k in at]
            node = 2 * node + (binned[rows, chosen[node]] > bound[node])
        g, h = np.bincount(node, slope, inner + 1), np.bincount(node, bend, inner + 1)
        value[t] = -rate * g / (h + RIDGE)
        margin += value[t, node]
    return Trees(base, statistic, cut, value)


def learn(found: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """The trees for a corpus of which found has the measures; labels has doc_id and quality."""
    marked, n = labelled(labels, "quality", held_out)
    flat = np.zeros((0, 2**DEPTH - 1))
    if len(n) < 2:
        return Trees(math.inf * (1 if 1 in n else -1) if n else 0.0, flat.astype(np.int64), flat, flat)
    picked = [marked.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for label in (0, 1)]
    got = (
        found.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # 2 * rows rows of two numbers at most
        .groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
        .orderBy("doc_id").toPandas()
    )
    y = got["quality"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Trees(math.inf * (1 if y.any() else -1) if len(y) else 0.0, flat.astype(np.int64), flat, flat)
    share = np.array([n[0] / (y == 0).sum(), n[1] / (y == 1).sum()])
    weight = share[y.astype(int)]
    return grow(np.stack(got["x"].to_list()), y, weight * len(y) / weight.sum())


def score(found: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted per row of measures."""
    given = found.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            x = rows.flatten().to_numpy().reshape(len(rows), len(STATISTICS))
            yield pa.array(np.concatenate([given.value.scores(x[a : a + 2048]) for a in range(0, len(x), 2048)] or [np.zeros(0)]), pa.float64())

    scored = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), run("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The scores of all documents, under trees learned from the labelled ones among them."""
    found = keep(measured(docs))
    return score(found, learn(found, labels))
