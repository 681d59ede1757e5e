"""Toxicity by noisy-channel deobfuscation.

A word that carries signs between letters, runs of one letter, or letters set apart stands in a lattice: each written
character may be one of several letters (leetspeak), a run may be one or two letters, separators vanish. Letters and
signs set apart may be several words, so their lattice has blanks, too. Viterbi decodes the lattice, however long, under
a character trigram model whose counts come from every text of the corpus, and a linear model scores the restored words.
A word whose only sign of disguise is a doubled letter counts as written and as restored.

The linear model is logistic with an L1 penalty over hashed words and word beginnings, fitted on a bounded sample of
labelled rows: of each label, in the order of a hash of their ids, the first SAMPLE_ROWS, and of these as many as have
SAMPLE_FEATURES features in all, each with all it has, as when it is scored; weighted back to the true shares. Labels are
learned only from rows whose crc32(doc_id as text) mod 5 is not 0. A doc_id that labels hold several times counts once;
one with both labels teaches nothing; of several texts with one doc_id the smallest teaches.

Null and empty texts get the score of a text without evidence. Without a single toxic and a single clean labelled row
nothing is learned, and every score is 0. Rows are scored alone: ties and repeated rows change nothing.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, labelled

SAMPLE_ROWS, SAMPLE_FEATURES = 4_000, 6_000_000
BUCKETS = 1 << 18
PENALTY, ROUNDS = 2e-4, 150
#: The least score of a text that counts as toxic.
CUT = 0.5
#: Words whose features a worker remembers at most.
MEMO = 200_000

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "*": "aeiou", "¡": "i",
}
#: Log probabilities of the channel: a letter as itself, a sign for a letter, a run of letters for one or two.
AS_IS, AS_SIGN, AS_RUN = 0.0, -1.0, -0.7
#: The alphabet of the character model: 0 is the edge of a word, 1 any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøùúûüýßœ'"
SYMBOLS = 64

#: Blanks and stops around a word; signs of LEET stay.
_STOPS = ".,;:?\"'()[]{}!-_«»“”…"
_ONE = r"(?:[^\W_]|[@$!|+€£(<¡]|(?<=\s)\*(?=\s))"
_GAP = r"(?:[\s.\-_/]|(?<!\s)\*|\*(?!\s))+"
#: Three or more letters, digits or signs, each alone; a star between blanks is a sign, else it sets apart.
_APART = re.compile(rf"(?<![^\W_])(?:{_ONE}{_GAP}){{2,}}{_ONE}(?![^\W_])")
#: What every such run has within it.
_LONE = re.compile(r"[\s.\-_/*]\S[\s.\-_/*]+\S(?![^\W_])")
_SPLIT = re.compile(rf"({_GAP})")
_SIGN = re.compile(r"[0-9@$!|+€£(<*¡]")
_INNER = re.compile(r"(?<=[^\W_])[.\-_*/](?=[^\W_])")
_RUN = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_SAME = re.compile(r"(.)\1+", re.S)
#: What every word has that is decoded.
_MARKED = re.compile(r"[0-9@$!|+€£(<*¡]|(.)\1|(?<=[^\W_])[.\-_*/](?=[^\W_])")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@functools.cache
def _symbol_table() -> np.ndarray:
    out = np.ones(0x110000, np.int32)
    for k, c in enumerate(LETTERS):
        out[ord(c)] = k + 2
        if len(c.upper()) == 1:
            out[ord(c.upper())] = k + 2
    for c in " \t\n\r\x0b\x0c" + _STOPS.replace("'", ""):
        out[ord(c)] = 0
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts. Each task counts into a table of fixed size, so what is shuffled
    and collected is bounded by the alphabet: SYMBOLS to the third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        table = _symbol_table()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes = table[np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), "<u4")]
                grams, n = np.unique((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], return_counts=True)
                total[grams] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = (
        docs.filter(F.col("text").isNotNull())
        .select("text")
        .mapInArrow(run, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


class CharModel:
    """Interpolated trigram log probabilities."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        one = c.sum((0, 1)) + 0.5
        two = c.sum(0)
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (c + 5 * p2[None]) / (c.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)
        #: The same by (a * SYMBOLS + b) * SYMBOLS + c, and the symbols of characters other than 1.
        self.flat = self.log.ravel().tolist()
        table = _symbol_table()
        self.known = {chr(k): int(table[k]) for k in np.flatnonzero(table != 1)}
        #: What written words may be, as far as this process has met them.
        self.memo: dict[str, tuple[str, ...]] = {}


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the strings it may stand for, with the channel's log probability."""
    out = []
    for m in re.finditer(r"(.)\1*", word):
        c, n = m.group(1), len(m.group())
        letters = [(x, AS_SIGN) for x in LEET.get(c, "")] if c in LEET else [(c, AS_IS)]
        if n == 1:
            out.append(letters)
        else:
            out.append([(x * k, p + AS_RUN * (k != n)) for x, p in letters for k in (1, 2)])
    return out


def spaced(choices: list[list[tuple[str, float]]]) -> list[list[tuple[str, float]]]:
    """The lattice with a blank that may stand before each run but the first, and between two letters of one run."""
    out = []
    for k, found in enumerate(choices):
        more = found + [(f"{x[0]} {x[0]}", p) for x, p in found if len(x) == 2]
        out.append(more + [(" " + x, p) for x, p in more] if k else more)
    return out


def runs_only(word: str, model: CharModel) -> str:
    """What viterbi gives for a word whose lattice has a choice at runs only: after a run's letter and the one behind it
    all paths stand at the same place, so the best path is the better way through each run by itself."""
    known, log = model.known, model.flat
    out, at = [], 0
    for m in _SAME.finditer(word):
        a, b = m.span()
        before = known.get(word[a - 1], 1) if a else 0
        c, after = known.get(word[a], 1), known.get(word[b], 1) if b < len(word) else 0
        once = AS_RUN + log[(before * SYMBOLS + c) * SYMBOLS + after]
        twice = AS_RUN * (b - a != 2) + log[(before * SYMBOLS + c) * SYMBOLS + c] + log[(c * SYMBOLS + c) * SYMBOLS + after]
        out.append(word[at : a + 1 + (twice > once)])
        at = b
    return "".join(out) + word[at:]


def viterbi(word: str, model: CharModel, blanks: bool = False) -> str:
    """The likeliest letters behind a written word, with blanks where it is several words."""
    if not blanks and not _SIGN.search(word):
        return runs_only(word, model)
    known, log = model.known, model.flat
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    written = lattice(word)
    for choices in spaced(written) if blanks else written:
        coded = [(letters, channel, [known.get(c, 1) for c in letters]) for letters, channel in choices]
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, before) in best.items():
            for letters, channel, codes in coded:
                s, x, y = score + channel, a, b
                for z in codes:
                    s += log[(x * SYMBOLS + y) * SYMBOLS + z]
                    x, y = y, z
                if (x, y) not in now or s > now[x, y][0]:
                    now[x, y] = (s, (before, letters))
        best = now
    _, at = max(((score + log[(a * SYMBOLS + b) * SYMBOLS], path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])
    out = []
    while at is not None:
        at, letters = at
        out.append(letters)
    return "".join(reversed(out))


def disguised(word: str) -> bool:
    """Whether more than a doubled letter speaks for a disguise."""
    return bool(_SIGN.search(word) or _RUN.search(word) or _INNER.search(word))


def restore(word: str, model: CharModel) -> str | None:
    """The restored word if the written one looks disguised, else None."""
    if not _MARKED.search(word) or not (disguised(word) or _DOUBLE.search(word)):
        return None
    bare = _INNER.sub("", word)
    if not _LETTER.search(bare):
        return None
    return viterbi(bare, model)


def set_apart(written: str, model: CharModel) -> set[str]:
    """The words that characters set apart may be: all as one, as the lattice splits them, and between wider gaps."""
    parts = _SPLIT.split(written)
    chars, gaps = parts[::2], parts[1::2]
    joined = "".join(chars)
    # A word of one letter may stand before or after the letters set apart.
    out = {viterbi(x, model) for x in (joined, joined[1:], joined[:-1])}
    out.update(viterbi(joined, model, blanks=True).split())
    least = min(map(len, gaps))
    if any(len(g) > least for g in gaps):
        wide = "".join(c + " " * (len(g) > least) for c, g in zip(chars, [*gaps, ""])).split()
        out.update(viterbi(x, model) for x in wide if len(x) > 1)
    return out


def features(word: str) -> list[int]:
    """Buckets of a restored word: the word and its beginnings of four and five letters."""
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in (4, 5):
        if len(word) >= n:
            out.append(zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


def restored_words(text: str | None, model: CharModel, memo: dict[str, tuple[str, ...]]) -> set[str]:
    """The distinct words of a text, restored where they are disguised; memo maps written words to what they may be."""
    low = (text or "").lower()
    out = set()
    if _LONE.search(low):
        for m in _APART.finditer(low):
            out |= set_apart(m.group(), model)
    for written in set(low.split()):
        words = memo.get(written)
        if words is None:
            bare = written.strip(_STOPS)
            inner = written.strip(_STOPS.replace("!", "").replace("(", ""))
            word = restore(inner, model) if bare else ""
            words = (bare,) if word is None else (word,) if disguised(inner) or word == bare else (word, bare)
            if len(memo) >= MEMO:
                memo.clear()
            memo[written] = words
        out.update(words)
    out.discard("")
    return out


def fit(rows: list[tuple[np.ndarray, int]], shares: tuple[int, int]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with L1 penalty, by accelerated proximal gradient; shares: how many clean
    and toxic rows there are in all."""
    y = np.array([label for _, label in rows], np.float64)
    per_class = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], np.float64)
    share = np.array(shares, np.float64) / sum(shares)
    weight = (share / per_class)[y.astype(int)]
    sizes = np.array([len(f) for f, _ in rows])
    flat = np.concatenate([f for f, _ in rows]) if sizes.sum() else np.zeros(0, np.int64)
    used, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    w, b = np.zeros(used.size), float(np.log(share[1] / share[0]))
    ahead, t = w.copy(), 1.0
    # Few words tell, so a bound on the curvature from the commonest features would make for tiny steps.
    scale = np.maximum(np.bincount(flat, weight[owner], used.size) * 0.25, 1e-5)
    step = 1 / np.maximum(scale * 25, 1e-3)
    for _ in range(ROUNDS):
        z = b + np.bincount(owner, ahead[flat], len(rows))
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        new = ahead - step * np.bincount(flat, slope[owner], used.size)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b -= slope.sum() / max(0.25 * (weight * 1).sum(), 1e-9)
        faster = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / faster * (new - w)
        w, t = new, faster
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w
    return out, b


@functools.lru_cache(maxsize=1)
def _char_model(counts: bytes) -> CharModel:
    return CharModel(np.frombuffer(counts, np.int64))


class Scorer:
    """The scores of words under weights, as far as this process has met them."""

    def __init__(self, counts: bytes, weights: bytes | None, bias: float):
        self.chars, self.bias, self.known = _char_model(counts), bias, {}
        self.weights = None if weights is None else np.frombuffer(weights, np.float32)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        found = []
        for w in restored_words(text, self.chars, self.chars.memo):
            x = self.known.get(w)
            if x is None:
                if len(self.known) >= MEMO:
                    self.known.clear()
                x = self.known[w] = float(sum(self.weights[k] for k in features(w)))
            if x:
                found.append(x)
        z = math.fsum([self.bias, *found])  # exact, so the order of a set doesn't matter
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


@functools.lru_cache(maxsize=1)
def _scorer(counts: bytes, weights: bytes | None, bias: float) -> Scorer:
    return Scorer(counts, weights, bias)


class Model:
    """What scoring needs, of fixed size: trigram counts, weights of BUCKETS features, a bias."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None, bias: float):
        self.counts, self.weights, self.bias = counts.tobytes(), weights, bias


def sample(docs: DataFrame, labels: DataFrame, given, rows: int = SAMPLE_ROWS, features_in_all: int = SAMPLE_FEATURES) -> tuple[list[tuple[np.ndarray, int]], dict[int, int]]:
    """Features and label of each row that teaches, in the order of doc_id, and how many rows have each label; given:
    the broadcast counts of trigrams. A row is taken whole or not at all; the first of a label is always taken."""
    marked, n = labelled(labels, "toxic", held_out)
    if len(n) < 2:
        return [], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _char_model(given.value)
        for batch in batches:
            found = [sorted(b for w in restored_words(t, model, model.memo) for b in features(w)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "found"])

    picked = [marked.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for label in (0, 1)]
    found = keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # 2 * rows rows of two numbers at most
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .mapInArrow(run, "doc_id long, toxic int, found array<int>")
    )
    # Sizes only, of 2 * rows rows at most; the rows that go over the bound are never collected.
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = found.select("doc_id", "toxic", F.size("found").cast("long").alias("size"))
    wanted = sizes.withColumn("sum", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order))
    wanted = wanted.filter((F.col("sum") <= features_in_all) | (F.col("k") == 1)).select("doc_id")
    got = found.join(F.broadcast(wanted), "doc_id", "left_semi").toArrow()
    taught = []
    for batch in got.to_batches():
        # Slices of one array per batch: no Python number per feature.
        column = batch.column("found")
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        parts = np.split(column.flatten().to_numpy(), ends[1:-1]) if len(column) else []
        taught += zip(batch.column("doc_id").to_pylist(), parts, batch.column("toxic").to_pylist(), strict=True)
    return [(part, label) for _, part, label in sorted(taught, key=lambda r: r[0])], n


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a corpus and its labels; labels has doc_id and toxic."""
    counts = trigram_counts(docs)
    rows, n = sample(docs, labels, docs.sparkSession.sparkContext.broadcast(counts.tobytes()))
    if len({label for _, label in rows}) < 2:
        return Model(counts, None, 0.0)
    weights, bias = fit(rows, (n[0], n[1]))
    return Model(counts, weights, bias)


def scores(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text, as a column."""
    weights = None if model.weights is None else model.weights.tobytes()
    given = spark.sparkContext.broadcast((model.counts, weights, model.bias))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(*given.value)
        for texts in batches:
            yield pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())

    return run(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted per document."""
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        scores(F.col("text"), model, docs.sparkSession).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
