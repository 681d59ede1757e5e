"""Language identification by cross-parsing entropy.

Each language has a suffix automaton over a bounded sample of its labelled texts: the beginnings, of equal length, of the
first SAMPLE_DOCS of them in the order of a hash of their ids. The LANGUAGES that most documents are labelled with take
part (ties: the smallest name), so what the driver collects and what a worker holds is bounded, whatever lang holds. A text is parsed against each
automaton into longest matches; phrases per letter, times the bits that point into the sample, estimate the cross
entropy, and the language that needs the fewest normalised phrases wins (ties: the smallest name).

Texts are folded first: lower case, runs of anything that is no letter become one blank. A letter that the sample of a
language lacks ends a phrase and is a phrase of its own. Texts are parsed whole. To parse many letters in one step, a
text is cut into segments that are parsed side by side as if each began a phrase; where a phrase goes on over a cut, both
ways are followed until they meet, and the difference in phrases is settled. A text whose ways don't meet within a
segment is parsed letter by letter. So the count is that of one parse from the first letter to the last.

Every Python worker builds the automata from the broadcast samples once, each over the alphabet of its own sample: as a
table of states and letters up to DENSE numbers (16 MB) and its share of DENSE_IN_ALL, else as a sorted list of its
transitions, which a sample of SAMPLE_CHARS characters bounds.

Null texts and texts without a letter are `und` with score 0, and so is everything where no row is labelled. Rows with
null lang teach nothing but are predicted. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the automaton of one language is fitted on at most: so many documents, and so many characters of them, in equal
#: shares; and so many languages.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 32_768
LANGUAGES = 64
#: Letters of a segment, and letters of texts that are laid side by side.
SEGMENT = 512
SLICE_CHARS = 1_500_000
#: Numbers of a table of transitions at most, and of all tables together.
DENSE, DENSE_IN_ALL = 4 << 20, 32 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, languages: int = LANGUAGES, n: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text of each language, within the bounds above; the driver collects nothing that isn't used."""
    learned = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    common = learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    order = W.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = (
        learned.filter(F.col("text").isNotNull())
        .select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, max(1, chars // n)).alias("text"))
        .join(F.broadcast(common.select("lang")), "lang")  # languages rows at most
        .withColumn("k", F.row_number().over(order))
        .filter(F.col("k") <= n)
        .select("lang", "k", "text")
        .collect()
    )
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(texts)[:chars] for lang, texts in found.items()}


@functools.cache
def _fold_table() -> np.ndarray:
    """Lower-cased code point of each letter, 32 for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def fold(text: str) -> np.ndarray:
    """Folded code points, without blanks at the ends."""
    codes = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([True], blank[:-1])))] if codes.size else codes
    return codes[:-1] if codes.size and codes[-1] == 32 else codes


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton that accepts the substrings of a sequence; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for s in symbols:
        now = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = now
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return moves


class Automaton:
    """What a text is parsed with: from a state, a letter leads to the state after it, and to whether a phrase began.

    State 0 is the place between phrases: every letter begins one there. Elsewhere, a letter that the match can't go on
    with begins one, too, and a letter that the sample lacks leads back to state 0.
    """

    def __init__(self, folded: np.ndarray, dense: int | None = None):
        self.letters = np.unique(folded)
        moves = suffix_automaton((np.searchsorted(self.letters, folded) + 1).tolist())
        #: One symbol for each letter of the sample, and 0 for all others.
        self.width = self.letters.size + 1
        self.bits = math.log2(max(2, folded.size))
        self.begin = np.zeros(self.width, np.int32)
        for s, to in moves[0].items():
            self.begin[s] = to
        self.table = self.keys = None
        if len(moves) * self.width <= (DENSE if dense is None else dense):
            # Where a phrase begins, the next state stands as its complement, and so below zero.
            self.table = np.tile(~self.begin, (len(moves), 1))
            for k, row in enumerate(moves[1:], 1):
                for s, to in row.items():
                    self.table[k, s] = to
            self.table = self.table.ravel()
        else:
            pairs = sorted((k * self.width + s, to) for k, row in enumerate(moves[1:], 1) for s, to in row.items())
            self.keys = np.array([k for k, _ in pairs], np.int64)
            self.to = np.array([to for _, to in pairs], np.int32)

    def symbols(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, letters), self.letters.size - 1)
        return np.where(self.letters[at] == letters, at + 1, 0).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and -1 where a phrase began, else 0."""
        if self.table is not None:
            to = self.table[state * np.int32(self.width) + symbol]
            began = to >> 31
            return to ^ began, began
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        went = self.keys[at] == key
        return np.where(went, self.to[at], self.begin[symbol]), went.astype(np.int32) - 1

    def count(self, symbols: np.ndarray) -> int:
        """Phrases of one text, letter by letter."""
        state, n, width, begin = 0, 0, self.width, self.begin.tolist()
        for s in symbols.tolist():
            if self.table is not None:
                to = int(self.table[state * width + s])
            else:
                key = state * width + s
                at = int(np.searchsorted(self.keys, key))
                to = int(self.to[at]) if at < self.keys.size and self.keys[at] == key else ~begin[s]
            if to < 0:
                n += 1
                to = ~to
            state = to
        return n


class Model:
    """The automata of all languages."""

    def __init__(self, texts: dict[str, str]):
        folded = {n: fold(texts[n]) for n in sorted(texts)}
        self.names = [n for n, f in folded.items() if f.size]
        self.automata = [Automaton(folded[n], min(DENSE, DENSE_IN_ALL // len(self.names))) for n in self.names]

    def phrases(self, texts: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
        """Phrases of each folded text (row) against each language (column)."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        parts = [(k, a, t[a : a + segment]) for k, t in enumerate(texts) for a in range(0, len(t), segment)]
        if not parts:
            return out
        parts.sort(key=lambda p: -len(p[2]))
        place = {(k, a): i for i, (k, a, _) in enumerate(parts)}
        owner = np.array([k for k, _, _ in parts])
        lengths = np.array([len(p) for _, _, p in parts])
        # The segment before each one, and those that have one.
        before = np.array([place.get((k, a - segment), -1) for k, a, _ in parts])
        cut = np.flatnonzero(before >= 0)
        letters, flat = np.unique(np.concatenate([p for _, _, p in parts]), return_inverse=True)
        grid = np.zeros((segment, len(parts)), np.int32)
        ends = np.cumsum(lengths)
        for i, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist())):
            grid[:n, i] = flat[end - n : end]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # segments longer than each step
        for lang, found in enumerate(self.automata):
            symbol = found.symbols(letters)
            state = np.zeros(len(parts), np.int32)
            count = np.zeros(len(parts), np.int64)
            for step in range(lengths[0]):
                n = active[step]
                state[:n], began = found.step(state[:n], symbol[grid[step, :n]])
                count[:n] -= began
            # What a segment would have given had it gone on from the state before it.
            real, as_if = state[before[cut]], np.zeros(cut.size, np.int32)
            apart = np.flatnonzero(real != as_if)
            for step in range(lengths[0]):
                apart = apart[lengths[cut[apart]] > step]
                if not apart.size:
                    break
                at = cut[apart]
                s = symbol[grid[step, at]]
                real[apart], one = found.step(real[apart], s)
                as_if[apart], other = found.step(as_if[apart], s)
                count[at] += other - one
                apart = apart[real[apart] != as_if[apart]]
            out[:, lang] = np.bincount(owner, count, len(texts)).astype(np.int64)
            # Where the two ways never met, the next segment began from another state than it was taken to.
            for k in np.unique(owner[cut[real != as_if]]).tolist():
                out[k, lang] = found.count(found.symbols(texts[k]))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        folded = [fold(t) if t else np.zeros(0, np.uint32) for t in texts]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        sizes = np.array([f.size for f in folded])
        rates = self.phrases(folded) * np.array([a.bits for a in self.automata]) / np.maximum(1, sizes)[:, None]
        best = rates.argmin(1)
        odds = np.exp2(-4 * (rates - rates.min(1, keepdims=True)))
        scores = 1 / odds.sum(1)
        return (
            [self.names[b] if s else "und" for b, s in zip(best, sizes, strict=True)],
            [float(x) if s else 0.0 for x, s in zip(scores, sizes, strict=True)],
        )


@functools.lru_cache(maxsize=1)
def _model(texts: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(texts))


def identify(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score; texts are the samples, taken from docs itself unless given."""
    given = docs.sparkSession.sparkContext.broadcast(tuple(sorted((sample(docs) if texts is None else texts).items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(given.value)
        for batch in batches:
            names, scores, part, size = [], [], [], 0
            for t in [*batch.column(2).to_pylist(), ...]:
                if part and (t is ... or size + len(t or "") > SLICE_CHARS):
                    got = model.predict(part)
                    names += got[0]
                    scores += got[1]
                    part, size = [], 0
                if t is not ...:
                    part.append(t)
                    size += len(t or "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
