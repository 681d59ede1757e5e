"""The order of a turn: guard, answer cache, single flight, retrieval cache, relevance gate, generation.

Turns of one question (key) are told by their times. The first one leads: it holds the key's lock until it ends, LOCK
seconds at most, and a leader that takes longer counts as broken off. Whoever comes meanwhile follows: it waits for the
leader's end, WAIT seconds at most, and then runs alone. If the leader leaves an answer that may be kept, its followers
get it at that moment, and all who come within ANSWERS seconds get it at once. If it leaves none, the first who still
waits takes over at that moment, and the others wait for it; so who leads next hangs on how the last flight ended.

Of two turns of one key, the later one's fate follows from three numbers of the flight before it: when it ended, whether
it left an answer, and from when on a turn leads (the first that comes not earlier). So a key is one pass over its rows in
order with a state of a few numbers, in batch and on streams alike. The rows of a key are dealt by idle stretches too:
whoever comes after one always leads.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexmill.operators import verification
from lexmill.operators.fusion import LOW_RELEVANCE

LOCK, WAIT, ANSWERS, RETRIEVALS = 60, 45, 86_400, 3_600


class Limits(NamedTuple):
    """Seconds that a lock, a follower, a kept answer and kept chunks last."""

    lock: int = LOCK
    wait: int = WAIT
    answers: int = ANSWERS
    retrievals: int = RETRIEVALS


class Flight(NamedTuple):
    """What a key's last flight leaves: when it ended, whether with an answer, from when on a turn leads, and until when
    its chunks are kept."""

    ended: int
    good: bool
    leads: int
    kept: int


class Fate(NamedTuple):
    """role (leader, follower, alone), cache (answer_hit, retrieval_hit, miss), outcome, and the second it is decided."""

    role: str
    cache: str
    outcome: str
    at: int


def decide(flight: Flight | None, at: int, took: int, failed: bool, relevant: bool, keeps: bool, limits: Limits) -> tuple[Fate, Flight]:
    """The fate of the next turn of a key, and the flight that those after it meet. took: seconds of its generation;
    failed: whether its retrieval fails; relevant: whether its chunks pass the gate; keeps: whether its answer may be kept."""
    kept = flight.kept if flight else -1
    follows = flight is not None and at < flight.leads
    if follows and flight.good and at + limits.wait >= flight.ended:
        return Fate("follower", "answer_hit", "answered", max(at, flight.ended)), flight
    start = at + limits.wait if follows else max(at, flight.ended) if flight else at
    found = start < kept
    outcome = "answered" if found else "retrieval_error" if failed else "answered" if relevant else "no_context"
    fate = Fate("alone" if follows else "leader", "retrieval_hit" if found else "miss", outcome, start)
    if outcome == "answered" and not found:
        kept = start + limits.retrievals  # an empty list, or one that the gate stops, is never kept
    if follows:  # what runs alone holds no lock and leaves no answer
        return fate, flight._replace(kept=kept)
    runs = took if outcome == "answered" else 0
    good = outcome == "answered" and keeps and runs <= limits.lock
    ended = start + min(runs, limits.lock)
    return fate, Flight(ended, good, ended + limits.answers if good else ended - limits.wait, kept)


def stand_alone(verdict: Column, query: Column, failed: Column, n_chunks: Column, best: Column) -> Column:
    """Where an answer without cache and flight stops: refused, retrieval_error, no_context, or generate."""
    stopped = F.when(verification.scope(verdict, query) != "allow", "refused").when(failed, "retrieval_error")
    return stopped.when(~relevant(F.coalesce(n_chunks, F.lit(0)), best), "no_context").otherwise("generate")


INPUT = ("asked", "took", "failed", "relevant", "keeps")
FATES = "role string, cache string, outcome string, decided long"


def relevant(n_chunks: Column, best: Column, threshold: float = LOW_RELEVANCE) -> Column:
    """Whether chunks pass the gate: there are some, and the best known score isn't below the threshold."""
    return (n_chunks > 0) & ~F.coalesce(best < threshold, F.lit(False))


def guarded(turns: DataFrame, verdict: Column, query: Column) -> tuple[DataFrame, DataFrame]:
    """The turns that the guard lets in, and those that it refuses."""
    seen = turns.withColumn("verdict", verification.scope(verdict, query))
    return seen.filter("verdict = 'allow'"), seen.filter("verdict <> 'allow'")


def fates(turns: DataFrame, key: str, turn: str, limits: Limits = Limits()) -> DataFrame:
    """(key, turn, role, cache, outcome, decided) of each turn; turns: key, turn, and the columns of INPUT, asked in whole
    seconds. Ties in time go by turn. A null key is a key. A task goes through its rows in order and holds one flight."""
    kinds = dict(turns.dtypes)
    quiet = limits.lock + limits.wait + max(limits.answers, limits.retrievals)
    ordered = W.partitionBy(key).orderBy("asked", turn)
    new = F.coalesce((F.col("asked") - F.lag("asked").over(ordered) > quiet).cast("int"), F.lit(1))
    rows = turns.select(key, turn, *INPUT).withColumn("__stretch", F.sum(new).over(ordered.rowsBetween(W.unboundedPreceding, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: object = ()
        flight: Flight | None = None
        for pdf in batches:
            out = []
            for k, stretch, *row in zip(pdf["__k"], pdf["__stretch"], *(pdf[c] for c in INPUT)):
                if (k, stretch) != held:
                    held, flight = (k, stretch), None
                fate, flight = decide(flight, *row, limits)
                out.append(fate)
            found = pd.DataFrame(out, columns=["role", "cache", "outcome", "decided"])
            yield pd.concat([pdf[[key, turn]].reset_index(drop=True), found], axis=1)

    # Keys are compared by a text that tells null from all others.
    marked = rows.withColumn("__k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    return marked.repartition("__k", "__stretch").sortWithinPartitions("__k", "__stretch", "asked", turn).mapInPandas(
        run, f"{key} {kinds[key]}, {turn} {kinds[turn]}, {FATES}"
    )


class _Turns(StatefulProcessor):
    """A key's last flight as state. A timer drops it when the watermark has passed the last moment at which it counts."""

    def __init__(self, key: str, turn: str, limits: Limits):
        self.key, self.turn, self.limits = key, turn, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flight = handle.getValueState("flight", "ended long, good boolean, leads long, kept long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flight = Flight(*self.flight.get()) if self.flight.exists() else None
        out = []
        pdf = pd.concat([p[[self.turn, *INPUT]] for p in rows]).sort_values(["asked", self.turn], kind="stable")
        for turn, *row in pdf.itertuples(index=False):
            fate, flight = decide(flight, *row, self.limits)
            out.append((key[0], turn, *fate))
        self.flight.update(tuple(flight))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(1000 * (max(flight.ended, flight.leads, flight.kept) + 1))
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        # Objects: strings that Arrow holds in chunks are not taken here.
        return pd.DataFrame(rows, columns=[self.key, self.turn, "role", "cache", "outcome", "decided"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.flight.clear()
        yield self._frame([])

    def close(self) -> None:
        pass


def stream_fates(turns: DataFrame, key: str, turn: str, ts: str, delay: str = "1 minute", limits: Limits = Limits()) -> DataFrame:
    """fates() on a stream; ts is the time of the column asked. Rows later than the delay are dropped. Turns of a key that
    come in one micro-batch are put in order, so a source should be read in small ones (maxFilesPerTrigger). Needs the
    RocksDB state store."""
    kinds = dict(turns.dtypes)
    schema = f"{key} {kinds[key]}, {turn} {kinds[turn]}, {FATES}"
    return turns.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(_Turns(key, turn, limits), schema, "Append", "EventTime")
