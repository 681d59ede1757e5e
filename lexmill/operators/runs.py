"""Runs over units that break off and go on: a graph of stages, each of which works in batches and commits each batch once.

A batch is the cases whose key falls into it by digest, so it is the same set however often a run begins. What a stage
makes of a batch is one table of the run's snapshots, `stage.batch`, committed with whatever the batch before left: a run
that is killed at any moment leaves whole batches only, and the next run does those that are missing. The snapshots are
the ledger; no unit is done twice or lost. A stream's micro-batches are committed under their ids in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import planning
from lexmill.operators.reporting import stage_summary
from lexmill.sources import snapshots

BATCHES = 16
#: Exit codes: everything done; errors or an outer failure; wrong input.
DONE, FAILED, WRONG_INPUT = 0, 1, 2


class InputError(ValueError):
    """Cases, settings or stages that can't be right."""


@dataclass(frozen=True)
class Stage:
    """A stage, those it needs, the schema of its records (keys and error among them), and its work: the cases of a batch,
    and the good records of each stage it needs, to records."""

    name: str
    needs: tuple[str, ...]
    schema: str
    work: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


class Run:
    def __init__(self, spark: SparkSession, folder: str, cases: DataFrame, keys: Sequence[str], stages: Sequence[Stage], batches: int = BATCHES):
        self.spark, self.folder, self.cases, self.keys, self.batches = spark, folder, cases, list(keys), batches
        self.stages = {s.name: s for s in stages}
        for s in stages:
            for need in s.needs:
                if need not in self.stages or list(self.stages).index(need) >= list(self.stages).index(s.name):
                    raise InputError(f"stage {s.name} needs {need}, which doesn't come before it")

    def records(self, name: str) -> DataFrame:
        """All records of a stage so far."""
        found = snapshots.pinned(self.spark, self.folder)
        out = self.spark.createDataFrame([], self._stage(name).schema)
        for table in found.tables:
            if table.rpartition(".")[0] == name:
                out = out.unionByName(found.read(self.spark, table))
        return out

    def _stage(self, name: str) -> Stage:
        if name not in self.stages:
            raise InputError(f"no stage {name}; there are {', '.join(self.stages)}")
        return self.stages[name]

    def _ready(self, name: str) -> DataFrame:
        """The cases whose record of every needed stage is good."""
        ready = self.cases
        for need in self._stage(name).needs:
            ready = ready.join(self.records(need).filter("error IS NULL").select(*self.keys).distinct(), self.keys, "left_semi")
        return ready

    def do(self, name: str, retry_failed: bool = False) -> DataFrame:
        """Does the batches of a stage that the ledger doesn't have, and returns the stage's summary. A case without a good
        record upstream waits: its batch is done again when it has one. Failed cases are done again only if asked."""
        stage = self._stage(name)
        good = {need: self.records(need).filter("error IS NULL") for need in stage.needs}
        columns = self.spark.createDataFrame([], stage.schema).columns
        number = F.pmod(F.xxhash64(*self.keys), F.lit(self.batches))
        for k in range(self.batches):
            base = snapshots.pinned(self.spark, self.folder)
            table = f"{name}.{k}"
            todo = self._ready(name).filter(number == k)
            known = base.read(self.spark, table) if table in base.tables else None
            if known is not None:
                kept = known.filter("error IS NULL") if retry_failed else known
                todo = todo.join(kept.select(*self.keys), self.keys, "left_anti")
            if todo.isEmpty():
                continue
            made = stage.work(todo, good).select(*columns)
            rows = made if known is None else kept.unionByName(made)
            snapshots.commit(self.spark, self.folder, {table: rows}, base=base)
        return self.summary(name)

    def summary(self, name: str) -> DataFrame:
        return stage_summary(self.cases, self.records(name), self.keys, self._ready(name).select(*self.keys)).select(F.lit(name).alias("stage"), "*")

    def status(self) -> DataFrame:
        """A row per stage."""
        rows = [self.summary(name) for name in self.stages]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out


def exit_code(work: Callable[[], DataFrame | None]) -> tuple[int, str]:
    """What a command ends with, and what it says: rows of summaries with errors fail it, and so does what it raises."""
    try:
        found = work()
        rows = [] if found is None else [r.asDict() for r in found.collect()]
        return (FAILED if any(r.get("errors") for r in rows) else DONE), "\n".join(str(r) for r in rows)
    except (InputError, ValueError, FileNotFoundError) as e:
        return WRONG_INPUT, f"{type(e).__name__}: {e}"
    except Exception as e:  # noqa: BLE001  whatever a stage may raise stops it, without its content
        return FAILED, type(e).__name__


def recover(spark: SparkSession, folder: str, raw: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress (unit_key, made, tokens, status) with the units that have raw rows and none: their rows are there, so they
    count as done, with what they cost unknown. Committed as the run's table `progress`, and returned."""
    lost = planning.recoverable(raw, progress).select("unit_key", "made", F.lit(None).cast("long").alias("tokens"), F.lit("done").alias("status"))
    every = progress.select("unit_key", "made", "tokens", "status").unionByName(lost)
    return snapshots.commit(spark, folder, {"progress": every}).read(spark, "progress")


def run_stream(stream: DataFrame, folder: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], name: str = "raw") -> DataFrame:
    """Runs a stream of units over what is there; each micro-batch is committed once under its id, also where it comes
    again because the one before was killed between its commit and the checkpoint's. Returns all rows."""
    spark = stream.sparkSession

    def commit(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        base = snapshots.pinned(session, folder)
        if f"{name}.{batch_id}" not in base.tables:
            snapshots.commit(session, folder, {f"{name}.{batch_id}": work(batch)}, base=base)

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = snapshots.pinned(spark, folder)
    tables = [found.read(spark, t) for t in sorted(found.tables) if t.rpartition(".")[0] == name]
    if not tables:
        raise FileNotFoundError(f"no batch of {name} in {folder}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
