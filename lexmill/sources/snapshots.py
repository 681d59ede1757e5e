"""Snapshots of several tables: readers see all tables of one commit, or all of the one before, never a mix.

A folder holds data/<table>/<id>, written once and never changed, and manifests/<number>.json, each of which names the
data of every table. A commit writes its data first and then one manifest, under the next number, by a rename that fails
where that number is taken: so of two writers on the same base one wins and the other is told (Conflict). Tables that a
commit doesn't name are carried over. A writer that breaks off leaves data that no manifest names, and nothing else.
A reader pins the newest manifest once and reads the data it names, however many commits follow. Old manifests expire;
their data, and what broken writers left, goes after a time of grace.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
#: Manifests that stay, and seconds that data without a manifest is left for readers and writers who still need it.
KEEP, GRACE_S = 3, 86_400


class Conflict(RuntimeError):
    """Another writer has committed on the same base."""


@dataclass(frozen=True)
class Snapshot:
    """A pinned commit: its number, the data of each table, and what the writer noted."""

    folder: str
    number: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        if table not in self.tables:
            raise FileNotFoundError(f"no table {table} in snapshot {self.number} of {self.folder}")
        return spark.read.schema(self.schemas[table]).parquet(f"{self.folder}/{self.tables[table]}")


def _fs(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, folder)
    if not fs.exists(path(f"{folder}/manifests")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{folder}/manifests"))]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())


def _read_text(spark: SparkSession, file: str) -> str:
    fs, path = _fs(spark, file)
    stream = fs.open(path(file))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def pinned(spark: SparkSession, folder: str, number: int | None = None) -> Snapshot:
    """The newest snapshot, or that of a number; number 0 and no table where nothing was ever committed."""
    folder = folder.rstrip("/")
    numbers = _numbers(spark, folder)
    if number is None and not numbers:
        return Snapshot(folder)
    if number is not None and number not in numbers:
        raise FileNotFoundError(f"no snapshot {number} in {folder}")
    wanted = numbers[-1] if number is None else number
    found = json.loads(_read_text(spark, f"{folder}/manifests/{wanted:012d}.json"))
    if found["format"] != FORMAT:
        raise ValueError(f"snapshot format {found['format']}, expected {FORMAT}")
    return Snapshot(folder, wanted, found["tables"], found["schemas"], found["notes"])


def _publish(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """Puts a manifest under its number in one step, if the number is free."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, path = _fs(spark, folder)
    draft = path(f"{folder}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over another one
    target = path(f"{folder}/manifests/{number:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
    except Exception as e:  # the gateway wraps what Hadoop throws
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"snapshot {number} of {folder} is another writer's") from e
        raise


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], notes: dict | None = None, base: Snapshot | None = None) -> Snapshot:
    """Writes the tables and makes them, and those of the base that aren't written, the next snapshot. base: the snapshot
    that the writer has read, the newest unless it is given; a commit on another one than the newest is a Conflict."""
    folder = folder.rstrip("/")
    base = pinned(spark, folder) if base is None else base
    placed, schemas = dict(base.tables), dict(base.schemas)
    for name, df in tables.items():
        placed[name] = f"data/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{folder}/{placed[name]}")
        schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    found = {"format": FORMAT, "tables": placed, "schemas": schemas, "notes": {**base.notes, **(notes or {})}, "at": int(time.time())}
    _publish(spark, folder, base.number + 1, json.dumps(found, sort_keys=True))
    return Snapshot(folder, base.number + 1, placed, schemas, found["notes"])


def expire(spark: SparkSession, folder: str, keep: int = KEEP, grace_s: int = GRACE_S) -> list[str]:
    """Drops all but the newest manifests, then the data that no manifest names and that is older than the grace; returns
    what data it dropped. Manifests go first, so one that is left always names data that is there."""
    folder = folder.rstrip("/")
    fs, path = _fs(spark, folder)
    numbers = _numbers(spark, folder)
    for number in numbers[: max(0, len(numbers) - max(1, keep))]:
        fs.delete(path(f"{folder}/manifests/{number:012d}.json"), False)
    named = {place for number in _numbers(spark, folder) for place in pinned(spark, folder, number).tables.values()}
    gone = []
    if fs.exists(path(f"{folder}/data")):
        for table in fs.listStatus(path(f"{folder}/data")):
            for version in fs.listStatus(table.getPath()):
                place = f"data/{table.getPath().getName()}/{version.getPath().getName()}"
                if place not in named and version.getModificationTime() / 1000 <= time.time() - grace_s:
                    fs.delete(version.getPath(), True)
                    gone.append(place)
    return sorted(gone)


def state(spark: SparkSession, folder: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """One row a table of the newest snapshot, or that is wanted: name, number, rows, and whether it is ready (there, and
    not empty)."""
    found = pinned(spark, folder)
    rows = None
    for name in sorted({*found.tables, *wanted}):
        n = found.read(spark, name).agg(F.count(F.lit(1)).alias("n_rows")) if name in found.tables else spark.range(1).select(F.lit(None).cast("long").alias("n_rows"))
        one = n.select(F.lit(name).alias("name"), F.lit(found.number).alias("number"), "n_rows", (F.coalesce("n_rows", F.lit(0)) > 0).alias("ready"))
        rows = one if rows is None else rows.unionByName(one)
    return spark.createDataFrame([], "name string, number int, n_rows long, ready boolean") if rows is None else rows
