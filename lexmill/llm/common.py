"""What the operators of this subpackage share: row ids, tables kept in the shared folder, byte tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the internal row id; columns of the caller never reach the operators under a name like it.
RID = "__lexmill_rid"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to a-z, and every ASCII byte that is no digit or letter to a blank.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: bytes.translate table: A-Z to a-z.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Java pattern of what stands between words of letters, digits and non-ASCII characters.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Java pattern of the white space between plain words, and the same characters for trim().
SPACE_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def alnum_words(text: Column) -> Column:
    """Array of the lower-cased words of letters, digits and non-ASCII characters; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Array of the words between ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_GAP), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else one set here.

    Where the setting is missing, a local session gets a temporary folder and a cluster one inside the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-") if local else f"{warehouse}/_lexmill_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage and survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """The same rows, kept on the executors' disks once they are computed. Lineage stays: what an executor takes with it
    is computed again. For large tables that one job reads several times."""
    return df.persist(StorageLevel.DISK_ONLY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from_files(df: DataFrame) -> bool:
    """Whether the rows come from files, through nothing but projections and filters."""
    node = df._jdf.queryExecution().sparkPlan()
    while node.nodeName() in ("Project", "Filter") and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName().startswith("Scan ") and not node.nodeName().startswith("Scan ExistingRDD")


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns with a row id in front, which stays what it is however often the rows are read.

    The id of a row of files follows from the files' splits. These hang on the number of cores at the time, so the least
    number of splits is set for the session where it is not: executors that come or go change nothing then. Rows that come
    from anything else than files, which could be dealt otherwise the next time, are written first.
    """
    spark, least = docs.sparkSession, "spark.sql.files.minPartitionNum"
    if not spark.conf.get(least, None):
        spark.conf.set(least, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))
    rows = docs.select(F.monotonically_increasing_id().alias(RID), *columns)
    return rows if _from_files(docs) else keep(rows)


def labelled(labels: DataFrame, name: str, held_out: Callable[[Column], Column]) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and the label `name`, 0 or 1, of each labelled row that isn't held out, and how many rows have each label.
    A doc_id counts once, and not at all if it has both labels."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias(name))
        .filter(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(name).alias(name), F.max(name).alias("other")).filter(F.col(name) == F.col("other")).drop("other")
    )
    marked = keep(marked)
    return marked, {r[name]: r["n"] for r in marked.groupBy(name).agg(F.count(F.lit(1)).alias("n")).collect()}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A key is hot where it holds more than one in so many rows; no more than so many keys can be.
HOT = 1000


def join_counted(rows: DataFrame, sides: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows joined with sides, where each key has one row on the side, whose column n says how many of the rows have it.

    Rows of a hot key would meet in one task. The hot keys are at most HOT in number whatever the input, so their sides
    are broadcast and their rows stay where they are; all others shuffle. Both tables are read several times: keep() them.
    """
    total = sides.agg(F.sum(n)).first()[0] or 0
    many = F.col(n) * HOT > F.lit(total)
    hot = sides.filter(many)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(sides.filter(~many), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)
