"""Tables written once in a plan's course, where the driver and all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else (set here) a temporary folder for a local session and one in the warehouse elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-") if local else f"{warehouse}/_lexmill_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame) -> DataFrame:
    """The same rows, written and read again: a short plan from here on. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lexmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
