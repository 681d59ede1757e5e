"""Reading of the named tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt out to all cores where it is too small to be read in that many splits: a file of one row
    group is one task otherwise. Larger tables keep the splits of their scan and are not shuffled."""
    path, cores = f"{sf_dir}/{name}.parquet", spark.sparkContext.defaultParallelism
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    df = spark.read.parquet(path).select(*columns)
    return df.repartition(cores) if size < cores * (16 << 20) else df
