"""Tables in the folder that driver and executors share, and numbers for rows that need one."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Low bits of Spark's increasing ids, which count the rows of a partition.
ROW_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/core-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables of kept() that this application wrote, once no result reads them any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as it is now: written to the shared folder and read again, so that lost executors and second uses change nothing."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, order: Sequence[str] = (), first: int = 0) -> DataFrame:
    """df with numbers from `first` on: in the total order of some columns, of any types, or without them in the order of its partitions.

    Partitions number their own rows; the rows of those before are added. No task sees all rows, and equal first values,
    or all equal ones, are no matter. A column of that name is replaced.
    """
    rows = df.drop(name)
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = kept(rows.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    at = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + first
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, at).drop("_part", "_place", "_before")
