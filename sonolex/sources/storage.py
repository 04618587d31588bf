"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Without it only one machine can do: then its temporary folder is shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] == "local":
        root = "file:///tmp/sonolex-shared"
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with ``name``: 0, 1, 2 and so on in the order of columns that no two rows share. Rows are dealt by ranges and stored; a range's first
    number comes from the sizes of those before it, so no task sees all rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("__part", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND((1 << 33) - 1)), scratch_path(spark, "numbered"))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    bases = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    return rows.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")
