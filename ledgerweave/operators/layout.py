"""Stored layouts that later reads can prune: by step, and by address within its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_by_step(df: DataFrame, path: str) -> None:
    """A folder a step; a step that is written again replaces its own folder and no other.

    Rows of a step are spread over tasks by their hash, so a large step is several files.
    """
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition("time_step", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time_step").parquet(path)


def address_roles(steps: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """address, time_step, txid, role of every appearance of an address."""
    both = inputs.withColumn("role", F.lit("INPUT")).unionByName(outputs.withColumn("role", F.lit("OUTPUT")))
    return both.join(steps, "txid").select("address", "time_step", "txid", "role")


def address_history(roles: DataFrame) -> DataFrame:
    """Each address's appearances in order of step, transaction and role, numbered from 1, with the steps since the last."""
    order = Window.partitionBy("address").orderBy("time_step", F.col("txid").cast("string"), "role")
    return roles.select("address", F.row_number().over(order).alias("position"), "time_step", "txid", "role", (F.col("time_step") - F.lag("time_step").over(order)).alias("steps_since"))


def store_by_address(df: DataFrame, table: str, buckets: int) -> None:
    """A table in ``buckets`` by address, sorted within: the history of one address is read from one of them."""
    df.repartition(buckets, "address").sortWithinPartitions("address", "time_step").write.mode("overwrite").bucketBy(buckets, "address").sortBy("address", "time_step").saveAsTable(table)


def history_of(spark: SparkSession, table: str, address: str) -> DataFrame:
    """The stored rows of one address, from its bucket alone; an unknown address is a KeyError."""
    found = spark.table(table).filter(F.col("address") == address)
    if found.isEmpty():
        raise KeyError(address)
    return found.orderBy("time_step", F.col("txid").cast("string"), "role")
