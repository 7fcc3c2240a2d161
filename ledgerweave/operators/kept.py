"""Intermediate tables in the folder that driver and executors share, as Parquet: columns packed, sizes known to the planner."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the interpreter ends; the files then stay
        pass


def _new_folder(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


class Rounds:
    """Tables of one schema, written round by round; any of them are read by one scan, so plans do not grow with the rounds.

    The files of a round go with :meth:`drop`, all others when the driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.schema = spark, _new_folder(spark, "rounds"), None

    def add(self, name: object, df: DataFrame) -> None:
        if self.schema is None:
            self.schema = df.schema
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")

    def read(self, names: Iterable[object]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names))

    def drop(self, name: object) -> None:
        _remove(self.spark, f"{self.path}/{name}")


def kept(df: DataFrame, by: str | None = None, key: str | None = None) -> DataFrame:
    """``df`` written once and read back, which cuts its lineage; the files go when the driver's interpreter ends.

    With ``by``, a folder a value of that column, so that a read of some values
    opens their files alone; a value's rows are spread over eight tasks by ``key``.
    """
    spark = df.sparkSession
    path = _new_folder(spark, "kept")
    if by is not None:
        df = df.repartition(by, F.pmod(F.xxhash64(key), F.lit(8)))
    out = df.write.option("compression", "zstd")
    (out if by is None else out.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
