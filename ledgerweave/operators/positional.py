"""Putting tables side by side by the place of their rows, with the checks that make it safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, path: str, *keys: str) -> None:
    """Files whose names, and whose rows within, follow the keys: ranges of them, sorted."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``ordinal``, each row's place from 0: its place in its file, and the rows of the files before by name.

    The same files give the same numbers, however a scan splits them.
    """
    df = spark.read.parquet(path)
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = placed.groupBy("__file").agg(F.count("*").alias("__n")).select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    return placed.join(offsets, "__file").select(*df.columns, (F.col("__offset") + F.col("__row")).alias("ordinal"))


def side_by_side(blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """The numbered blocks as one table by ordinal; ``key`` is in every block and must agree in every row.

    Blocks of other lengths, keys that disagree, repeated keys and columns that two
    blocks have are a ValueError that says where and how many.
    """
    columns = [c for b in blocks.values() for c in b.columns if c not in (key, "ordinal")]
    twice = sorted({c for c in columns if columns.count(c) > 1})
    if twice:
        raise ValueError(f"columns in more than one block: {', '.join(twice)}")
    sizes = {name: b.count() for name, b in blocks.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"blocks of unequal length: {sizes}")
    keyed = [b.withColumnRenamed(key, f"__key_{i}") for i, b in enumerate(blocks.values())]
    whole = reduce(lambda a, b: a.join(b, "ordinal", "full"), keyed)
    apart = {name: F.count_if(~F.col("__key_0").eqNullSafe(F.col(f"__key_{i}"))).alias(name) for i, name in enumerate(blocks)}
    checked = whole.agg(*apart.values(), (F.count("*") - F.countDistinct("__key_0")).alias("__repeated")).first()
    bad = {name: checked[name] for name in blocks if checked[name]}
    if bad:
        raise ValueError(f"rows whose {key} is not the first block's: {bad}")
    if checked["__repeated"]:
        raise ValueError(f"{checked['__repeated']} rows repeat a {key} or have none")
    return whole.select("ordinal", F.col("__key_0").alias(key), *columns)
