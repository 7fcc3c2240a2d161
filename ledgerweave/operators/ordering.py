"""Running sums, ranks and exact percentiles over a whole table without a window that sees the whole table.

Rows are range-partitioned on all keys of the order, so ties in the first key
are split by the others, and checkpointed, so that every later step sees the same
ranges.  Sums run inside a range; each range starts with the sums of those before
it, which are one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.kept import kept


def running_sums(df: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """``df`` with a column for each of ``sums``: its sum over all rows up to this one in the order (which should be total)."""
    placed = df.select("*", *(c.alias(f"__{name}") for name, c in sums.items())).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = placed.groupBy("__range").agg(*(F.sum(f"__{name}").alias(f"__t_{name}") for name in sums))
    starts = totals.select("__range", *(F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__s_{name}") for name in sums))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(starts), "__range")
    return out.select(*df.columns, *((F.col(f"__s_{name}") + F.sum(f"__{name}").over(within)).alias(name) for name in sums))


def value_counts(df: DataFrame, column: str, descending: bool = False, **sums: Column) -> DataFrame:
    """v, c, upto and total for each distinct value that is not null: rows with it, rows up to it in the order, and all rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"), *(s.alias(k) for k, s in sums.items()))
    order = F.col("v").desc() if descending else F.col("v").asc()
    out = running_sums(counts, [order], upto=F.col("c"), **{f"{k}_upto": F.col(k) for k in sums})
    return out.crossJoin(F.broadcast(out.agg(F.sum("c").alias("total"))))  # one row


def percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the exact percentile of the column, interpolated between neighbouring rows."""
    counts = value_counts(df, column)
    found = []
    for name, share in shares.items():
        place = F.col("total") * F.lit(share) - F.lit(share)
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.max(F.when((F.col("upto") - F.col("c") <= at) & (at < F.col("upto")), F.col("v"))).alias(f"{name}_{end}"))
        found.append(F.max(place - F.floor(place)).alias(f"{name}_part"))
    ends = counts.agg(*found)
    return ends.select(*((F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in shares))


def percentiles_by(df: DataFrame, by: str, column: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and for each name the exact percentile of the column within the group, interpolated, without a task that holds a group.

    Distinct values are counted by group, and one order over all groups gives each
    value's place within its own.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    rows = _placed_by(counts, by)
    return _read_off(rows.withColumn("upto", F.col("upto") - F.col("start")), by, shares)


def percentile_of_few(df: DataFrame, by: str, column: str, share: float, margin: float = 0.01) -> DataFrame:
    """``by`` and ``value``: the exact percentile of the column, interpolated, in each of few groups of a table that is cheap to read again.

    Approximate percentiles on both sides of the wanted place bound a window.  The rows below and
    in it are counted, and only the window's values are put in order; where the place turns out to lie
    elsewhere, the whole group is.
    """
    v = F.col("v")
    rows = df.select(by, F.col(column).alias("v")).filter(v.isNotNull())
    bounds = F.percentile_approx("v", [max(0.0, share - margin), min(1.0, share + margin)], 1000)
    bounds = rows.groupBy(by).agg(bounds.alias("__bounds")).select(by, F.col("__bounds")[0].alias("low"), F.col("__bounds")[1].alias("high"))
    inside = (v >= F.col("low")) & (v <= F.col("high"))
    windows = rows.join(F.broadcast(bounds), by).groupBy(by, "low", "high").agg(F.count("*").alias("total"), F.count_if(v < F.col("low")).alias("below"), F.count_if(inside).alias("inside"))  # few groups
    place = F.col("total") * F.lit(share) - F.lit(share)
    windows = windows.withColumn("whole", (F.floor(place) < F.col("below")) | (F.ceil(place) >= F.col("below") + F.col("inside"))).drop("inside")
    windows = kept(windows.withColumn("below", F.when(F.col("whole"), 0).otherwise(F.col("below"))))
    counts = rows.join(F.broadcast(windows), by).filter(F.col("whole") | inside).groupBy(by, "v").agg(F.count("*").alias("c"))
    found = _placed_by(counts, by).drop("total").join(F.broadcast(windows), by)
    return _read_off(found.withColumn("upto", F.col("upto") - F.col("start") + F.col("below")), by, {"value": share})


def _placed_by(counts: DataFrame, by: str) -> DataFrame:
    """Counts of values with ``upto`` in one order over all groups, and each group's ``start`` in it and ``total``."""
    upto = running_sums(counts, [F.col(by).asc(), F.col("v").asc()], upto=F.col("c")).checkpoint()
    ends = upto.groupBy(by).agg(F.max("upto").alias("end"), F.sum("c").alias("total")).withColumn("start", F.col("end") - F.col("total"))
    return upto.join(ends, by)


def _read_off(rows: DataFrame, by: str, shares: dict[str, float]) -> DataFrame:
    found = []
    for name, share in shares.items():
        place = F.col("total") * F.lit(share) - F.lit(share)
        for end, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.max(F.when((F.col("upto") - F.col("c") <= at) & (at < F.col("upto")), F.col("v"))).alias(f"{name}_{end}"))
        found.append(F.max(place - F.floor(place)).alias(f"{name}_part"))
    out = rows.groupBy(by).agg(*found)
    return out.select(by, *((F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n) for n in shares))
