"""The transaction-network domain as views over a star schema of orders, line items and events.

An order is a transaction, its parts are input addresses and its suppliers output
addresses; an event is a network observation.  Each function reads only the
columns it needs, so pruning reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_DAYS, FIRST_DAY = 50, "1995-01-01"

# The types an IP address can have.
NETWORK_TYPES = "VPN PROXY TOR_EXIT TOR_RELAY HOSTING DATACENTER RESIDENTIAL MOBILE EDUCATIONAL GOVERNMENT UNKNOWN".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txid, time_step: the thin table that most temporal operators join."""
    days = F.datediff(F.to_date("o_orderdate"), F.lit(FIRST_DAY).cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txid"), (F.floor(days / STEP_DAYS) + 1).cast("int").alias("time_step"))


def address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txid, input_address, output_address: raw pairs, repeats and self-loops included."""
    address = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txid"), address("l_partkey").alias("input_address"), address("l_suppkey").alias("output_address"))


def tx_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_rows(spark, sf_dir).select("txid", F.col("input_address").alias("address")).distinct()


def tx_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_rows(spark, sf_dir).select("txid", F.col("output_address").alias("address")).distinct()


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 19-column transaction table and its label; orders without line items have null figures and empty lists.

    One aggregation of line items and one join by transaction.
    """
    li = table(spark, sf_dir, "lineitem")
    paid, due = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    figures = []
    for side, value in (("input", paid), ("output", due)):
        figures += [
            F.min(value).alias(f"{side}_btc_min"),
            F.max(value).alias(f"{side}_btc_max"),
            F.avg(value).alias(f"{side}_btc_mean"),
            F.percentile(value, F.lit(0.5)).alias(f"{side}_btc_median"),
            F.sum(value).alias(f"{side}_btc_total"),
        ]
    wallets = lambda c: F.sort_array(F.collect_set(F.concat(F.lit("W"), F.col(c).cast("string"))))
    per_tx = li.groupBy(F.col("l_orderkey").alias("txid")).agg(
        F.sum(paid * F.col("l_tax")).alias("fee_btc"), *figures, wallets("l_partkey").alias("input_wallets"), wallets("l_suppkey").alias("output_wallets")
    )
    orders = table(spark, sf_dir, "orders")
    days = F.datediff(F.to_date("o_orderdate"), F.lit(FIRST_DAY).cast("date"))
    tx = orders.select(
        F.col("o_orderkey").alias("txid"),
        (F.floor(days / STEP_DAYS) + 1).cast("int").alias("time_step"),
        F.col("o_totalprice").alias("total_btc"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("label"),
    )
    joined = tx.join(per_tx, "txid", "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumn("has_address_relationships", F.col("input_wallets").isNotNull())
    for side in ("input", "output"):
        joined = joined.withColumn(f"{side}_address_count", F.when(F.col(f"{side}_wallets").isNotNull(), F.size(f"{side}_wallets")).cast("double"))
        joined = joined.withColumn(f"{side}_wallets", F.coalesce(f"{side}_wallets", none))
    return joined


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network observations: two addresses, ports, country and AS number, derived from the event's user."""
    e = table(spark, sf_dir, "events")
    ip = lambda k: F.format_string("10.%d.%d.%d", F.lit(k), (F.col("user_id") % 65536 / 256).cast("int"), (F.col("user_id") % 256).cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("network_event_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        ip(0).alias("src_ip"),
        F.format_string("10.1.0.%d", (F.col("event_id") % 200).cast("int")).alias("dst_ip"),
        F.lit(8333).alias("src_port"),
        F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("dst_port"),
        (F.floor(F.col("event_id") / 3) * 6).alias("txid"),
        F.format_string("C%d", (F.col("user_id") % 25).cast("int")).alias("geo_country"),
        (F.col("user_id") % 97).alias("asn"),
        F.col("event_type").alias("observation_source"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IP intelligence: one or two rows for an address, with a type, a provider and a confidence."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    kinds = F.array(*map(F.lit, NETWORK_TYPES))
    row = users.select("user_id", F.explode(F.when(F.col("user_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    return row.select(
        F.format_string("10.0.%d.%d", (F.col("user_id") % 65536 / 256).cast("int"), (F.col("user_id") % 256).cast("int")).alias("ip"),
        F.element_at(kinds, ((F.col("user_id") + 3 * F.col("k")) % 11 + 1).cast("int")).alias("network_type"),
        F.format_string("P%d", (F.col("user_id") % 7).cast("int")).alias("provider"),
        ((F.col("user_id") + 31 * F.col("k")) % 100 / 100).alias("confidence"),
        F.format_string("F%d", F.col("k")).alias("source"),
    )
