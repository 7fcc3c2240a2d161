"""Profiles of an import and scores of a case.  What a dataset lacks is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.kept import kept
from ledgerweave.operators.ordering import percentile_of_few

from ledgerweave.operators import risk


def amounts(records: DataFrame, column: str) -> DataFrame:
    """total, mean, median, min, max to eight places; all null where no row has a value."""
    c = F.col(column)
    return records.agg(
        F.round(F.sum(c), 8).alias("total"), F.round(F.avg(c), 8).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 8).alias("median"), F.round(F.min(c), 8).alias("min"), F.round(F.max(c), 8).alias("max"), F.count(c).alias("n")
    )


def percent(value: Column, total: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(value * 100, total), 2), F.lit(0.0))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, count, percentage; the total is summed over the values, not over the rows."""
    n = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return n.withColumn("percentage", percent(F.col("n"), total))


def wallet_activity(tx: DataFrame) -> DataFrame:
    """Per wallet: occurrences on both sides, and the amounts of the transactions that list it."""
    rows = tx.select(F.explode(F.array(F.struct(F.col("input_wallets").alias("w"), F.col("input_btc_total").alias("v")), F.struct(F.col("output_wallets").alias("w"), F.col("output_btc_total").alias("v")))).alias("s"))
    return rows.select(F.explode("s.w").alias("wallet"), "s.v").groupBy("wallet").agg(F.count("*").alias("activity"), F.sum("v").alias("associated_btc"))


def wallet_frequency(tx: DataFrame) -> DataFrame:
    """Transactions that list a wallet on either side."""
    return tx.select(F.explode(F.array_union("input_wallets", "output_wallets")).alias("wallet")).groupBy("wallet").agg(F.count("*").alias("transactions"))


def top_transactions(tx: DataFrame, k: int = 20) -> DataFrame:
    return tx.select("txid", "input_btc_total").orderBy(F.desc_nulls_last("input_btc_total"), "txid").limit(k)


def top_wallets(tx: DataFrame, k: int = 20) -> DataFrame:
    return wallet_activity(tx).orderBy(F.desc("activity"), "wallet").limit(k)


def dataset_summary(tx: DataFrame) -> DataFrame:
    """One row: counts, sums, conservation, availability."""
    c = F.col
    return tx.agg(
        F.count("*").alias("n_transactions"),
        F.round(F.sum("input_btc_total"), 2).alias("input_total"),
        F.round(F.sum("output_btc_total"), 2).alias("output_total"),
        F.round(F.sum("fee_btc"), 2).alias("fee_total"),
        F.round(F.sum(c("input_btc_total") - c("output_btc_total")), 2).alias("conservation_delta"),
        F.sum(F.size("input_wallets")).alias("input_wallet_rows"),
        F.sum(F.size("output_wallets")).alias("output_wallet_rows"),
        F.coalesce(F.bool_or(c("input_btc_total").isNotNull()), F.lit(False)).alias("amounts_available"),
        F.coalesce(F.bool_or(F.size("input_wallets") > 0), F.lit(False)).alias("wallets_available"),
        F.countDistinct("time_step").alias("time_steps"),
    )


def case_rows(tx: DataFrame) -> DataFrame:
    """Case-local behaviour, entity and network evidence and the fused score of each transaction.

    Wallet counts are joined to the exploded wallets of each transaction and
    rolled up again, so nothing depends on a driver-side table.
    """
    wallets = tx.select("txid", F.explode(F.array_union("input_wallets", "output_wallets")).alias("wallet"), "output_wallets")
    wallets = wallets.join(wallet_frequency(tx), "wallet")
    repeated = F.col("transactions") > 1
    rolled = wallets.groupBy("txid").agg(
        F.count_if(repeated & F.array_contains("output_wallets", F.col("wallet"))).alias("__out"), F.count_if(repeated).alias("entity_repeated_wallet_count"), F.count("*").alias("__participants"), F.coalesce(F.max(F.when(repeated, F.col("transactions"))), F.lit(0)).alias("__shared")
    )
    out = tx.join(rolled, "txid", "left").fillna(0, ["__out", "entity_repeated_wallet_count", "__participants", "__shared"])
    i, o, p = F.size("input_wallets"), F.size("output_wallets"), F.col("__participants")
    cap = lambda x: F.least(F.lit(1.0), x)
    going_on = F.when(o > 0, cap(F.col("__out") / F.greatest(F.lit(1), o))).otherwise(0.0)
    cut = F.when(F.col("input_btc_total") > 0, F.greatest(F.lit(0.0), cap((F.col("input_btc_total") - F.col("output_btc_total")) / F.col("input_btc_total"))))
    peel = F.when(going_on > 0, cap(0.6 * F.coalesce(cut, F.lit(0.0)) + 0.4 * going_on)).otherwise(0.0)
    mixes = (i > 1) | (o > 1) | (p >= 4)
    mix = F.when(mixes, cap(0.4 * cap(i / 5) + 0.4 * cap(o / 5) + 0.2 * cap(p / 10))).otherwise(0.0)
    entity = cap(0.7 * F.coalesce(F.try_divide(F.col("entity_repeated_wallet_count"), p), F.lit(0.0)) + 0.3 * cap(F.col("__shared") / 5))
    has = (i > 0) | (o > 0)
    out = out.withColumns({
        "peeling_evidence_score": peel, "mixing_evidence_score": mix, "behavioral_signal": 0.5 * peel + 0.5 * mix, "entity_signal": entity, "ml_signal": F.lit(0.0), "anomaly_signal": F.lit(0.0), "network_signal": F.lit(0.0),
        "behavioral_available": has, "entity_available": has, "ml_available": F.lit(False), "anomaly_available": F.lit(False), "network_available": F.lit(False),
    })
    out = risk.scores(out)
    parts = [F.when(F.col(f"{c}_signal") > 0, F.concat(F.lit(f"{c}="), F.format_string("%.3f", F.col(f"{c}_signal")))) for c in ("behavioral", "entity")]
    return out.withColumn("explanation", F.concat_ws(", ", *parts)).drop("__out", "__participants", "__shared")


def case_ranking(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest, numbered."""
    top = rows.orderBy(F.desc("risk_score"), F.desc("behavioral_signal"), F.col("txid").cast("string")).limit(k)
    order = Window.orderBy(F.desc("risk_score"), F.desc("behavioral_signal"), F.col("txid").cast("string"))  # k rows
    return top.withColumn("case_rank", F.row_number().over(order))


def import_profile(tx: DataFrame, addresses: DataFrame, observations: DataFrame) -> DataFrame:
    """The whole profile of an import in long form: part, name, n, percentage, amount.

    ``unique``: distinct addresses, ports, days, countries, AS numbers and wallets;
    ``day``, ``country`` and ``asn``: every value with its rows and their percentage;
    ``input``, ``output`` and ``fee``: total, mean, median, min, max and the rows that have an
    amount.  ``addresses`` are raw pairs as of ``domain.address_rows``, of the transactions in
    ``tx`` alone: only distinct wallets are counted, so no list of a transaction's is gathered.
    All values of observations are counted in one stacked pass, wallets in another, counts and
    amounts are kept, and medians come from ranges of the values next to them, so no kind meets in one task.
    """
    c = F.col
    none = F.lit(None).cast("double")
    kinds = {"src_ip": c("src_ip"), "dst_ip": c("dst_ip"), "src_port": c("src_port"), "dst_port": c("dst_port"), "day": F.date_format("timestamp", "yyyy-MM-dd"), "country": c("geo_country"), "asn": c("asn")}
    stacked = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()))).alias("e")
    counts = kept(observations.select(stacked).select("e.*").filter("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n")))
    totals = counts.groupBy("kind").agg(F.count("*").alias("values"), F.sum("n").alias("total"))
    sides = F.explode(F.array(*(F.struct(c(f"{side}_address").alias("value"), F.lit(side == "input").alias("spent")) for side in ("input", "output")))).alias("e")
    wallets = addresses.select(sides).select("e.*").filter("value is not null").groupBy("value").agg(F.bool_or("spent").alias("input"), F.bool_or(~c("spent")).alias("output"))
    wallets = wallets.agg(F.count_if("input").alias("input_wallets"), F.count_if("output").alias("output_wallets"), F.count("*").alias("wallets"))
    wallets = wallets.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c(k).alias("values")) for k in wallets.columns))).alias("e")).select("e.*").filter("values > 0")
    unique = totals.select("kind", "values").unionByName(wallets).select(F.lit("unique").alias("part"), c("kind").alias("name"), c("values").alias("n"), none.alias("percentage"), none.alias("amount"))
    shown = counts.filter(c("kind").isin("day", "country", "asn")).join(totals, "kind")
    shown = shown.select(c("kind").alias("part"), c("value").alias("name"), "n", F.round(c("n") * 100 / c("total"), 2).alias("percentage"), none.alias("amount"))
    columns = {"input": "input_btc_total", "output": "output_btc_total", "fee": "fee_btc"}
    amounts = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), c(v).alias("v")) for k, v in columns.items()))).alias("e")
    money = kept(tx.select(*columns.values())).select(amounts).select("e.*").filter("v is not null")
    figures = money.groupBy("part").agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n")).join(percentile_of_few(money, "part", "v", 0.5).withColumnRenamed("value", "median"), "part")
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c(k).alias("v")) for k in ("total", "mean", "median", "min", "max")))).alias("e")
    return unique.unionByName(shown).unionByName(figures.select("part", "n", named).select("part", "e.name", "n", none.alias("percentage"), c("e.v").alias("amount")))
