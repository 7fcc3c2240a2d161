"""Transaction, temporal, wallet and wallet-history features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_divide(n: Column, d: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(n, d)


def ratio_or_zero(n: Column, d: Column) -> Column:
    """0 where the denominator is not positive or either side is null or not finite."""
    q = F.when(d > 0, n / d)
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), 0.0).otherwise(q)


def transaction_features(tx: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Logs, imbalance, safe ratios, ranges and shares of one transaction's amounts, beside the columns to ``keep``."""
    c = F.col
    out = {
        "amount_features_missing": c("input_btc_total").isNull().cast("int"),
        "log_total_btc": F.log1p(F.greatest(c("total_btc"), F.lit(0.0))),
        "log_fee_btc": F.log1p(F.greatest(c("fee_btc"), F.lit(0.0))),
        "log_input_total": F.log1p(F.greatest(c("input_btc_total"), F.lit(0.0))),
        "log_output_total": F.log1p(F.greatest(c("output_btc_total"), F.lit(0.0))),
        "total_address_count": c("input_address_count") + c("output_address_count"),
        "address_imbalance": F.abs(c("input_address_count") - c("output_address_count")),
        "input_output_address_ratio": safe_divide(c("input_address_count"), c("output_address_count")),
        "output_input_address_ratio": safe_divide(c("output_address_count"), c("input_address_count")),
        "btc_flow_imbalance": F.abs(c("input_btc_total") - c("output_btc_total")),
        "output_input_btc_ratio": safe_divide(c("output_btc_total"), c("input_btc_total")),
        "fee_to_total_ratio": safe_divide(c("fee_btc"), c("total_btc")),
        "fee_to_input_ratio": safe_divide(c("fee_btc"), c("input_btc_total")),
        "input_btc_range": c("input_btc_max") - c("input_btc_min"),
        "output_btc_range": c("output_btc_max") - c("output_btc_min"),
        "input_max_share": safe_divide(c("input_btc_max"), c("input_btc_total")),
        "output_max_share": safe_divide(c("output_btc_max"), c("output_btc_total")),
        "input_mean_median_ratio": safe_divide(c("input_btc_mean"), c("input_btc_median")),
        "output_mean_median_ratio": safe_divide(c("output_btc_mean"), c("output_btc_median")),
        "transaction_data_missing": F.greatest(*(c(x).isNull().cast("int") for x in ("total_btc", "fee_btc", "input_address_count", "output_address_count"))),
        "input_output_value_ratio": safe_divide(c("input_btc_total"), c("output_btc_total")),
        "input_output_value_difference": c("input_btc_total") - c("output_btc_total"),
    }
    for side in ("input", "output"):
        out[f"{side}_count_log1p"] = F.log1p(F.coalesce(f"{side}_address_count", F.lit(0.0)))
        out[f"{side}_value_range_log1p"] = F.log1p(F.greatest(c(f"{side}_btc_max") - c(f"{side}_btc_min"), F.lit(0.0)))
        out[f"{side}_max_mean_ratio"] = safe_divide(c(f"{side}_btc_max"), c(f"{side}_btc_mean"))
        out[f"{side}_median_share"] = safe_divide(c(f"{side}_btc_median"), c(f"{side}_btc_total"))
    return tx.select("txid", *keep, *(v.alias(k) for k, v in out.items()))


def step_features(steps: DataFrame) -> DataFrame:
    """Activity of each step and its place in time, one row a step."""
    per_step = steps.groupBy("time_step").agg(F.count("*").alias("time_step_transaction_count"))
    whole = per_step.agg(F.avg("time_step_transaction_count").alias("m"), F.min("time_step").alias("lo"), F.max("time_step").alias("hi"))
    per_step = per_step.crossJoin(F.broadcast(whole))  # one row of totals
    n, m = F.col("time_step_transaction_count"), F.col("m")
    position = F.when(F.col("hi") > F.col("lo"), (F.col("time_step") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return per_step.select(
        "time_step",
        "time_step_transaction_count",
        F.try_divide(n, m).alias("activity_ratio"),
        (n - m).alias("activity_deviation"),
        F.log1p(n).alias("log_activity"),
        position.alias("normalized_time"),
        (position <= 0.25).cast("int").alias("is_early_period"),
        (position >= 0.75).cast("int").alias("is_late_period"),
    )


def temporal_features(steps: DataFrame) -> DataFrame:
    """:func:`step_features` of each transaction's step.

    Per-step counts are aggregated first, so what meets in one place is one row a
    step; transactions get them by a join on the step.
    """
    per_step = step_features(steps)
    return steps.join(per_step, "time_step").select("txid", *per_step.columns)


def wallet_features(tx: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Overlap of both wallet lists, beside the columns to ``keep``; the union counts list lengths, so repeats inflate it."""
    i, o = F.col("input_wallets"), F.col("output_wallets")
    overlap = F.size(F.array_intersect(i, o))
    union = F.size(i) + F.size(o) - overlap
    zero = lambda d: F.when(d > 0, overlap / d).otherwise(0.0)
    return tx.select(
        "txid",
        *keep,
        overlap.alias("wallet_overlap_count"),
        zero(F.size(i)).alias("input_overlap_ratio"),
        zero(F.size(o)).alias("output_overlap_ratio"),
        zero(union).alias("wallet_jaccard"),
        union.alias("unique_wallet_count"),
        F.log1p(union).alias("log_unique_wallet_count"),
        (overlap > 0).cast("int").alias("has_wallet_overlap"),
    )


def wallet_history(steps: DataFrame, members: DataFrame, side: str = "input") -> DataFrame:
    """What each transaction's wallets had done in strictly earlier steps.

    ``members``: txid, address, one row for each occurrence in the list.  Counts by
    wallet and step come first; a running sum over earlier steps and the step
    before are windows over that smaller table, by wallet.
    """
    used = members.join(steps, "txid")
    per_step = used.groupBy("address", "time_step").agg(F.count("*").alias("n"))
    order = Window.partitionBy("address").orderBy("time_step")
    history = per_step.select(
        "address",
        "time_step",
        F.coalesce(F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior"),
        (F.col("time_step") - F.lag("time_step").over(order)).alias("recency"),
    )
    per_tx = used.join(history, ["address", "time_step"]).groupBy("txid").agg(
        F.sum("prior").alias("s"), F.avg("prior").alias("a"), F.max("prior").alias("m"), F.count_if(F.col("prior") > 0).alias("seen"), F.count("*").alias("k"),
        F.min("recency").alias("rmin"), F.avg("recency").alias("rmean"), F.max("recency").alias("rmax"),
    )
    z = lambda c: F.coalesce(c, F.lit(0))
    return steps.select("txid").join(per_tx, "txid", "left").select(
        "txid",
        z(F.col("s")).alias(f"{side}_wallet_prior_frequency_sum"),
        z(F.col("a")).alias(f"{side}_wallet_prior_frequency_mean"),
        z(F.col("m")).alias(f"{side}_wallet_prior_frequency_max"),
        z(F.col("seen")).alias(f"{side}_wallets_seen_before"),
        z(F.col("seen") / F.col("k")).alias(f"{side}_wallet_reuse_ratio"),
        z(F.col("rmin")).alias(f"{side}_wallet_recency_min"),
        z(F.col("rmean")).alias(f"{side}_wallet_recency_mean"),
        z(F.col("rmax")).alias(f"{side}_wallet_recency_max"),
    )
