"""Bounded signals, fusion into a score, bands, ranked alerts and their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.kept import kept
from ledgerweave.operators.ordering import percentiles, percentiles_by, running_sums, value_counts

# Channel weights, agreement bonus by number of channels, bands.
WEIGHTS = {"ml": 0.15, "anomaly": 0.20, "behavioral": 0.30, "entity": 0.20, "network": 0.15}
BONUS = (0.00, 0.00, 0.02, 0.04, 0.06, 0.08)
BANDS = ((80.0, "VERY_HIGH"), (60.0, "HIGH"), (40.0, "MODERATE"), (20.0, "GUARDED"))
TOP_ALERTS = 1000


def clamp01(c: Column) -> Column:
    """NaN and null become 0; the rest is cut to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))))


def bounded_unit_interval(c: Column) -> Column:
    """As :func:`clamp01`, but infinite values become 0."""
    return F.when(F.abs(c) == float("inf"), 0.0).otherwise(clamp01(c))


def percentile_signal(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds ``<column>_signal``: scaled between two exact quantiles of the whole column and cut to [0, 1].

    Where both quantiles agree, all rows get 1 if the quantile is positive and 0
    otherwise.  One aggregation serves all columns and gives one row.
    """
    cuts = df.agg(*(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(c) for c in columns))
    cuts = cuts.select(*(F.get(c, F.lit(i)).alias(f"__{c}_{i}") for c in columns for i in (0, 1)))
    out = df.crossJoin(F.broadcast(cuts))  # one row
    for c in columns:
        a, b = F.col(f"__{c}_0"), F.col(f"__{c}_1")
        out = out.withColumn(f"{c}_signal", F.when(b > a, clamp01((F.col(c) - a) / (b - a))).otherwise(F.when(b > 0, 1.0).otherwise(0.0)))
    return out.drop(*cuts.columns)


def entity_signal(sides: DataFrame, components: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """txid, the columns to ``keep``, the components and their mean, each component the mean of its input and output side.

    The first component is the repeated ratio, which is a share; the others are
    counts, scaled by :func:`percentile_signal` (they have few distinct values).
    """
    scaled = percentile_signal(sides, [f"{side}_{c}" for c in components.values() for side in ("input", "output")])
    both = {"entity_repeated_signal": (bounded_unit_interval(F.col("input_repeated_ratio")) + bounded_unit_interval(F.col("output_repeated_ratio"))) / 2}
    both |= {f"entity_{name}_signal": (F.col(f"input_{c}_signal") + F.col(f"output_{c}_signal")) / 2 for name, c in components.items()}
    mean = sum((both[k] for k in list(both)[1:]), next(iter(both.values()))) / len(both)
    seen = F.col("input_repeated_addresses") + F.col("output_repeated_addresses") > 0
    return scaled.select("txid", *keep, *(c.alias(k) for k, c in both.items()), clamp01(mean).alias("entity_signal"), seen.alias("entity_available"))


def average_percent_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank over n with average ties.  Ranks are made on the distinct values' counts and joined back."""
    ranks = value_counts(df, column).select(F.col("v").alias(column), ((F.col("upto") - F.col("c") + (F.col("c") + 1) / 2) / F.col("total")).alias(name))
    return df.join(kept(ranks), column)  # its size is known, so few values are broadcast and not dealt by value


def band(score: Column) -> Column:
    out = F.lit("LOW")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def status(priority: Column) -> Column:
    return F.when(priority.isin("VERY_HIGH", "HIGH", "MODERATE"), "ACTIVE").when(priority == "GUARDED", "WATCH").otherwise("INFORMATIONAL")


def scores(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """From ``<channel>_signal`` and ``<channel>_available``: channel count, bonus, risk_score in [0, 100] and band."""
    weights = weights or WEIGHTS
    weighted = sum((F.col(f"{c}_signal") * w for c, w in weights.items()), F.lit(0.0))
    channels = sum((F.coalesce(F.col(f"{c}_available"), F.lit(False)).cast("int") for c in weights), F.lit(0))
    out = df.withColumn("effective_evidence_channel_count", channels).withColumn("weighted_evidence_score", weighted)
    bonus = F.get(F.array(*map(F.lit, BONUS)), F.col("effective_evidence_channel_count"))
    out = out.withColumn("evidence_agreement_bonus", bonus)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.col("weighted_evidence_score") * (1 + F.col("evidence_agreement_bonus")) * 100, 6)))
    return out.withColumn("risk_score", score).withColumn("risk_level", band(F.col("risk_score")))


def explanation(df: DataFrame) -> DataFrame:
    """A sentence for each channel by its strength, and how many agree.  Scores are priorities, not proof."""
    strength = lambda s: F.when(s >= 0.7, "strong").when(s >= 0.4, "moderate").when(s > 0, "weak")
    parts = [F.concat(strength(F.col(f"{c}_signal")), F.lit(f" {c} evidence (") , F.format_string("%.3f", F.col(f"{c}_signal")), F.lit(")")) for c in WEIGHTS]
    n = F.col("effective_evidence_channel_count")
    agree = F.when(n >= 4, "broad agreement").when(n >= 2, "partial agreement").otherwise("little agreement")
    text = F.concat_ws("; ", *parts, agree, F.lit("a priority for review, not proof"))
    return df.withColumn("explanation", text)


def ranked_alerts(df: DataFrame, top: int = TOP_ALERTS) -> DataFrame:
    """Total order over eight keys, as contiguous ranks, ranks among active alerts, and the top queue.

    Rows are range-partitioned on all keys (:func:`ordering.running_sums`), so
    neither a range nor a tied score meets whole in one task by size of the table.
    """
    down = ["risk_score", "effective_evidence_channel_count", "behavioral_signal", "entity_signal", "anomaly_signal", "network_signal"]
    keys = [F.col(c).desc() for c in down] + [F.col("time_step").asc(), F.col("txid").cast("string").asc()]
    out = df.withColumn("alert_priority", band(F.col("risk_score")))
    out = out.withColumn("alert_status", status(F.col("alert_priority")))
    active = F.col("alert_status") == "ACTIVE"
    out = running_sums(out, keys, investigation_rank=F.lit(1).cast("long"), active_alert_rank=active.cast("long"))
    out = out.withColumn("active_alert_rank", F.when(active, F.col("active_alert_rank")))
    return out.withColumn("top_alert_queue", F.coalesce(F.col("active_alert_rank") <= top, F.lit(False)))


def page(alerts: DataFrame, number: int, size: int) -> DataFrame:
    """A page of the stored order: a range of ranks, so no sort and no offset."""
    return alerts.filter(F.col("investigation_rank").between((number - 1) * size + 1, number * size))


def filtered(alerts: DataFrame, priority: str | None = None, alert_status: str | None = None, time_step: int | None = None, min_risk: float | None = None, max_risk: float | None = None) -> DataFrame:
    """Conjunction of the conditions given; names compare without case."""
    if min_risk is not None and max_risk is not None and min_risk > max_risk:
        raise ValueError("min_risk is above max_risk")
    if priority is not None:
        alerts = alerts.filter(F.upper("alert_priority") == priority.upper())
    if alert_status is not None:
        alerts = alerts.filter(F.upper("alert_status") == alert_status.upper())
    if time_step is not None:
        alerts = alerts.filter(F.col("time_step") == time_step)
    if min_risk is not None:
        alerts = alerts.filter(F.col("risk_score") >= min_risk)
    if max_risk is not None:
        alerts = alerts.filter(F.col("risk_score") <= max_risk)
    return alerts


def top_risk(alerts: DataFrame, k: int) -> DataFrame:
    return alerts.orderBy(F.desc_nulls_last("risk_score"), "investigation_rank").limit(k)


def summary(alerts: DataFrame) -> DataFrame:
    """Global figures in one row."""
    r = F.col("risk_score")
    median = percentiles(alerts, "risk_score", {"m": 0.5}).select(F.round("m", 4).alias("median_risk"))
    figures = alerts.agg(
        F.count("*").alias("n"), F.round(F.avg(r), 4).alias("mean_risk"), F.round(F.min(r), 4).alias("min_risk"), F.round(F.max(r), 4).alias("max_risk"),
        *(F.count_if(F.col("alert_priority") == p).alias(f"n_{p.lower()}") for p in ("VERY_HIGH", "HIGH", "MODERATE", "GUARDED", "LOW")),
        *(F.round(F.avg(f"{c}_signal"), 4).alias(f"mean_{c}") for c in WEIGHTS),
        F.round(F.avg(F.when(F.col("top_alert_queue"), r)), 4).alias("top_queue_mean"),
    )
    return figures.crossJoin(median)  # one row each


def by_step(alerts: DataFrame, first: int = 1, last: int = 49) -> DataFrame:
    """Every step of a range, also those without alerts."""
    r = F.col("risk_score")
    per = alerts.filter(F.col("time_step").between(first, last)).groupBy("time_step").agg(
        F.count("*").alias("n"), F.round(F.avg(r), 4).alias("mean_risk"),
        F.count_if(F.col("alert_priority") == "HIGH").alias("n_high"), F.count_if(F.col("alert_status") == "ACTIVE").alias("n_active"), F.count_if("top_alert_queue").alias("n_top"),
    )
    median = percentiles_by(alerts.filter(F.col("time_step").between(first, last)), "time_step", "risk_score", {"m": 0.5})
    per = per.join(median.select("time_step", F.round("m", 4).alias("median_risk")), "time_step")
    spine = alerts.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("time_step"))
    return spine.join(per, "time_step", "left").fillna(0)


def concentration(df: DataFrame, column: str) -> DataFrame:
    """Mean and sum over the top 0.1, 1 and 5 per cent of rows (rounded up), by value counts."""
    cum = value_counts(df, column, descending=True)
    parts = []
    for name, share in (("top_0_1", 0.001), ("top_1", 0.01), ("top_5", 0.05)):
        k = F.ceil(F.round(F.col("total") * share, 9))
        take = F.greatest(F.lit(0), F.least("c", k - (F.col("upto") - F.col("c"))))
        parts += [F.round(F.sum(take * F.col("v")), 4).alias(f"{name}_sum"), F.round(F.sum(take * F.col("v")) / F.sum(take), 4).alias(f"{name}_mean")]
    return cum.agg(*parts)
