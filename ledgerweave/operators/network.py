"""Network observations against transactions, and IP intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types by rank of concern, and the families that count as evidence.
PRIORITY = "TOR_EXIT TOR_RELAY VPN PROXY DATACENTER HOSTING RESIDENTIAL MOBILE EDUCATIONAL GOVERNMENT".split()
FAMILIES = {"vpn": ("VPN",), "proxy": ("PROXY",), "tor": ("TOR_EXIT", "TOR_RELAY"), "hosting": ("HOSTING", "DATACENTER")}


def correlate(observations: DataFrame, steps: DataFrame) -> DataFrame:
    """Each observation with its transaction's step where there is one."""
    right = steps.select("txid", "time_step", F.lit(True).alias("__hit"))
    matched = F.coalesce("__hit", F.lit(False))
    return observations.join(right, "txid", "left").withColumn("matched", matched).withColumn("match_type", F.when(matched, "TXID_EXACT").otherwise("UNMATCHED")).drop("__hit")


def observation_context(matched: DataFrame) -> DataFrame:
    """Place, gap and repetition of each observation within its transaction."""
    by = Window.partitionBy("txid")
    order = by.orderBy("timestamp", "network_event_id")
    gap = F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(order)
    n, k = F.count("*").over(by), F.row_number().over(order)
    return matched.select(
        "network_event_id", "txid", k.alias("observation_sequence"), n.alias("observation_count"), (k == 1).alias("is_first_observation"), (k == n).alias("is_last_observation"),
        F.round(F.coalesce(gap, F.lit(0)) / 1e6, 3).alias("seconds_since_previous"), (n > 1).alias("is_repeated"),
    )


def temporal_statistics(matched: DataFrame) -> DataFrame:
    """One row a transaction: count, span, distinct addresses and endpoints."""
    ends = matched.groupBy("txid").agg(
        F.count("*").alias("observation_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.countDistinct("src_ip").alias("unique_src_ips"),
        F.countDistinct("dst_ip").alias("unique_dst_ips"),
        F.size(F.array_distinct(F.flatten(F.array(F.collect_set("src_ip"), F.collect_set("dst_ip"))))).alias("unique_endpoints"),
        F.countDistinct("asn").alias("unique_asns"),
        F.countDistinct("geo_country").alias("unique_countries"),
    )
    return ends.withColumn("span_seconds", (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(1e6))


def temporal_evidence(stats: DataFrame) -> DataFrame:
    """Score in [0, 1] from count, endpoints and span; levels are closed on the right."""
    n, e, s = F.col("observation_count"), F.col("unique_endpoints"), F.col("span_seconds")
    score = F.round(0.4 * (1 - F.exp(-n / 5.0)) + 0.3 * (1 - F.exp(-e / 4.0)) + 0.3 * F.least(s / 60.0, F.lit(1.0)), 6)
    level = F.when(score <= 0.25, "LOW").when(score <= 0.5, "MODERATE").when(score <= 0.75, "HIGH").otherwise("VERY_HIGH")
    return stats.withColumn("temporal_observation_evidence", score).withColumn("temporal_evidence_level", level)


def transaction_network_features(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """All transactions; those without observations get zeros and level NONE."""
    e = evidence.drop("first_seen", "last_seen")
    out = steps.join(e, "txid", "left").withColumn("network_observation_available", F.col("observation_count").isNotNull())
    numbers = [c for c in e.columns if c not in ("txid", "temporal_evidence_level")]
    return out.fillna(0, numbers).fillna("NONE", ["temporal_evidence_level"])


def best_intelligence(feed: DataFrame) -> DataFrame:
    """One feed row an address: highest confidence, then the smallest source."""
    pick = F.min_by(F.struct("network_type", "provider", "confidence", "source"), F.struct((-F.col("confidence")).alias("c"), F.col("source").alias("s")))
    return feed.groupBy("ip").agg(pick.alias("r")).select("ip", "r.*")


def feed_conflicts(feed: DataFrame) -> DataFrame:
    return feed.groupBy("ip").agg(F.countDistinct("network_type").alias("types")).filter("types > 1")


def classified_observations(observations: DataFrame, feed: DataFrame) -> DataFrame:
    """Both ends of each observation with the best feed row; a missing address is UNKNOWN.

    The reduced feed is joined twice without a hint, so it is broadcast only
    where its size is known to allow it.
    """
    best = best_intelligence(feed)
    out = observations
    for side in ("src", "dst"):
        b = best.select(*(F.col(c).alias(f"{side}_{c}") for c in best.columns))
        out = out.join(b, f"{side}_ip", "left").fillna("UNKNOWN", [f"{side}_network_type"]).fillna("", [f"{side}_provider", f"{side}_source"])
        for family, kinds in FAMILIES.items():
            out = out.withColumn(f"{side}_{family}_evidence", F.when(F.col(f"{side}_network_type").isin(*kinds), F.col(f"{side}_confidence")).otherwise(0.0))
    return out


def evidence_level(vpn: Column, proxy: Column, tor: Column, hosting: Column) -> Column:
    return (
        F.when(tor >= 0.9, "VERY_HIGH")
        .when((tor >= 0.75) | (vpn >= 0.9) | (proxy >= 0.9), "HIGH")
        .when((vpn >= 0.75) | (proxy >= 0.75) | (hosting >= 0.9), "MODERATE")
        .when(F.greatest(vpn, proxy, tor, hosting) > 0, "LOW")
        .otherwise("NONE")
    )


def transaction_intelligence(classified: DataFrame) -> DataFrame:
    """One row a transaction: evidence by family, the classification of highest concern, providers and level."""
    rank = F.array(*map(F.lit, PRIORITY))
    place = lambda c: F.nullif(F.array_position(rank, F.col(c)), F.lit(0))
    known = lambda side, c: F.when((F.col(f"{side}_network_type") != "UNKNOWN") & (F.col(c) != ""), F.col(c))
    aggs = [F.count("*").alias("network_intelligence_observation_count"), F.least(F.min(place("src_network_type")), F.min(place("dst_network_type"))).alias("__place")]
    for family, kinds in FAMILIES.items():
        aggs.append(F.greatest(F.max(f"src_{family}_evidence"), F.max(f"dst_{family}_evidence")).alias(f"{family}_evidence"))
        aggs.append(F.count_if(F.col("src_network_type").isin(*kinds) | F.col("dst_network_type").isin(*kinds)).alias(f"{family}_observation_count"))
    union = lambda c: F.size(F.array_union(F.collect_set(known("src", f"src_{c}")), F.collect_set(known("dst", f"dst_{c}"))))
    aggs += [F.coalesce(F.greatest(F.max("src_confidence"), F.max("dst_confidence")), F.lit(0.0)).alias("network_intelligence_confidence"), union("provider").alias("network_intelligence_provider_count"), union("source").alias("network_intelligence_source_count")]
    aggs += [F.countDistinct("src_ip").alias("classified_source_ip_count"), F.countDistinct("dst_ip").alias("classified_destination_ip_count")]
    out = classified.groupBy("txid").agg(*aggs)
    four = [F.col(f"{f}_evidence") for f in ("vpn", "proxy", "tor", "hosting")]
    score = F.greatest(*four)
    return (
        out.withColumn("network_intelligence_classification", F.coalesce(F.get(rank, F.col("__place").cast("int") - 1), F.lit("UNKNOWN")))
        .withColumn("network_intelligence_evidence_score", score)
        .withColumn("network_intelligence_available", score > 0)
        .withColumn("network_intelligence_evidence_level", evidence_level(*four))
        .drop("__place")
    )
