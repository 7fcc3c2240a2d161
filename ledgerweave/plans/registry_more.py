"""Queries of normalisers, validation, temporal graph state, enriched risk and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.functions import normalize as n
from ledgerweave.operators import behavior, features, ml, network, risk, temporal_graph, validate
from ledgerweave.operators.kept import kept
from ledgerweave.operators.ordering import percentiles
from ledgerweave.plans.registry import INTEL, query, rounded
from ledgerweave.plans.registry_risk import RISK, gates, given_channels

RAW = """rawtext AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey || '.0' WHEN 1 THEN ' ' || o_orderkey || ' ' WHEN 2 THEN 'tx' || o_orderkey WHEN 3 THEN '' ELSE NULL END AS txid,
  CASE o_orderkey % 4 WHEN 0 THEN '["W1", " W2 "]' WHEN 1 THEN 'W1|W' || o_custkey || '|' WHEN 2 THEN 'W1;W2' ELSE 'W9' END AS wallets,
  CASE o_orderkey % 4 WHEN 0 THEN '8333' WHEN 1 THEN '70000' WHEN 2 THEN '80.5' ELSE 'x' END AS port, CASE o_orderkey % 3 WHEN 0 THEN 'AS' || o_custkey WHEN 1 THEN o_custkey::VARCHAR ELSE 'ASx' END AS asn,
  CASE o_orderkey % 3 WHEN 0 THEN '10.0.' || (o_custkey % 300) || '.7' WHEN 1 THEN 'not-an-ip' ELSE '192.0.2.1' END AS ip, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0.5' WHEN 2 THEN '1.5' ELSE 'x' END AS confidence, ' in ' AS country FROM orders)"""


def raw(spark, sf) -> DataFrame:
    """Untidy text fields made from orders, to exercise the normalisers at any size."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = k.cast("string")
    return d.table(spark, sf, "orders").select(
        k.alias("k"),
        F.when(k % 5 == 0, F.concat(text, F.lit(".0"))).when(k % 5 == 1, F.concat(F.lit(" "), text, F.lit(" "))).when(k % 5 == 2, F.concat(F.lit("tx"), text)).when(k % 5 == 3, "").alias("txid"),
        F.when(k % 4 == 0, '["W1", " W2 "]').when(k % 4 == 1, F.concat(F.lit("W1|W"), c, F.lit("|"))).when(k % 4 == 2, "W1;W2").otherwise("W9").alias("wallets"),
        F.when(k % 4 == 0, "8333").when(k % 4 == 1, "70000").when(k % 4 == 2, "80.5").otherwise("x").alias("port"),
        F.when(k % 3 == 0, F.concat(F.lit("AS"), c)).when(k % 3 == 1, c).otherwise("ASx").alias("asn"),
        F.when(k % 3 == 0, F.concat(F.lit("10.0."), (F.col("o_custkey") % 300).cast("string"), F.lit(".7"))).when(k % 3 == 1, "not-an-ip").otherwise("192.0.2.1").alias("ip"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "0.5").when(k % 4 == 2, "1.5").otherwise("x").alias("confidence"),
        F.lit(" in ").alias("country"),
    )


@query("p3_p26_normalised_fields", """SELECT k, CASE WHEN k % 5 IN (0, 1) THEN k::VARCHAR WHEN k % 5 = 2 THEN 'tx' || k ELSE '' END AS txid_plain, CASE k % 5 WHEN 2 THEN 'tx' || k WHEN 0 THEN k::VARCHAR WHEN 1 THEN k::VARCHAR ELSE '' END AS txid_numeric,
  CASE k % 4 WHEN 0 THEN 'W1,W2' WHEN 1 THEN 'W1,' || split_part(wallets, '|', 2) WHEN 2 THEN 'W1,W2' ELSE 'W9' END AS wallets, CASE k % 4 WHEN 0 THEN 8333 WHEN 2 THEN 80 END AS port, CASE k % 4 WHEN 0 THEN 8333 END AS strict_port,
  try_cast(replace(asn, 'AS', '') AS BIGINT) AS asn, CASE WHEN k % 3 = 2 OR (k % 3 = 0 AND coalesce(try_cast(split_part(ip, '.', 3) AS INT), 999) < 256) THEN ip END AS ip, CASE k % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 END::DOUBLE AS confidence, 'IN' AS country FROM rawtext""", RAW)
def p3(spark, sf):
    r, c = raw(spark, sf), F.col
    return r.select(
        "k", n.txid_plain(c("txid")).alias("txid_plain"), n.txid_numeric(c("txid")).alias("txid_numeric"), F.concat_ws(",", n.wallet_list(c("wallets"))).alias("wallets"), n.port(c("port")).alias("port"), n.port(c("port"), True).alias("strict_port"),
        n.asn(c("asn")).alias("asn"), n.ip(c("ip")).alias("ip"), n.confidence(c("confidence")).alias("confidence"), n.country_code(c("country")).alias("country"),
    )


@query("p14_network_validation", """SELECT k, CASE WHEN k % 5 >= 3 THEN 'txid' ELSE '' END AS missing, concat_ws(',', CASE WHEN k % 4 > 0 THEN 'src_port' END, CASE WHEN NOT (k % 3 = 2 OR (k % 3 = 0 AND coalesce(try_cast(split_part(ip, '.', 3) AS INT), 999) < 256)) THEN 'src_ip' END) AS invalid,
  k % 5 < 3 AND k % 4 = 0 AND (k % 3 = 2 OR (k % 3 = 0 AND coalesce(try_cast(split_part(ip, '.', 3) AS INT), 999) < 256)) AS valid FROM rawtext""", RAW)
def p14(spark, sf):
    r = raw(spark, sf).select("k", "txid", F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.col("ip").alias("src_ip"), F.col("port").alias("src_port"), F.lit("10.0.0.1").alias("dst_ip"), F.lit("8333").alias("dst_port"))
    v = validate.validated(r, "NETWORK_OBSERVATION")
    return v.select("k", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "invalid").alias("invalid"), "valid")


# --- temporal graph state -------------------------------------------------------------------------------------

PE = [
    "pe AS (SELECT a.address AS a, b.address AS b, s.time_step, row_number() OVER (PARTITION BY a.address, b.address ORDER BY s.time_step, a.txid) AS nth FROM ins a JOIN ins b ON a.txid = b.txid AND a.address < b.address JOIN steps s ON s.txid = a.txid)",
    "pend AS (SELECT a AS address, time_step, nth FROM pe UNION ALL SELECT b, time_step, nth FROM pe)",
    "asks AS (SELECT DISTINCT address, time_step FROM ins JOIN steps USING (txid))",
    "st AS (SELECT k.address, k.time_step, count(*) FILTER (WHERE nth = 2) AS degree, coalesce(max(nth), 0) AS max_shared FROM asks k LEFT JOIN pend e ON e.address = k.address AND e.time_step < k.time_step GROUP BY ALL)",
]


def _members(spark, sf):
    return d.tx_inputs(spark, sf).join(d.steps(spark, sf), "txid")


@query("w8_g4_pair_activation", "SELECT a, b, time_step AS active_from FROM pe WHERE nth = 2", *PE)
def w8(spark, sf):
    return temporal_graph.activations(temporal_graph.pair_events(d.tx_inputs(spark, sf), d.steps(spark, sf)), 2)


@query("g5_address_state_before", "SELECT txid, address, time_step, degree, max_shared FROM ins JOIN steps USING (txid) JOIN st USING (address, time_step)", *PE)
def g5(spark, sf):
    events = temporal_graph.pair_events(d.tx_inputs(spark, sf), d.steps(spark, sf))
    return temporal_graph.degree_before(_members(spark, sf), events)


@query("g6_temporal_roll_up", """SELECT s.txid, coalesce(r, 0) AS input_repeated_addresses, coalesce(m, 0) AS input_max_degree, round(coalesce(a, 0), 6) AS input_mean_degree, coalesce(x, 0) AS input_max_shared FROM steps s LEFT JOIN
  (SELECT txid, count(*) FILTER (WHERE degree > 0) AS r, max(degree) AS m, avg(degree) AS a, max(max_shared) AS x FROM ins JOIN steps USING (txid) JOIN st USING (address, time_step) GROUP BY txid) q ON s.txid = q.txid""", *PE)
def g6(spark, sf):
    events = temporal_graph.pair_events(d.tx_inputs(spark, sf), d.steps(spark, sf))
    return temporal_graph.roll_up(d.steps(spark, sf), temporal_graph.degree_before(_members(spark, sf), events))


# --- enriched risk --------------------------------------------------------------------------------------------

ENRICHED = """enr AS (SELECT f.*, greatest(f.network_signal, CASE WHEN i.sc > 0 THEN i.sc ELSE 0 END) AS net, f.network_available OR coalesce(i.sc > 0, false) AS neta FROM fused f LEFT JOIN (SELECT txid, greatest(vpn_evidence, proxy_evidence, tor_evidence, hosting_evidence) AS sc FROM intel) i ON f.txid = i.txid)"""


@query("f18_j16_enriched_risk", """SELECT txid, round(net, 4) AS network_signal, round(round(greatest(0, least(100, (.15 * ml_signal + .2 * anomaly_signal + .3 * behavioral_signal + .2 * entity_signal + .15 * net)
  * (1 + [0, 0, .02, .04, .06, .08][ml_available::INT + anomaly_available::INT + behavioral_available::INT + entity_available::INT + neta::INT + 1]) * 100)), 6) + 1e-7, 4) AS risk_score FROM enr""", *RISK, INTEL, ENRICHED)
def f18(spark, sf):
    intel = network.transaction_intelligence(network.classified_observations(d.observations(spark, sf), d.feed(spark, sf)))
    intel = intel.select("txid", "network_intelligence_evidence_score", "network_intelligence_available")
    both = given_channels(spark, sf).join(intel, "txid", "left")
    found = F.coalesce("network_intelligence_available", F.lit(False))
    both = both.withColumn("network_signal", F.when(found, F.greatest("network_signal", "network_intelligence_evidence_score")).otherwise(F.col("network_signal"))).withColumn("network_available", F.col("network_available") | found)
    return risk.scores(both).select("txid", F.round("network_signal", 4).alias("network_signal"), F.round(F.col("risk_score") + 1e-7, 4).alias("risk_score"))


# --- models ---------------------------------------------------------------------------------------------------

FEATURES = ["log_total_btc", "log_fee_btc", "address_imbalance", "output_input_btc_ratio", "input_max_share"]


def dataset(spark, sf) -> DataFrame:
    """txid, the features, time_step, label (0 .. 2) and part of the split, in one pass over the transactions."""
    tx = features.transaction_features(d.canonical(spark, sf), ("time_step", "label"))
    tx = tx.select("txid", *FEATURES, "time_step", (F.col("label") - 1).cast("double").alias("label"))
    return tx.join(F.broadcast(ml.step_split(d.steps(spark, sf)).select("time_step", "part")), "time_step")  # one row a step


def _predicted(spark, sf, model: str) -> DataFrame:
    data = kept(dataset(spark, sf))  # each stage of the fit reads it, and none makes it anew
    fitted = ml.train(data.filter("part = 'train'"), FEATURES, model)
    return ml.predict(fitted, data.filter("part = 'test'"), FEATURES)


def batch_scores(spark, sf) -> DataFrame:
    """txid, ml_signal (a forest's probability of the first class, learned from the train steps) and anomaly_signal (average
    percentile rank of the isolation forest's score, grown on the train steps)."""
    data = dataset(spark, sf).checkpoint()
    train = data.filter("part = 'train'")
    p = ml.predict(ml.train(train, FEATURES, "forest"), data, FEATURES).select("txid", F.get("probabilities", F.lit(0)).alias("ml_signal"))
    strange = ml.isolation_scores(data, "txid", FEATURES, train).checkpoint()
    return p.join(risk.average_percent_rank(strange, "anomaly_score", "anomaly_signal").select("txid", "anomaly_signal"), "txid")


@query("m5_m6_batch_scores")
def m5(spark, sf):
    return rounded(batch_scores(spark, sf), 6)


@query("m7_m11_logistic_metrics")
def m7(spark, sf):
    return rounded(ml.classification_metrics(_predicted(spark, sf, "logistic")))


@query("m8_m19_forest_ranking")
def m8(spark, sf):
    p = _predicted(spark, sf, "forest").select("txid", F.get("probabilities", F.lit(0)).alias("score"), (F.col("label") == 0).alias("positive")).cache()
    return rounded(ml.ranking_metrics(p, "score", "positive").crossJoin(ml.roc_auc(p, "score", "positive")).crossJoin(ml.average_precision(p, "score", "positive")))


@query("m2_m4_isolation_scores")
def m2(spark, sf):
    data = dataset(spark, sf).checkpoint()
    return ml.isolation_scores(data, "txid", FEATURES, data.filter("part = 'train'"))


ML_SQL = "pos AS (SELECT txid, label = 1 AS y, total_btc AS s FROM tx)"


@query("t8_ranking_metrics", """SELECT k, count(*) FILTER (WHERE y) / k AS precision, count(*) FILTER (WHERE y) / (SELECT count(*) FILTER (WHERE y) FROM pos) AS recall
  FROM (SELECT y, row_number() OVER (ORDER BY s DESC, txid) AS r FROM pos) JOIN (SELECT unnest([50, 100, 250, 500, 1000]) AS k) ON r <= k GROUP BY k""", ML_SQL)
def t8(spark, sf):
    tx = d.canonical(spark, sf).select("txid", "total_btc", (F.col("label") == 1).alias("y"))
    return ml.ranking_metrics(tx, "total_btc", "y")


@query("m19_roc_auc", "SELECT round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 4) AS roc_auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM pos)", ML_SQL)
def m19(spark, sf):
    return rounded(ml.roc_auc(d.canonical(spark, sf).select("total_btc", (F.col("label") == 1).alias("y")), "total_btc", "y"))


@query("m15_contributions")
def m15(spark, sf):
    """Contributions to the first class under the fitted logistic model, of the scaled and imputed features."""
    data = dataset(spark, sf).checkpoint()
    model = ml.train(data.filter("part = 'train'"), FEATURES, "logistic")
    return ml.model_contributions(model, data.filter("part = 'test'"), FEATURES, "txid", 2)


@query("a24_score_percentiles", "SELECT " + ", ".join(f"round(quantile_cont(total_btc, {p / 100}), 4) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + " FROM tx")
def a24(spark, sf):
    return rounded(percentiles(d.canonical(spark, sf), "total_btc", {f"p{p}": p / 100 for p in (1, 5, 25, 50, 75, 95, 99)}))


# --- reports --------------------------------------------------------------------------------------------------


@query("a9_participant_counts", "SELECT txid, time_step, i AS input_count, o AS output_count FROM counts")
def a9(spark, sf):
    return behavior.side_counts(d.steps(spark, sf), d.tx_inputs(spark, sf), d.tx_outputs(spark, sf))


@query("a27_step_feature_statistics", "SELECT time_step, count(*) FILTER (WHERE input_address_count > 0) AS non_zero, round(avg(input_address_count), 4) AS mean, max(input_address_count) AS max FROM tx GROUP BY 1")
def a27(spark, sf):
    x = F.col("input_address_count")
    per = d.canonical(spark, sf).groupBy("time_step").agg(F.count_if(x > 0).alias("non_zero"), F.avg(x).alias("mean"), F.max(x).alias("max"))
    return rounded(per)


@query("a33_observation_report", "SELECT count(*) AS n, count(*) FILTER (WHERE txid IS NULL) AS null_txid, count(DISTINCT network_event_id) AS unique_events, count(DISTINCT src_ip) AS unique_src_ips, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM obs")
def a33(spark, sf):
    c = F.col
    return d.observations(spark, sf).agg(
        F.count("*").alias("n"), F.count_if(c("txid").isNull()).alias("null_txid"), F.countDistinct("network_event_id").alias("unique_events"), F.countDistinct("src_ip").alias("unique_src_ips"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


@query("a25_statistics_by_label", "SELECT label, count(*) AS n, round(avg(total_btc), 4) AS mean, round(quantile_cont(total_btc, .5), 4) AS median, round(stddev_pop(total_btc), 3) AS std FROM tx GROUP BY 1")
def a25(spark, sf):
    b = F.col("total_btc")
    per = d.canonical(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(b), 4).alias("mean"), F.round(F.percentile(b, F.lit(0.5)), 4).alias("median"), F.round(F.stddev_pop(b), 3).alias("std"))
    return per


@query("j18_label_audit", "SELECT time_step, count(*) FILTER (WHERE label = 1) AS class_1, count(*) FILTER (WHERE label = 2) AS class_2, count(*) FILTER (WHERE label = 3) AS class_3 FROM tx GROUP BY 1")
def j18(spark, sf):
    return d.canonical(spark, sf).groupBy("time_step").agg(*(F.count_if(F.col("label") == k).alias(f"class_{k}") for k in (1, 2, 3)))


@query("p32_wallet_search", "SELECT DISTINCT address FROM ins WHERE contains(lower(address), 'w19') ORDER BY address LIMIT 50")
def p32(spark, sf):
    return d.tx_inputs(spark, sf).select("address").filter(F.contains(F.lower("address"), F.lit("w19"))).distinct().orderBy("address").limit(50)


@query("q10_network_gates", gates("evidl", {"evidence_range": "temporal_observation_evidence BETWEEN 0 AND 1", "level_known": "temporal_evidence_level IN ('LOW', 'MODERATE', 'HIGH', 'VERY_HIGH')", "span_not_negative": "span_seconds >= 0"}, "txid"))
def q10(spark, sf):
    seen = network.correlate(d.observations(spark, sf), d.steps(spark, sf)).filter("matched")
    e = network.temporal_evidence(network.temporal_statistics(seen))
    gates = {"evidence_range": F.col("temporal_observation_evidence").between(0, 1), "level_known": F.col("temporal_evidence_level").isin("LOW", "MODERATE", "HIGH", "VERY_HIGH"), "span_not_negative": F.col("span_seconds") >= 0}
    return validate.checks(e, gates, ["txid"])


@query("q4_steps_contiguous", "SELECT min(time_step) AS first, max(time_step) AS last, count(DISTINCT time_step) = max(time_step) - min(time_step) + 1 AS contiguous FROM steps")
def q4(spark, sf):
    t = F.col("time_step")
    return d.steps(spark, sf).agg(F.min(t).alias("first"), F.max(t).alias("last"), (F.countDistinct(t) == F.max(t) - F.min(t) + 1).alias("contiguous"))
