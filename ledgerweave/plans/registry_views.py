"""Queries of lookups, joined views, histograms and further quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.operators import graph, lookup, ml, network, profile, risk, validate
from ledgerweave.plans.registry import mixing, query, rounded
from ledgerweave.plans.registry_risk import CASE, G, RISK, alerts, gates, given_channels, off_ties, scored
from ledgerweave.plans.registry_risk import _band as band
from ledgerweave.plans.registry_risk import _graph as graph_edges

DISCLAIMER = "a priority for review, not proof"


def _evidence(spark, sf):
    seen = network.correlate(d.observations(spark, sf), d.steps(spark, sf)).filter("matched")
    return network.temporal_evidence(network.temporal_statistics(seen))


@query("p33_j23_transaction_view", "SELECT a.txid, round(a.risk_score + 1e-8, 4) AS risk_score, alert_priority, investigation_rank, observation_count, temporal_evidence_level FROM alerts a LEFT JOIN evidl e ON a.txid = e.txid WHERE a.txid = 60", *RISK)
def p33(spark, sf):
    view = lookup.transaction_view(alerts(spark, sf), _evidence(spark, sf).select("txid", "observation_count", "temporal_evidence_level"), 60)
    return rounded(off_ties(view).select("txid", "risk_score", "alert_priority", "investigation_rank", "observation_count", "temporal_evidence_level"))


@query("p35_authority_report", f"""SELECT txid, '{{"txid":' || txid || ',"total_btc":' || total_btc || ',"label":' || label || ',"disclaimer":"{DISCLAIMER}"}}' AS report FROM tx WHERE txid = 60""")
def p35(spark, sf):
    return lookup.report(lookup.one(d.canonical(spark, sf), "txid", 60), ["txid", "total_btc", "label"], DISCLAIMER)


@query("t3_top_transaction_nodes", "SELECT node_id, round(risk_score + 1e-8, 4) AS risk_score FROM (SELECT 'tx:' || s.txid AS node_id, risk_score FROM steps s LEFT JOIN scored c ON s.txid = c.txid) ORDER BY risk_score DESC NULLS LAST, node_id LIMIT 50", *RISK)
def t3(spark, sf):
    rows = scored(spark, sf).select(F.concat(F.lit("tx:"), F.col("txid").cast("string")).alias("node_id"), "risk_score")
    return rounded(off_ties(rows.orderBy(F.desc_nulls_last("risk_score"), "node_id").limit(50)))


@query("t10_top_anomalies", "SELECT txid, round(anomaly_signal, 6) AS anomaly_signal FROM fused ORDER BY fused.anomaly_signal DESC, txid LIMIT 100", *RISK)
def t10(spark, sf):
    m = risk.average_percent_rank(mixing(spark, sf).select("txid", "participant_count"), "participant_count", "anomaly_signal")
    return rounded(m.select("txid", "anomaly_signal").orderBy(F.desc("anomaly_signal"), "txid").limit(100), 6)


@query("t11_capped_neighbourhood", "SELECT edge_id, relation, CASE WHEN source = 'wallet:W45' THEN target ELSE source END AS neighbour, CASE WHEN source = 'wallet:W45' THEN 'out' ELSE 'in' END AS direction FROM ge WHERE source = 'wallet:W45' OR target = 'wallet:W45' ORDER BY edge_id LIMIT 20", *G)
def t11(spark, sf):
    return lookup.capped_neighbourhood(graph.neighbourhood(graph_edges(spark, sf), "wallet:W45"), 20)


@query("t13_ranking_by_class_and_window", """SELECT w AS window, c AS class, k, count(*) FILTER (WHERE label = c) / k AS precision, count(*) FILTER (WHERE label = c) / any_value(total) AS recall FROM (
  SELECT w, c, label, row_number() OVER (PARTITION BY w, c ORDER BY total_btc DESC, txid) AS r, count(*) FILTER (WHERE label = c) OVER (PARTITION BY w, c) AS total
  FROM (SELECT *, CASE WHEN time_step BETWEEN 40 AND 44 THEN 'early' ELSE 'late' END AS w FROM tx WHERE time_step BETWEEN 40 AND 49), (SELECT unnest([1, 2, 3]) AS c)) JOIN (SELECT unnest([50, 100]) AS k) ON r <= k GROUP BY w, c, k""")
def t13(spark, sf):
    tx = d.canonical(spark, sf).filter(F.col("time_step").between(40, 49)).select("txid", "total_btc", "label", F.when(F.col("time_step") <= 44, "early").otherwise("late").alias("window"))
    out = None
    for w in ("early", "late"):
        for c in (1, 2, 3):
            one = ml.ranking_metrics(tx.filter(F.col("window") == w).withColumn("y", F.col("label") == c), "total_btc", "y", (50, 100))
            one = one.select(F.lit(w).alias("window"), F.lit(c).alias("class"), "k", "precision", "recall")
            out = one if out is None else out.unionByName(one)
    return out


@query("d5_feed_record_ids", "SELECT sha256(ip || '|' || network_type || '|' || provider || '|' || printf('%.8f', confidence) || '|' || source || '||||') AS record_id FROM feed")
def d5(spark, sf):
    rows = d.feed(spark, sf).withColumns({c: F.lit(None).cast("string") for c in ("valid_from", "valid_to", "asn", "country")})
    names = ["ip", "network_type", "provider", "confidence", "source", "valid_from", "valid_to", "asn", "country"]
    return rows.select(lookup.record_id(names, "confidence").alias("record_id"))


PARTS = "parts AS (SELECT time_step, CASE WHEN n <= floor(k * .6) THEN 'train' WHEN n <= floor(k * .8) THEN 'validation' ELSE 'test' END AS part FROM (SELECT time_step, row_number() OVER (ORDER BY time_step) AS n, count(*) OVER () AS k FROM (SELECT DISTINCT time_step FROM steps)))"


@query("d10_m18_split_coverage", """SELECT (SELECT count(*) FROM (SELECT time_step FROM parts GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS in_two, (SELECT count(*) FROM parts WHERE part IS NULL) AS in_none,
  max(time_step) FILTER (WHERE part = 'train') < min(time_step) FILTER (WHERE part = 'validation') AND max(time_step) FILTER (WHERE part = 'validation') < min(time_step) FILTER (WHERE part = 'test') AS in_order FROM parts""", PARTS)
def d10(spark, sf):
    return lookup.split_overlaps(ml.step_split(d.steps(spark, sf)))


@query("j11_statistics_on_observations", "SELECT network_event_id, obs.txid, coalesce(observation_count, 0) AS observation_count, coalesce(unique_endpoints, 0) AS unique_endpoints, round(coalesce(span_seconds, 0) + 1e-7, 4) AS span_seconds FROM obs LEFT JOIN stats ON obs.txid = stats.txid")
def j11(spark, sf):
    seen = network.correlate(d.observations(spark, sf), d.steps(spark, sf)).filter("matched")
    rows = lookup.back_to_observations(d.observations(spark, sf), network.temporal_statistics(seen))
    return rows.withColumn("span_seconds", F.round(F.col("span_seconds") + 1e-7, 4))


@query("j20_top_alert_features", "SELECT a.txid, investigation_rank, round(total_btc, 4) AS total_btc, round(fee_btc, 4) AS fee_btc, input_address_count, output_address_count FROM alerts a JOIN tx ON a.txid = tx.txid WHERE investigation_rank <= 1000", *RISK)
def j20(spark, sf):
    top = alerts(spark, sf).filter("investigation_rank <= 1000").select("txid", "investigation_rank")
    return rounded(top.join(d.canonical(spark, sf).select("txid", "total_btc", "fee_btc", "input_address_count", "output_address_count"), "txid"))


@query("j21_j22_q8_alerts_agree_with_scores", "SELECT count(*) FILTER (WHERE c.txid IS NULL) AS only_left, count(*) FILTER (WHERE a.txid IS NULL) AS only_right, count(*) FILTER (WHERE abs(a.risk_score - c.risk_score) > 1e-9 * greatest(1, abs(a.risk_score), abs(c.risk_score))) AS apart FROM alerts a FULL JOIN scored c ON a.txid = c.txid", *RISK)
def j21(spark, sf):
    return lookup.disagreements(alerts(spark, sf), scored(spark, sf), "txid", "risk_score")


@query("a35_class_histogram", "SELECT CASE label WHEN 1 THEN 'ILLICIT' WHEN 2 THEN 'LICIT' ELSE 'UNKNOWN' END AS classification, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percentage FROM tx GROUP BY 1")
def a35(spark, sf):
    kind = F.when(F.col("label") == 1, "ILLICIT").when(F.col("label") == 2, "LICIT").otherwise("UNKNOWN")
    return profile.distribution(d.canonical(spark, sf).select(kind.alias("classification")), "classification").withColumnRenamed("value", "classification")


@query("a36_case_summary", f"SELECT risk_level, count(*) AS n, sum((ch > 0)::INT)::BIGINT AS behavioral_available, sum((ch > 0)::INT)::BIGINT AS entity_available FROM (SELECT *, {band('round(risk, 6)')} AS risk_level FROM sc) GROUP BY 1", *CASE)
def a36(spark, sf):
    rows = profile.case_rows(d.canonical(spark, sf))
    return rows.groupBy("risk_level").agg(F.count("*").alias("n"), F.count_if("behavioral_available").alias("behavioral_available"), F.count_if("entity_available").alias("entity_available"))


@query("q6_step_shares", "SELECT time_step, count(*) AS n, round(avg((alert_status = 'ACTIVE')::INT), 6) AS active_rate, round(count(*) FILTER (WHERE active_alert_rank <= 1000) / sum(count(*) FILTER (WHERE active_alert_rank <= 1000)) OVER (), 6) AS top_share FROM alerts GROUP BY 1", *RISK)
def q6(spark, sf):
    a = alerts(spark, sf).groupBy("time_step").agg(F.count("*").alias("n"), F.avg((F.col("alert_status") == "ACTIVE").cast("int")).alias("active_rate"), F.count_if("top_alert_queue").alias("t")).checkpoint()
    total = a.agg(F.sum("t").alias("total"))
    return rounded(a.crossJoin(F.broadcast(total)).select("time_step", "n", "active_rate", F.try_divide("t", "total").alias("top_share")), 6)  # one row


UNIT = {f"{c}_range": f"{c}_signal BETWEEN 0 AND 1" for c in risk.WEIGHTS}


@query("q7_q14_q16_signal_gates", gates("fused", {**UNIT, "no_network_no_signal": "network_available OR network_signal = 0", "step_known": "time_step IS NOT NULL"}, "txid"), *RISK)
def q16(spark, sf):
    conditions = {k: F.expr(v) for k, v in UNIT.items()} | {"no_network_no_signal": F.expr("network_available OR network_signal = 0"), "step_known": F.col("time_step").isNotNull()}
    return validate.checks(given_channels(spark, sf), conditions, ["txid"])


@query("q12_q15_detector_gates", gates("mixing", {"candidate_scores": "NOT mixing_candidate OR mixing_evidence_score > 0", "score_finite": "NOT isnan(mixing_evidence_score) AND NOT isinf(mixing_evidence_score)", "counts_not_negative": "input_count >= 0 AND output_count >= 0"}, "txid"))
def q15(spark, sf):
    c = F.col
    score = c("mixing_evidence_score")
    conditions = {"candidate_scores": ~c("mixing_candidate") | (score > 0), "score_finite": ~F.isnan(score) & (F.abs(score) < float("inf")), "counts_not_negative": (c("input_count") >= 0) & (c("output_count") >= 0)}
    return validate.checks(mixing(spark, sf), conditions, ["txid"])
