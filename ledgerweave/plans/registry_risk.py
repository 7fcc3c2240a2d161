"""Queries of risk, alerts, graph, profiles and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.operators import behavior, entity, features, graph, network, profile, risk, validate
from ledgerweave.operators.ordering import percentiles_by
from ledgerweave.plans.registry import DEGREE, ENT, made_once, mixing, peeling, query, rounded, side_lists

# --- signals and fusion ----------------------------------------------------------------------------------------

# The entity signal: six components, each the mean of both sides; counts are scaled between their 1 and 99 per cent quantiles.
ENTITY = {
    "repeated_degree": "repeated_degree_max",
    "shared_transaction": "shared_count_max",
    "cluster_diversity": "distinct_clusters_t1",
    "cluster_size": "cluster_size_max_t1",
    "address_count": "address_count",
}
_SIDES = [f"{side}_{c}" for c in ENTITY.values() for side in ("input", "output")]
ENTITY_SQL = [
    "sides AS (SELECT *, i AS input_address_count, o AS output_address_count FROM input JOIN output USING (txid) JOIN counts USING (txid))",
    "cuts AS (SELECT " + ", ".join(f"quantile_cont({c}, .01) AS {c}_a, quantile_cont({c}, .99) AS {c}_b" for c in _SIDES) + " FROM sides)",
    "scaled AS (SELECT txid, input_repeated_ratio, output_repeated_ratio, input_repeated_addresses + output_repeated_addresses > 0 AS entity_available, "
    + ", ".join(f"CASE WHEN {c}_b > {c}_a THEN greatest(0, least(1, ({c} - {c}_a) / ({c}_b - {c}_a))) WHEN {c}_b > 0 THEN 1 ELSE 0 END::DOUBLE AS {c}_signal" for c in _SIDES)
    + " FROM sides, cuts)",
    "entity AS (SELECT *, ((input_repeated_ratio + output_repeated_ratio) / 2 + " + " + ".join(f"(input_{c}_signal + output_{c}_signal) / 2" for c in ENTITY.values()) + ") / 6 AS entity_signal FROM scaled)",
]
GIVEN = """fused AS (SELECT s.txid, s.time_step, CASE tx.label WHEN 1 THEN .9 WHEN 2 THEN .2 ELSE .5 END::DOUBLE AS ml_signal, true AS ml_available,
  (rank() OVER (ORDER BY m.participant_count) + (count(*) OVER (PARTITION BY m.participant_count) - 1) / 2) / count(*) OVER () AS anomaly_signal, true AS anomaly_available,
  m.mixing_evidence_score AS behavioral_signal, m.participant_count > 0 AS behavioral_available, entity_signal, entity_available,
  coalesce(e.temporal_observation_evidence, 0) AS network_signal, e.txid IS NOT NULL AS network_available
  FROM steps s JOIN tx ON s.txid = tx.txid JOIN mixing m ON s.txid = m.txid JOIN entity ON s.txid = entity.txid LEFT JOIN evidl e ON s.txid = e.txid)"""
SCORED = """scored AS (SELECT *, greatest(0, least(100, round(weighted_evidence_score * (1 + [0, 0, .02, .04, .06, .08][effective_evidence_channel_count + 1]) * 100, 6)))::DOUBLE AS risk_score FROM
  (SELECT *, .15 * ml_signal + .2 * anomaly_signal + .3 * behavioral_signal + .2 * entity_signal + .15 * network_signal AS weighted_evidence_score,
   ml_available::INT + anomaly_available::INT + behavioral_available::INT + entity_available::INT + network_available::INT AS effective_evidence_channel_count FROM fused))"""


def _band(c: str) -> str:
    return f"CASE WHEN {c} >= 80 THEN 'VERY_HIGH' WHEN {c} >= 60 THEN 'HIGH' WHEN {c} >= 40 THEN 'MODERATE' WHEN {c} >= 20 THEN 'GUARDED' ELSE 'LOW' END"


RANKED = f"""ranked AS (SELECT *, CASE WHEN alert_priority IN ('VERY_HIGH', 'HIGH', 'MODERATE') THEN 'ACTIVE' WHEN alert_priority = 'GUARDED' THEN 'WATCH' ELSE 'INFORMATIONAL' END AS alert_status,
  row_number() OVER (ORDER BY risk_score DESC, effective_evidence_channel_count DESC, behavioral_signal DESC, entity_signal DESC, anomaly_signal DESC, network_signal DESC, time_step, txid::VARCHAR) AS investigation_rank
  FROM (SELECT *, {_band('risk_score')} AS alert_priority FROM scored))"""
ACTIVE = "alerts AS (SELECT *, CASE WHEN alert_status = 'ACTIVE' THEN sum((alert_status = 'ACTIVE')::INT) OVER (ORDER BY investigation_rank)::BIGINT END AS active_alert_rank FROM ranked)"
RISK = (DEGREE, *ENT, *ENTITY_SQL, GIVEN, SCORED, RANKED, ACTIVE)


@made_once
def signal_sides(spark, sf) -> DataFrame:
    """Both sides' evidence with clusters at threshold 1, the only one that the signal reads."""
    lists = side_lists(spark, sf)
    return entity.sides_evidence(d.steps(spark, sf), lists, entity.address_evidence(lists, (1,)), (1,))


def entity_signal(spark, sf) -> DataFrame:
    """txid, time_step, both sides' numbers of addresses, the six components, entity_signal and entity_available."""
    return risk.entity_signal(signal_sides(spark, sf), ENTITY, ("time_step", *COUNTS))


def _network(spark, sf) -> DataFrame:
    seen = network.correlate(d.observations(spark, sf), d.steps(spark, sf)).filter("matched")
    return network.temporal_evidence(network.temporal_statistics(seen)).select("txid", F.col("temporal_observation_evidence").alias("network_signal"), F.lit(True).alias("network_available"))


#: Both sides' numbers of addresses.
COUNTS = ("input_address_count", "output_address_count")


def _mixing(counts: DataFrame) -> DataFrame:
    """The mixing indicators beside what is in a table with both sides' counts."""
    return behavior.mixing_indicators(counts.withColumnsRenamed({"input_address_count": "input_count", "output_address_count": "output_count"}))


def _joined(behavioral: DataFrame, seen: DataFrame, models: DataFrame) -> DataFrame:
    """All channels, from a table that has the behavioural and the entity channel already."""
    columns = ["txid", "time_step", "behavioral_signal", "behavioral_available", "entity_signal", "entity_available", *(["anomaly_signal"] if "anomaly_signal" in behavioral.columns else [])]
    out = behavioral.select(*columns).join(models, "txid").join(seen, "txid", "left")
    return out.fillna(0.0, ["network_signal"]).fillna(False, ["network_available"]).withColumns({"ml_available": F.lit(True), "anomaly_available": F.lit(True)})


@made_once
def given_channels(spark, sf) -> DataFrame:
    """Five channels that SQL can follow, to compare the fusion with it: real entity, network and mixing evidence, and two
    stand-ins for what models give (a number for each label, the rank of the participant count)."""
    m = _mixing(entity_signal(spark, sf)).select("txid", "time_step", "participant_count", F.col("mixing_evidence_score").alias("behavioral_signal"), "entity_signal", "entity_available")
    m = risk.average_percent_rank(m, "participant_count", "anomaly_signal").withColumn("behavioral_available", F.col("participant_count") > 0)
    labels = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("txid"), F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.2).otherwise(0.5).alias("ml_signal"))
    return _joined(m, _network(spark, sf), labels)


@made_once
def fused(spark, sf) -> DataFrame:
    """Five channels for every transaction, of the engine's own operators: a fitted model's probability, the rank of the
    isolation forest's score, peeling and mixing evidence, the entity signal, and network evidence."""
    from ledgerweave.plans.registry_more import batch_scores

    m = _mixing(entity_signal(spark, sf)).select("txid", "mixing_evidence_score", "mixing_candidate", "entity_signal", "entity_available")
    b = behavior.behavioral_evidence(peeling(spark, sf), m).join(m.select("txid", "entity_signal", "entity_available"), "txid")
    b = b.withColumns({"behavioral_signal": F.col("behavioral_evidence_score"), "behavioral_available": F.lit(True)})
    return _joined(b, _network(spark, sf), batch_scores(spark, sf))


def off_ties(df: DataFrame) -> DataFrame:
    """Scores have six decimals, so the fifth is often a tie, which engines round either way."""
    return df.withColumn("risk_score", F.col("risk_score") + 1e-8)


def scored(spark, sf) -> DataFrame:
    return risk.scores(given_channels(spark, sf))


def alerts(spark, sf) -> DataFrame:
    return risk.ranked_alerts(scored(spark, sf))


@query("f19_entity_signal", "SELECT txid, round(entity_signal, 6) AS entity_signal, entity_available FROM entity", DEGREE, *ENT, *ENTITY_SQL)
def f19(spark, sf):
    return rounded(entity_signal(spark, sf).select("txid", "entity_signal", "entity_available"), 6)


SIGNALS = ("ml", "anomaly", "behavioral", "entity", "network")


@query("w4_a31_j15_fused_signals")
def j15_models(spark, sf):
    return rounded(fused(spark, sf).select("txid", "time_step", *(f"{s}_{x}" for s in SIGNALS for x in ("signal", "available"))))


@query("f12_f13_risk_scores")
def f12_models(spark, sf):
    return rounded(risk.scores(fused(spark, sf)).select("txid", "effective_evidence_channel_count", "risk_score", "risk_level"))


@query("w5_f14_ranked_alerts")
def w5_models(spark, sf):
    ranked = risk.ranked_alerts(risk.scores(fused(spark, sf)))
    return rounded(ranked.select("txid", "time_step", "risk_score", "alert_priority", "alert_status", "investigation_rank", "active_alert_rank", "top_alert_queue"))


# The fusion, its ranks and its reports over the given channels, beside SQL.


@query("j15_given_channels", "SELECT txid, time_step, round(ml_signal, 4) AS ml_signal, round(anomaly_signal, 4) AS anomaly_signal, round(behavioral_signal, 4) AS behavioral_signal, round(entity_signal, 4) AS entity_signal, round(network_signal, 4) AS network_signal, ml_available, anomaly_available, behavioral_available, entity_available, network_available FROM fused", *RISK)
def j15(spark, sf):
    return rounded(given_channels(spark, sf).select("txid", "time_step", *(f"{s}_{x}" for s in SIGNALS for x in ("signal", "available"))))


@query("f12_f13_scores_of_given_channels", f"SELECT txid, effective_evidence_channel_count, round(risk_score + 1e-8, 4) AS risk_score, {_band('risk_score')} AS risk_level FROM scored", *RISK)
def f12(spark, sf):
    return rounded(off_ties(scored(spark, sf)).select("txid", "effective_evidence_channel_count", "risk_score", "risk_level"))


@query("w5_f14_alerts_of_given_channels", "SELECT txid, time_step, round(risk_score + 1e-8, 4) AS risk_score, alert_priority, alert_status, investigation_rank, active_alert_rank, coalesce(active_alert_rank <= 1000, false) AS top_alert_queue FROM alerts", *RISK)
def w5(spark, sf):
    return rounded(off_ties(alerts(spark, sf)).select("txid", "time_step", "risk_score", "alert_priority", "alert_status", "investigation_rank", "active_alert_rank", "top_alert_queue"))


def _part(c: str) -> str:
    return f"CASE WHEN {c}_signal > 0 THEN CASE WHEN {c}_signal >= .7 THEN 'strong' WHEN {c}_signal >= .4 THEN 'moderate' ELSE 'weak' END || ' {c} evidence (' || printf('%.3f', {c}_signal + 1e-9) || ')' END"


@query("f15_explanations", "SELECT txid, concat_ws('; ', " + ", ".join(map(_part, risk.WEIGHTS)) + ", CASE WHEN effective_evidence_channel_count >= 4 THEN 'broad' WHEN effective_evidence_channel_count >= 2 THEN 'partial' ELSE 'little' END || ' agreement', 'a priority for review, not proof') AS explanation FROM scored", *RISK)
def f15(spark, sf):
    shifted = scored(spark, sf).withColumns({f"{c}_signal": F.when(F.col(f"{c}_signal") > 0, F.col(f"{c}_signal") + 1e-9).otherwise(0.0) for c in risk.WEIGHTS})  # off ties of the third decimal
    return risk.explanation(shifted).select("txid", "explanation")


@query("t1_alert_page", "SELECT txid, investigation_rank FROM alerts WHERE investigation_rank BETWEEN 101 AND 150", *RISK)
def t1(spark, sf):
    return risk.page(alerts(spark, sf), 3, 50).select("txid", "investigation_rank")


@query("t2_top_risk", "SELECT txid, round(risk_score + 1e-8, 4) AS risk_score FROM alerts ORDER BY alerts.risk_score DESC, investigation_rank LIMIT 100", *RISK)
def t2(spark, sf):
    return rounded(off_ties(risk.top_risk(alerts(spark, sf), 100)).select("txid", "risk_score"))


@query("p31_filtered_alerts", "SELECT txid, investigation_rank FROM alerts WHERE alert_status = 'ACTIVE' AND time_step = 7 AND risk_score BETWEEN 40 AND 60", *RISK)
def p31(spark, sf):
    return risk.filtered(alerts(spark, sf), alert_status="active", time_step=7, min_risk=40, max_risk=60).select("txid", "investigation_rank")


@query("a14_alert_summary", """SELECT count(*) AS n, round(avg(risk_score), 4) AS mean_risk, round(quantile_cont(risk_score, .5), 4) AS median_risk, round(min(risk_score), 4) AS min_risk, round(max(risk_score), 4) AS max_risk,
  count(*) FILTER (WHERE alert_priority = 'VERY_HIGH') AS n_very_high, count(*) FILTER (WHERE alert_priority = 'HIGH') AS n_high, count(*) FILTER (WHERE alert_priority = 'MODERATE') AS n_moderate, count(*) FILTER (WHERE alert_priority = 'GUARDED') AS n_guarded, count(*) FILTER (WHERE alert_priority = 'LOW') AS n_low,
  round(avg(ml_signal), 4) AS mean_ml, round(avg(anomaly_signal), 4) AS mean_anomaly, round(avg(behavioral_signal), 4) AS mean_behavioral, round(avg(entity_signal), 4) AS mean_entity, round(avg(network_signal), 4) AS mean_network, round(avg(risk_score) FILTER (WHERE active_alert_rank <= 1000), 4) AS top_queue_mean FROM alerts""", *RISK)
def a14(spark, sf):
    return risk.summary(alerts(spark, sf))


@query("a15_alerts_by_step", """SELECT s.t AS time_step, coalesce(n, 0) AS n, coalesce(mean_risk, 0) AS mean_risk, coalesce(median_risk, 0) AS median_risk, coalesce(n_high, 0) AS n_high, coalesce(n_active, 0) AS n_active, coalesce(n_top, 0) AS n_top FROM (SELECT unnest(range(1, 50))::INT AS t) s LEFT JOIN
  (SELECT time_step, count(*) AS n, round(avg(risk_score), 4) AS mean_risk, round(quantile_cont(risk_score, .5), 4) AS median_risk, count(*) FILTER (WHERE alert_priority = 'HIGH') AS n_high, count(*) FILTER (WHERE alert_status = 'ACTIVE') AS n_active, count(*) FILTER (WHERE active_alert_rank <= 1000) AS n_top FROM alerts GROUP BY 1) q ON s.t = q.time_step""", *RISK)
def a15(spark, sf):
    return risk.by_step(alerts(spark, sf))


@query("a22_concentration", """SELECT round(sum(risk_score) FILTER (WHERE investigation_rank <= ceil(round(n * .001, 9))), 4) AS top_0_1_sum, round(avg(risk_score) FILTER (WHERE investigation_rank <= ceil(round(n * .001, 9))), 4) AS top_0_1_mean,
  round(sum(risk_score) FILTER (WHERE investigation_rank <= ceil(round(n * .01, 9))), 4) AS top_1_sum, round(avg(risk_score) FILTER (WHERE investigation_rank <= ceil(round(n * .01, 9))), 4) AS top_1_mean,
  round(sum(risk_score) FILTER (WHERE investigation_rank <= ceil(round(n * .05, 9))), 4) AS top_5_sum, round(avg(risk_score) FILTER (WHERE investigation_rank <= ceil(round(n * .05, 9))), 4) AS top_5_mean FROM (SELECT *, count(*) OVER () AS n FROM alerts)""", *RISK)
def a22(spark, sf):
    return risk.concentration(scored(spark, sf), "risk_score")


@query("a21_a23_step_diagnostics", """SELECT time_step, count(*) AS n, round(avg(risk_score), 4) AS mean, round(stddev_pop(risk_score), 4) AS std, round(quantile_cont(risk_score, .95), 4) AS p95, round(quantile_cont(risk_score, .99), 4) AS p99, round(avg((behavioral_signal > .5)::INT), 4) AS behavioral_rate FROM scored GROUP BY 1""", *RISK)
def a21(spark, sf):
    r = F.col("risk_score")
    rows = scored(spark, sf)
    per = rows.groupBy("time_step").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.avg((F.col("behavioral_signal") > 0.5).cast("int")).alias("behavioral_rate"))
    return rounded(per.join(percentiles_by(rows, "time_step", "risk_score", {"p95": 0.95, "p99": 0.99}), "time_step"))


def gates(table: str, conditions: dict[str, str], key: str | None = None) -> str:
    """SQL that counts the rows of a table that break each condition, and repeated keys."""
    counts = {k: f"count(*) FILTER (WHERE NOT coalesce({c}, false))" for k, c in conditions.items()}
    if key:
        counts["unique_key"] = f"count(*) - count(DISTINCT {key})"
    return " UNION ALL ".join(f"SELECT '{k}' AS check, ({c})::BIGINT AS failures FROM {table}" for k, c in counts.items())


@query("q5_rank_gates", gates("alerts", {"rank_positive": "investigation_rank >= 1", "risk_in_range": "risk_score BETWEEN 0 AND 100", "active_has_rank": "(alert_status = 'ACTIVE') = (active_alert_rank IS NOT NULL)"}, "txid"), *RISK)
def q5(spark, sf):
    a = alerts(spark, sf)
    return validate.checks(a, {"rank_positive": F.col("investigation_rank") >= 1, "risk_in_range": F.col("risk_score").between(0, 100), "active_has_rank": (F.col("alert_status") == "ACTIVE") == F.col("active_alert_rank").isNotNull()}, ["txid"])


@query("q2_mixing_reproduced", gates("mixing", {"candidate": "mixing_candidate = (fan_in_flag AND fan_out_flag AND balance_flag AND participant_flag)", "score_range": "mixing_evidence_score BETWEEN 0 AND 1", "counts": "participant_count = input_count + output_count"}))
def q2(spark, sf):
    c = F.col
    cond = {
        "candidate": c("mixing_candidate") == (c("fan_in_flag") & c("fan_out_flag") & c("balance_flag") & c("participant_flag")),
        "score_range": c("mixing_evidence_score").between(0, 1),
        "counts": c("participant_count") == c("input_count") + c("output_count"),
    }
    return validate.checks(mixing(spark, sf), cond)


@query("a26_column_audit", "SELECT 'fee_btc' AS \"column\", count(*) FILTER (WHERE fee_btc IS NULL) AS nulls, count(DISTINCT round(fee_btc, 4)) AS \"distinct\", count(*) FILTER (WHERE isinf(fee_btc) OR isnan(fee_btc)) AS infinite FROM tx UNION ALL SELECT 'time_step', count(*) FILTER (WHERE time_step IS NULL), count(DISTINCT time_step), count(*) FILTER (WHERE isinf(time_step::DOUBLE)) FROM tx")
def a26(spark, sf):
    """Fees are sums of products of four decimals, so they are exact at four; beyond, they differ by the order of adding."""
    return validate.column_audit(d.canonical(spark, sf).select(F.round("fee_btc", 4).alias("fee_btc"), "time_step"))


@query("a34_d11_set_overlap", "SELECT count(*) FILTER (WHERE a.txid IS NOT NULL AND b.txid IS NOT NULL) AS in_both, count(*) FILTER (WHERE b.txid IS NULL) AS only_left, count(*) FILTER (WHERE a.txid IS NULL) AS only_right FROM steps a FULL JOIN (SELECT DISTINCT txid FROM obs) b ON a.txid = b.txid")
def a34(spark, sf):
    return validate.set_overlap(d.steps(spark, sf), d.observations(spark, sf), "txid")


@query("d4_event_ids", "SELECT network_event_id, substr(sha256(src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port || '|' || txid || '|' || geo_country), 1, 24) AS id FROM obs")
def d4(spark, sf):
    return d.observations(spark, sf).select("network_event_id", validate.event_id(["src_ip", "dst_ip", "src_port", "dst_port", "txid", "geo_country"]).alias("id"))


@query("d3_deduplicated_observations", "SELECT src_ip, dst_ip, dst_port, min(network_event_id) AS network_event_id, count(*) AS copies FROM obs GROUP BY ALL")
def d3(spark, sf):
    o = d.observations(spark, sf).select("network_event_id", "src_ip", "dst_ip", "dst_port")
    return validate.deduplicated(o, ["src_ip", "dst_ip", "dst_port"], F.col("network_event_id")).drop("fingerprint")


@query("a28_split", "SELECT time_step, n, CASE WHEN n <= floor(k * .6) THEN 'train' WHEN n <= floor(k * .8) THEN 'validation' ELSE 'test' END AS part FROM (SELECT time_step, row_number() OVER (ORDER BY time_step) AS n, count(*) OVER () AS k FROM (SELECT DISTINCT time_step FROM steps))")
def a28(spark, sf):
    from ledgerweave.operators import ml

    return ml.step_split(d.steps(spark, sf))


@query("a29_class_distribution", "SELECT CASE WHEN n <= floor(k * .6) THEN 'train' WHEN n <= floor(k * .8) THEN 'validation' ELSE 'test' END AS part, label, count(*) AS n FROM tx JOIN (SELECT time_step, row_number() OVER (ORDER BY time_step) AS n, count(*) OVER () AS k FROM (SELECT DISTINCT time_step FROM steps)) USING (time_step) GROUP BY 1, 2")
def a29(spark, sf):
    from ledgerweave.operators import ml

    tx = d.canonical(spark, sf).select("time_step", "label")
    return tx.join(ml.step_split(d.steps(spark, sf)).drop("n"), "time_step").groupBy("part", "label").agg(F.count("*").alias("n"))


# --- graph ----------------------------------------------------------------------------------------------------

G = [
    "cont AS (SELECT txid, nxt, min(address) AS shared_address FROM (SELECT txid, address, lead(txid) OVER (PARTITION BY address ORDER BY time_step NULLS LAST, txid) AS nxt FROM ins JOIN steps USING (txid)) WHERE nxt IS NOT NULL GROUP BY ALL)",
    """ge0 AS (SELECT 'wallet:' || address AS source, 'tx:' || txid AS target, 'INPUT_TO' AS relation, NULL::VARCHAR AS shared_address FROM ins UNION ALL SELECT 'tx:' || txid, 'wallet:' || address, 'OUTPUT_TO', NULL FROM outs
     UNION ALL SELECT DISTINCT 'ip:' || src_ip, 'tx:' || txid, 'OBSERVED_SOURCE', NULL FROM matched UNION ALL SELECT DISTINCT 'tx:' || txid, 'ip:' || dst_ip, 'OBSERVED_DESTINATION', NULL FROM matched
     UNION ALL SELECT 'tx:' || txid, 'tx:' || nxt, 'ADDRESS_REUSE_CONTINUITY', shared_address FROM cont)""",
    "ge AS (SELECT substr(sha256(source || '|' || target || '|' || relation), 1, 24) AS edge_id, * FROM ge0)",
    "gn AS (SELECT n.node_id, CASE WHEN n.node_id LIKE 'tx:%' THEN 'transaction' WHEN n.node_id LIKE 'wallet:%' THEN 'wallet' ELSE 'ip' END AS node_type, time_step FROM (SELECT source AS node_id FROM ge UNION SELECT target FROM ge UNION SELECT 'tx:' || txid FROM steps) n LEFT JOIN steps ON n.node_id = 'tx:' || steps.txid)",
]


def _graph(spark, sf):
    return graph.edges(d.steps(spark, sf), d.tx_inputs(spark, sf), d.tx_outputs(spark, sf), d.observations(spark, sf))


@query("g16_d8_graph_edges", "SELECT * FROM ge", *G)
def g16(spark, sf):
    return _graph(spark, sf)


@query("g16_graph_nodes", "SELECT * FROM gn", *G)
def g16n(spark, sf):
    return graph.nodes(d.steps(spark, sf), _graph(spark, sf))


@query("w7_continuity", "SELECT txid, nxt AS next_txid, shared_address FROM cont", *G)
def w7(spark, sf):
    return graph.continuity(d.steps(spark, sf), d.tx_inputs(spark, sf))


@query("a37_relations", "SELECT relation, count(*) AS n FROM ge GROUP BY 1", *G)
def a37(spark, sf):
    return graph.histogram(_graph(spark, sf), "relation")


for _name, _node in (("g11_transaction_context", "tx:60"), ("g12_wallet_context", "wallet:W45"), ("g13_ip_context", "ip:10.1.0.7")):

    @query(_name, f"""SELECT edge_id, relation, direction, neighbour, node_type, time_step FROM (SELECT edge_id, relation, CASE WHEN source = '{_node}' THEN target ELSE source END AS neighbour, CASE WHEN source = '{_node}' THEN 'out' ELSE 'in' END AS direction
      FROM ge WHERE source = '{_node}' OR target = '{_node}') JOIN gn ON neighbour = node_id""", *G)
    def _context(spark, sf, node=_node):
        e = _graph(spark, sf)
        return graph.context(graph.nodes(d.steps(spark, sf), e), e, node)


@query("g14_neighbourhood", "SELECT edge_id, relation, CASE WHEN source = 'tx:60' THEN target ELSE source END AS neighbour, CASE WHEN source = 'tx:60' THEN 'out' ELSE 'in' END AS direction FROM ge WHERE source = 'tx:60' OR target = 'tx:60'", *G)
def g14(spark, sf):
    return graph.neighbourhood(_graph(spark, sf), "tx:60")


@query("g15_shortest_path", "SELECT unnest(range(len(path))) AS hop, unnest(path) AS node FROM bfs WHERE node = 'tx:66'", *G,
  "gboth AS MATERIALIZED (SELECT source AS a, target AS b FROM ge UNION SELECT target, source FROM ge)",
  "bfs(node, path) USING KEY (node) AS (SELECT 'tx:60', ['tx:60'] UNION SELECT e.b, min(list_append(f.path, e.b)) FROM bfs f JOIN gboth e ON f.node = e.a LEFT JOIN recurring.bfs r ON r.node = e.b WHERE r.node IS NULL AND len(f.path) <= 6 GROUP BY e.b)")
def g15(spark, sf):
    return graph.shortest_path(_graph(spark, sf), "tx:60", "tx:66")


@query("d12_dangling_edges", "SELECT DISTINCT e.node_id FROM (SELECT source AS node_id FROM ge UNION SELECT target FROM ge) e LEFT JOIN gn ON e.node_id = gn.node_id WHERE gn.node_id IS NULL", *G)
def d12(spark, sf):
    e = _graph(spark, sf)
    return graph.dangling(graph.nodes(d.steps(spark, sf), e), e)


# --- profiles --------------------------------------------------------------------------------------------------


@query("a16_dataset_summary", """SELECT count(*) AS n_transactions, round(sum(input_btc_total), 2) AS input_total, round(sum(output_btc_total), 2) AS output_total, round(sum(fee_btc), 2) AS fee_total, round(sum(input_btc_total - output_btc_total), 2) AS conservation_delta,
  sum(len(input_wallets))::BIGINT AS input_wallet_rows, sum(len(output_wallets))::BIGINT AS output_wallet_rows, bool_or(input_btc_total IS NOT NULL) AS amounts_available, bool_or(len(input_wallets) > 0) AS wallets_available, count(DISTINCT time_step) AS time_steps FROM tx""")
def a16(spark, sf):
    return profile.dataset_summary(d.canonical(spark, sf))


@query("a18_distribution", "SELECT geo_country AS value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percentage FROM obs GROUP BY 1")
def a18(spark, sf):
    return profile.distribution(d.observations(spark, sf), "geo_country")


@query("a19_wallet_activity", "SELECT w AS wallet, count(*) AS activity, round(sum(v) + 1e-5, 2) AS associated_btc FROM (SELECT unnest(input_wallets) AS w, input_btc_total AS v FROM tx UNION ALL SELECT unnest(output_wallets), output_btc_total FROM tx) GROUP BY 1")
def a19(spark, sf):
    return profile.wallet_activity(d.canonical(spark, sf)).withColumn("associated_btc", F.round(F.col("associated_btc") + 1e-5, 2))


@query("a20_wallet_frequency", "SELECT w AS wallet, count(*) AS transactions FROM (SELECT unnest(list_distinct(list_concat(input_wallets, output_wallets))) AS w FROM tx) GROUP BY 1")
def a20(spark, sf):
    return profile.wallet_frequency(d.canonical(spark, sf))


@query("t4_top_transactions", "SELECT txid, round(input_btc_total, 2) AS input_btc_total FROM tx ORDER BY tx.input_btc_total DESC NULLS LAST, txid LIMIT 20")
def t4(spark, sf):
    return rounded(profile.top_transactions(d.canonical(spark, sf)), 2)


@query("t5_top_wallets", "SELECT w AS wallet, count(*) AS activity FROM (SELECT unnest(input_wallets) AS w FROM tx UNION ALL SELECT unnest(output_wallets) FROM tx) GROUP BY 1 ORDER BY activity DESC, wallet LIMIT 20")
def t5(spark, sf):
    return profile.top_wallets(d.canonical(spark, sf)).drop("associated_btc")


CASE = [
    "wal AS (SELECT txid, unnest(list_distinct(list_concat(input_wallets, output_wallets))) AS w, output_wallets AS ow FROM tx)",
    "frq AS (SELECT w, count(*) AS n FROM wal GROUP BY 1)",
    "rol AS (SELECT txid, count(*) FILTER (WHERE n > 1 AND list_contains(ow, w)) AS rout, count(*) FILTER (WHERE n > 1) AS rep, count(*) AS p, coalesce(max(n) FILTER (WHERE n > 1), 0) AS shared FROM wal JOIN frq USING (w) GROUP BY txid)",
    "cas AS (SELECT tx.txid, len(input_wallets) AS i, len(output_wallets) AS o, coalesce(p, 0) AS p, coalesce(rep, 0) AS rep, coalesce(shared, 0) AS shared, CASE WHEN len(output_wallets) > 0 THEN least(1, coalesce(rout, 0) / len(output_wallets)) ELSE 0 END AS cont, coalesce(CASE WHEN input_btc_total > 0 THEN greatest(0, least(1, (input_btc_total - output_btc_total) / input_btc_total)) END, 0) AS red FROM tx LEFT JOIN rol ON tx.txid = rol.txid)",
    """ev AS (SELECT txid, rep, CASE WHEN cont > 0 THEN least(1, .6 * red + .4 * cont) ELSE 0 END AS peel, CASE WHEN i > 1 OR o > 1 OR p >= 4 THEN least(1, .4 * least(1, i / 5) + .4 * least(1, o / 5) + .2 * least(1, p / 10)) ELSE 0 END AS mixs,
      least(1, .7 * coalesce(rep / nullif(p, 0), 0) + .3 * least(1, shared / 5)) AS ent, (i > 0 OR o > 0)::INT * 2 AS ch FROM cas)""",
    "sc AS (SELECT *, .5 * peel + .5 * mixs AS beh, least(100, (.3 * (.5 * peel + .5 * mixs) + .2 * ent) * (1 + CASE ch WHEN 2 THEN .02 ELSE 0 END) * 100) AS risk FROM ev)",
]


@query("f22_f25_case_intelligence", f"SELECT txid, rep AS entity_repeated_wallet_count, round(peel, 4) AS peeling_evidence_score, round(mixs, 4) AS mixing_evidence_score, round(beh, 4) AS behavioral_signal, round(ent, 4) AS entity_signal, round(round(risk, 6) + 1e-8, 4) AS risk_score, {_band('round(risk, 6)')} AS risk_level FROM sc", *CASE)
def f22(spark, sf):
    rows = profile.case_rows(d.canonical(spark, sf)).withColumn("risk_score", F.col("risk_score") + 1e-8)
    return rounded(rows.select("txid", "entity_repeated_wallet_count", "peeling_evidence_score", "mixing_evidence_score", "behavioral_signal", "entity_signal", "risk_score", "risk_level"))


@query("t6_case_ranking", """SELECT txid, round(round(risk, 6) + 1e-8, 4) AS risk_score, row_number() OVER (ORDER BY round(risk, 6) DESC, beh DESC, txid::VARCHAR) AS case_rank,
  concat_ws(', ', CASE WHEN beh > 0 THEN 'behavioral=' || printf('%.3f', beh) END, CASE WHEN ent > 0 THEN 'entity=' || printf('%.3f', ent) END) AS explanation FROM sc ORDER BY case_rank LIMIT 50""", *CASE)
def t6(spark, sf):
    top = profile.case_ranking(profile.case_rows(d.canonical(spark, sf)), 50)
    return rounded(top.select("txid", (F.col("risk_score") + 1e-8).alias("risk_score"), "case_rank", "explanation"))


@query("q11_table_fingerprint", """SELECT count(*) AS n, bit_xor(h) AS xor, sum(h)::VARCHAR AS sum FROM (SELECT CAST('0x' || substr(sha256(coalesce(time_step::VARCHAR, '') || '|' || txid), 1, 13) AS BIGINT) AS h FROM steps)""")
def q11(spark, sf):
    return validate.table_fingerprint(features.temporal_features(d.steps(spark, sf)).select("txid", "time_step"))
