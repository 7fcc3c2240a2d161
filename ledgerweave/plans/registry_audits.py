"""Audits against independent recomputation, and the alert reports over the channels of the engine's own models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.operators import audits, behavior, lookup, ml, risk, trees
from ledgerweave.operators.kept import kept
from ledgerweave.plans import registry_models, registry_more
from ledgerweave.plans.registry import CHAINS, PEELING, _values, chains, made_once, mixing, peeling, query, rounded
from ledgerweave.plans.registry_risk import G, RISK, alerts, fused, given_channels
from ledgerweave.plans.registry_risk import _graph as graph_edges


def _counts(checks: dict[str, str]) -> str:
    """SQL of one row a check; each value is a query of one number."""
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({v})::BIGINT AS failures" for k, v in checks.items())


_LINKS = "lk AS (SELECT DISTINCT previous, next FROM (SELECT unnest(chain[:-2])::BIGINT AS previous, unnest(chain[2:])::BIGINT AS next FROM ch WHERE len(chain) > 1))"
_PROVED = "pv AS (SELECT l.*, a.time_step AS s, b.time_step AS t, v.value AS x, w.value AS y FROM lk l LEFT JOIN steps a ON a.txid = previous LEFT JOIN steps b ON b.txid = next LEFT JOIN vals v ON v.txid = previous LEFT JOIN vals w ON w.txid = next)"


@query("q1_chains_replayed", _counts({
    "one_chain_each": "SELECT count(*) - count(DISTINCT txid) FROM ch", "length": "SELECT count(*) FROM ch WHERE NOT len(chain) BETWEEN 1 AND 10", "ends_at_itself": "SELECT count(*) FROM ch WHERE chain[-1] <> txid::VARCHAR",
    "no_member_twice": "SELECT count(*) FROM ch WHERE len(list_distinct(chain)) <> len(chain)", "every_transaction": "SELECT count(*) FROM steps WHERE txid NOT IN (SELECT txid FROM ch)", "known_transaction": "SELECT count(*) FROM ch WHERE txid NOT IN (SELECT txid FROM steps)",
    "members_known": "SELECT count(*) FROM pv WHERE s IS NULL OR t IS NULL", "forward_in_time": "SELECT count(*) FROM pv WHERE NOT coalesce(t > s, false)", "within_the_window": "SELECT count(*) FROM pv WHERE NOT coalesce(t - s <= 10, false)",
    "value_is_peeled": "SELECT count(*) FROM pv WHERE NOT coalesce(x > 0 AND (x - y) / x BETWEEN .05 AND .95, false)",
    "common_address": "SELECT count(*) FROM lk WHERE NOT EXISTS (SELECT 1 FROM raw a JOIN raw b ON a.output_address = b.input_address WHERE a.txid = lk.previous AND b.txid = lk.next)",
    "begins_at_the_beginning": "SELECT count(*) FROM ch WHERE len(chain) < 10 AND chain[1]::BIGINT IN (SELECT txid FROM ch WHERE len(chain) > 1)",
}), *CHAINS, "vals AS (SELECT txid, round(sum(due), 4) AS value FROM raw GROUP BY txid)", _LINKS, _PROVED)
def q1(spark, sf):
    """Every link of every longest chain, proved again from the address rows."""
    return audits.replay_chains(chains(spark, sf).select("txid", "chain"), d.steps(spark, sf), d.address_rows(spark, sf), _values(spark, sf))


_MIX = "rx AS (SELECT s.txid, count(DISTINCT input_address) AS a, count(DISTINCT output_address) AS b FROM steps s LEFT JOIN raw ON s.txid = raw.txid GROUP BY s.txid), rm AS (SELECT rx.txid AS t, a, b, mixing.* FROM rx FULL JOIN mixing ON rx.txid = mixing.txid)"
_FLAGS = {"fan_in_flag": "a >= 5", "fan_out_flag": "b >= 5", "balance_flag": "a > 0 AND 5 * b >= 2 * a AND 2 * b <= 5 * a", "participant_flag": "a + b >= 10", "high_participant_flag": "a + b >= 25"}


@query("q2_q13_mixing_replayed", _counts({k: f"SELECT count(*) FROM rm WHERE NOT coalesce({v}, false)" for k, v in {
    "every_transaction": "t IS NOT NULL AND txid IS NOT NULL", "input_count": "input_count = a", "output_count": "output_count = b", **{k: f"{k} = ({v})" for k, v in _FLAGS.items()}, "mixing_candidate": "mixing_candidate = (" + " AND ".join(f"({v})" for v in list(_FLAGS.values())[:4]) + ")",
    "mixing_evidence_score": "abs(100 * mixing_evidence_score - (" + " + ".join(f"{w} * ({v})::INT" for v, w in zip(_FLAGS.values(), (25, 25, 20, 15, 10), strict=True)) + " + 5 * (" + " AND ".join(f"({v})" for v in list(_FLAGS.values())[:4]) + ")::INT)) < 1e-6",
}.items()}), _MIX)
def q2(spark, sf):
    return audits.replay_mixing(mixing(spark, sf), d.steps(spark, sf), d.address_rows(spark, sf))


@query("q3_fusion_replayed", _counts({
    "every_transaction": "SELECT count(*) FROM peel p FULL JOIN mixing m ON p.txid = m.txid WHERE p.txid IS NULL OR m.txid IS NULL", "score": "SELECT count(*) FROM bf WHERE abs(2 * s - p - m) >= 2e-6",
    "level": "SELECT count(*) FROM bf WHERE s NOT BETWEEN 0 AND 1", "signal_count": "SELECT count(*) FROM bf WHERE n NOT BETWEEN 0 AND 2",
}), *PEELING, "bf AS (SELECT round(.5 * peeling_evidence_score + .5 * mixing_evidence_score, 6) AS s, peeling_evidence_score AS p, mixing_evidence_score AS m, peeling_candidate::INT + mixing_candidate::INT AS n FROM peel JOIN mixing ON peel.txid = mixing.txid)")
def q3(spark, sf):
    peels = kept(peeling(spark, sf).select("txid", "time_step", "peeling_evidence_score", "peeling_candidate"))
    mixes = kept(mixing(spark, sf).select("txid", "mixing_evidence_score", "mixing_candidate"))
    return audits.replay_fusion(behavior.behavioral_evidence(peels, mixes), peels, mixes)


@query("q8_j21_alerts_replayed", _counts({
    "every_transaction": "SELECT count(*) FROM fused f FULL JOIN alerts a ON f.txid = a.txid WHERE f.txid IS NULL OR a.txid IS NULL",
    "risk_score": "SELECT count(*) FROM fused f JOIN alerts a ON f.txid = a.txid WHERE abs(a.risk_score - least(100, greatest(0, 100 * (.15 * f.ml_signal + .2 * f.anomaly_signal + .3 * f.behavioral_signal + .2 * f.entity_signal + .15 * f.network_signal) * (1 + [0, 0, .02, .04, .06, .08][f.ml_available::INT + f.anomaly_available::INT + f.behavioral_available::INT + f.entity_available::INT + f.network_available::INT + 1])))) >= 1e-5",
    "alert_priority": "SELECT count(*) FROM alerts WHERE alert_priority <> CASE WHEN risk_score >= 80 THEN 'VERY_HIGH' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MODERATE' WHEN risk_score >= 20 THEN 'GUARDED' ELSE 'LOW' END",
    "active_rank": "SELECT count(*) FROM alerts WHERE (alert_status = 'ACTIVE') <> (active_alert_rank IS NOT NULL)", "ranks_in_sequence": "SELECT count(*) - count(DISTINCT investigation_rank) + (max(investigation_rank) <> count(*))::INT + (min(investigation_rank) <> 1)::INT FROM alerts",
    "scores_fall_with_rank": "SELECT count(*) FROM alerts a JOIN alerts b ON b.investigation_rank = a.investigation_rank + 1 WHERE b.risk_score > a.risk_score",
}), *RISK)
def q8(spark, sf):
    return audits.replay_alerts(alerts(spark, sf), given_channels(spark, sf))


@query("d12_unknown_ends", _counts({
    "other": "SELECT count(*) FROM ends WHERE split_part(node_id, ':', 1) NOT IN ('tx', 'wallet', 'ip')", "tx": "SELECT count(*) FROM ends WHERE node_id LIKE 'tx:%' AND node_id NOT IN (SELECT 'tx:' || o_orderkey FROM orders)",
    "wallet": "SELECT count(*) FROM ends WHERE node_id LIKE 'wallet:%' AND node_id NOT IN (SELECT 'wallet:W' || l_partkey FROM lineitem UNION SELECT 'wallet:W' || l_suppkey FROM lineitem)", "ip": "SELECT count(*) FROM ends WHERE node_id LIKE 'ip:%' AND node_id NOT IN (SELECT 'ip:' || src_ip FROM obs UNION SELECT 'ip:' || dst_ip FROM obs)",
}), *G, "ends AS (SELECT source AS node_id FROM ge UNION SELECT target FROM ge)")
def d12(spark, sf):
    """Ends of the graph's edges that the source tables do not have."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("node_id")
    rows, seen = d.address_rows(spark, sf), d.observations(spark, sf)
    known = {"tx": d.table(spark, sf, "orders").select(name("tx", "o_orderkey")), "wallet": rows.select(name("wallet", "input_address")).union(rows.select(name("wallet", "output_address"))).distinct(), "ip": seen.select(name("ip", "src_ip")).union(seen.select(name("ip", "dst_ip"))).distinct()}
    return audits.unknown_ends(graph_edges(spark, sf), known)


# --- reports over the models' channels; SQL cannot follow the models -------------------------------------------


@made_once
def model_alerts(spark, sf):
    return risk.ranked_alerts(risk.scores(fused(spark, sf)))


@query("a14_alert_summary_of_models")
def a14(spark, sf):
    return risk.summary(model_alerts(spark, sf))


@query("a15_alerts_by_step_of_models")
def a15(spark, sf):
    return risk.by_step(model_alerts(spark, sf))


@query("q8_alerts_of_models_replayed")
def q8_models(spark, sf):
    return audits.replay_alerts(model_alerts(spark, sf), fused(spark, sf))


@query("t2_f15_top_alerts_of_models")
def t2(spark, sf):
    top = risk.top_risk(model_alerts(spark, sf), 100)
    return rounded(risk.explanation(top).select("txid", "time_step", "investigation_rank", "risk_score", "alert_priority", "explanation"))


@query("t10_top_anomaly_scores")
def t10(spark, sf):
    """The hundred transactions with the highest isolation score."""
    data = registry_more.dataset(spark, sf).checkpoint()
    found = ml.isolation_scores(data, "txid", registry_more.FEATURES, data.filter("part = 'train'"))
    return rounded(found.select("txid", "anomaly_score", "decision", "flag").orderBy(F.desc("anomaly_score"), "txid").limit(100), 6)


@query("j23_p35_reports_of_models")
def j23(spark, sf):
    """A report for each of the hundred top alerts: alert, risk, the model's ten largest contributions, and the fixed disclaimer."""
    top = risk.top_risk(model_alerts(spark, sf), 100).select("txid", "risk_score", "alert_priority", "investigation_rank").checkpoint()
    filled, model = registry_models.fitted(spark, sf, registry_models.DEEP)
    why = trees.contributions(filled.join(top.select("txid"), "txid", "left_semi"), "txid", model)
    rows = top.join(why, "txid").select("txid", F.round("risk_score", 4).alias("risk_score"), "alert_priority", "investigation_rank", "predicted", F.transform("top", lambda t: F.struct(t["feature"].alias("feature"), F.round(t["contribution"], 6).alias("contribution"))).alias("contributions"))
    return lookup.report(rows, ["txid", "risk_score", "alert_priority", "investigation_rank", "predicted", "contributions"], "a priority for review, not proof")
