"""Queries over the co-spend graph as it was before each step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.operators import layout, temporal_graph, validate
from ledgerweave.plans.registry import query, rounded
from ledgerweave.plans.registry_risk import gates

_K = temporal_graph.THRESHOLDS


def _side(side: str, members: str) -> str:
    return (
        f"{side} AS (SELECT s.txid, coalesce(r, 0) AS {side}_repeated_cosponsor_count, round(coalesce(r / n, 0), 4) AS {side}_repeated_cosponsor_ratio, coalesce(d, 0) AS {side}_max_repeated_cosponsor_degree, coalesce(m, 0)::BIGINT AS {side}_max_shared_transaction_count, "
        + ", ".join(f"coalesce(c{k}, 0) AS {side}_distinct_clusters_t{k}, coalesce(s{k}, 1) AS {side}_max_cluster_size_t{k}" for k in _K)
        + f", coalesce(seen, 0) AS entity_{side}_address_count FROM steps s LEFT JOIN (SELECT txid, count(*) AS n, count(*) FILTER (WHERE degree > 0) AS r, max(degree) AS d, max(max_shared) AS m, count(*) FILTER (WHERE seen) AS seen, "
        + ", ".join(f"count(DISTINCT component_{k}) AS c{k}, max(size_{k}) AS s{k}" for k in _K)
        + f" FROM {members} JOIN steps USING (txid) JOIN states USING (address, time_step) GROUP BY txid) q ON s.txid = q.txid)"
    )


#: Components of every graph at every step by labels that fall: the plain way, beside which the halving is held.
STATES = [
    "pc AS (SELECT *, sum(n) OVER (PARTITION BY a, b ORDER BY time_step) AS upto FROM (SELECT a.address AS a, b.address AS b, time_step, count(*) AS n FROM ins a JOIN ins b ON a.txid = b.txid AND a.address < b.address JOIN steps s ON s.txid = a.txid GROUP BY ALL))",
    "act AS (SELECT k, a, b, min(time_step) AS s FROM pc JOIN (SELECT unnest([1, 2, 3]) AS k) ON upto >= k GROUP BY ALL)",
    "lk AS (SELECT k, t, a, b FROM act JOIN (SELECT DISTINCT time_step AS t FROM steps) ON s < t UNION ALL SELECT k, t, b, a FROM act JOIN (SELECT DISTINCT time_step AS t FROM steps) ON s < t)",
    "cc(k, t, node, component) USING KEY (k, t, node) AS (SELECT DISTINCT k, t, a, a FROM lk UNION SELECT l.k, l.t, l.b, min(c.component) FROM cc c JOIN lk l ON c.k = l.k AND c.t = l.t AND c.node = l.a JOIN recurring.cc r ON r.k = l.k AND r.t = l.t AND r.node = l.b WHERE c.component < r.component GROUP BY ALL)",
    "cs AS (SELECT k, t, component, count(*) AS size FROM cc GROUP BY ALL)",
    "mem AS (SELECT DISTINCT address, time_step FROM (SELECT * FROM ins UNION SELECT * FROM outs) JOIN steps USING (txid))",
    "firsts AS (SELECT address, min(time_step) AS first FROM mem GROUP BY 1)",
    "pends AS (SELECT a AS address, b AS other, time_step, upto FROM pc UNION ALL SELECT b, a, time_step, upto FROM pc)",
    "deg AS (SELECT m.address, m.time_step, count(DISTINCT other) FILTER (WHERE upto >= 2) AS degree, max(upto) AS max_shared FROM mem m JOIN pends p ON p.address = m.address AND p.time_step < m.time_step GROUP BY ALL)",
    "states AS (SELECT m.address, m.time_step, coalesce(degree, 0) AS degree, coalesce(max_shared, 0)::BIGINT AS max_shared, first < m.time_step AS seen, "
    + ", ".join(f"c{k}.component AS component_{k}, coalesce(s{k}.size, 1) AS size_{k}" for k in _K)
    + " FROM mem m JOIN firsts ON m.address = firsts.address LEFT JOIN deg ON m.address = deg.address AND m.time_step = deg.time_step "
    + " ".join(f"LEFT JOIN cc c{k} ON c{k}.k = {k} AND c{k}.t = m.time_step AND c{k}.node = m.address LEFT JOIN cs s{k} ON s{k}.k = {k} AND s{k}.t = m.time_step AND s{k}.component = c{k}.component" for k in _K)
    + ")",
]
FEATURES = [*STATES, _side("input", "ins"), _side("output", "outs")]


def graph_features(spark, sf):
    return temporal_graph.graph_features(d.steps(spark, sf), d.tx_inputs(spark, sf), d.tx_outputs(spark, sf))


@query("g3_g6_temporal_graph_features", "SELECT time_step, input.*, output.* EXCLUDE (txid) FROM steps JOIN input USING (txid) JOIN output USING (txid)", *FEATURES)
def g6(spark, sf):
    """All 22 figures of both sides at thresholds 1 to 3, as they were before each transaction's step."""
    return rounded(graph_features(spark, sf))


@query("w9_first_seen_states", "SELECT address, time_step, degree, max_shared, seen, size_1, size_2, size_3 FROM states JOIN firsts USING (address) WHERE time_step = first", *STATES)
def w9(spark, sf):
    return temporal_graph.first_states(d.steps(spark, sf), d.tx_inputs(spark, sf), d.tx_outputs(spark, sf)).select("address", "time_step", "degree", "max_shared", "seen", "size_1", "size_2", "size_3")


_GATES = {c: "0" for s in ("input", "output") for c in (f"{s}_repeated_cosponsor_count", f"{s}_max_repeated_cosponsor_degree", f"{s}_max_shared_transaction_count", f"entity_{s}_address_count", *(f"{s}_distinct_clusters_t{k}" for k in _K))}
_GATES |= {f"{s}_max_cluster_size_t{k}": "1" for s in ("input", "output") for k in _K}


def first_step_gates(features):
    """Rows of the first step whose figures are not those of an empty history."""
    first = features.agg(F.min("time_step").alias("__first"))
    rows = features.join(F.broadcast(first), features["time_step"] == first["__first"])  # one row
    return validate.checks(rows, {c: F.col(c) == int(v) for c, v in _GATES.items()}, ["txid"])


@query("q9_first_step_state", gates("(SELECT * FROM steps JOIN input USING (txid) JOIN output USING (txid) WHERE time_step = (SELECT min(time_step) FROM steps))", {c: f"{c} = {v}" for c, v in _GATES.items()}, "txid"), *FEATURES)
def q9(spark, sf):
    """All transactions of the first step; a figure is made of strictly earlier steps, so none of a later step is needed for it."""
    steps = d.steps(spark, sf)
    first = steps.agg(F.min("time_step").alias("time_step"))
    steps = steps.join(F.broadcast(first), "time_step").select("txid", "time_step")  # one row
    return first_step_gates(temporal_graph.graph_features(steps, d.tx_inputs(spark, sf), d.tx_outputs(spark, sf)))


@query("g10_address_history", """SELECT address, row_number() OVER o AS position, time_step, txid, role, time_step - lag(time_step) OVER o AS steps_since FROM (
  SELECT address, time_step, txid, role FROM (SELECT *, 'INPUT' AS role FROM ins UNION ALL SELECT *, 'OUTPUT' FROM outs) JOIN steps USING (txid)) WINDOW o AS (PARTITION BY address ORDER BY time_step, txid::VARCHAR, role)""")
def g10(spark, sf):
    """Every address's appearances in order."""
    return layout.address_history(layout.address_roles(d.steps(spark, sf), d.tx_inputs(spark, sf), d.tx_outputs(spark, sf)))
