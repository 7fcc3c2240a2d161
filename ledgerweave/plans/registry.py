"""Every registered query of the transaction domain: its name, its plan and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.operators import behavior, entity, features, graph, network, risk
from ledgerweave.plans.sql import domain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = domain(sql, *ctes)
        return f

    return register


#: Tables that several queries read, by application, function and the versions of the input files; at most so many are kept.
_MADE: dict[tuple, tuple[DataFrame, str]] = {}
MOST_MADE = 8


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, length and time of change of everything in a folder."""
    files, target = _files(spark, sf_dir)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(target)))


def forget(spark: SparkSession, keep: int = 0) -> None:
    """Deletes all but the ``keep`` newest of the tables that :func:`made_once` holds."""
    while len(_MADE) > keep:
        _, path = _MADE.pop(next(iter(_MADE)))
        try:
            files, target = _files(spark, path)
            files.delete(target, True)
        except Exception:  # the application that made it may be gone, and its folder with it
            pass


def made_once(make: Query) -> Query:
    """A table that several queries read is written to the shared folder by the first of them and read by the others.

    It is made again when a file below ``sf_dir`` changes, and deleted when
    ``MOST_MADE`` newer ones are held, by :func:`forget`, or as the session's folder is.
    """

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__, _versions(spark, sf_dir))
        if key not in _MADE:
            df = make(spark, sf_dir)
            folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
            if folder is None:
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = f"{folder.rstrip('/')}/made-{make.__name__}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            forget(spark, MOST_MADE - 1)
            _MADE[key] = (spark.read.schema(df.schema).parquet(path), path)
        _MADE[key] = _MADE.pop(key)  # what is read is the newest, so a table that is being made from it does not lose it
        return _MADE[key][0]

    get.__doc__ = make.__doc__
    return get


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- flagship -------------------------------------------------------------------------------------------------

MIXING = "SELECT * FROM mixing"


def mixing(spark: SparkSession, sf: str) -> DataFrame:
    return behavior.mixing_indicators(behavior.side_counts(d.steps(spark, sf), d.tx_inputs(spark, sf), d.tx_outputs(spark, sf)))


@query("f8_mixing_top", "SELECT txid, time_step, participant_count, mixing_evidence_score FROM mixing ORDER BY mixing_evidence_score DESC, participant_count DESC, txid LIMIT 100")
def f8_mixing_top(spark, sf):
    """The hundred transactions with the strongest mixing indicators."""
    order = [F.desc("mixing_evidence_score"), F.desc("participant_count"), F.col("txid")]
    return mixing(spark, sf).select("txid", "time_step", "participant_count", "mixing_evidence_score").orderBy(*order).limit(100)


query("f8_mixing_indicators", MIXING)(mixing)

# --- canonical table and features ------------------------------------------------------------------------------

_CANON = [f"{s}_btc_{k}" for s in ("input", "output") for k in ("min", "max", "mean", "median", "total")]


@query("p29_canonical_transactions", "SELECT txid, time_step, label, round(total_btc, 4) AS total_btc, round(fee_btc, 4) AS fee_btc, input_address_count, output_address_count, has_address_relationships, "
       + ", ".join(f"round({c} + 1e-7, 3) AS {c}" for c in _CANON) + ", array_to_string(input_wallets, '|') AS input_wallets, array_to_string(output_wallets, '|') AS output_wallets FROM tx")
def canonical(spark, sf):
    tx = d.canonical(spark, sf).select("txid", "time_step", "label", "total_btc", "fee_btc", "input_address_count", "output_address_count", "has_address_relationships", *_CANON, "input_wallets", "output_wallets")
    return rounded(tx.select(*(F.round(F.col(c) + 1e-7, 3).alias(c) if c in _CANON else F.col(c) for c in tx.columns)).withColumn("input_wallets", F.concat_ws("|", "input_wallets")).withColumn("output_wallets", F.concat_ws("|", "output_wallets")))


def _log1p(x: str) -> str:
    return f"ln(1 + greatest({x}, 0))"


_F1 = {
    "amount_features_missing": "(input_btc_total IS NULL)::INT",
    "log_total_btc": _log1p("total_btc"),
    "log_fee_btc": "ln(1 + coalesce(greatest(fee_btc, 0), 0))",
    "log_input_total": "ln(1 + coalesce(greatest(input_btc_total, 0), 0))",
    "log_output_total": "ln(1 + coalesce(greatest(output_btc_total, 0), 0))",
    "total_address_count": "input_address_count + output_address_count",
    "address_imbalance": "abs(input_address_count - output_address_count)",
    "input_output_address_ratio": "input_address_count / nullif(output_address_count, 0)",
    "output_input_address_ratio": "output_address_count / nullif(input_address_count, 0)",
    "btc_flow_imbalance": "abs(input_btc_total - output_btc_total)",
    "output_input_btc_ratio": "output_btc_total / nullif(input_btc_total, 0)",
    "fee_to_total_ratio": "fee_btc / nullif(total_btc, 0)",
    "fee_to_input_ratio": "fee_btc / nullif(input_btc_total, 0)",
    "input_btc_range": "input_btc_max - input_btc_min",
    "output_btc_range": "output_btc_max - output_btc_min",
    "input_max_share": "input_btc_max / nullif(input_btc_total, 0)",
    "output_max_share": "output_btc_max / nullif(output_btc_total, 0)",
    "input_mean_median_ratio": "input_btc_mean / nullif(input_btc_median, 0)",
    "output_mean_median_ratio": "output_btc_mean / nullif(output_btc_median, 0)",
    "transaction_data_missing": "(total_btc IS NULL OR fee_btc IS NULL OR input_address_count IS NULL OR output_address_count IS NULL)::INT",
    "input_output_value_ratio": "input_btc_total / nullif(output_btc_total, 0)",
    "input_output_value_difference": "input_btc_total - output_btc_total",
}
for _s in ("input", "output"):
    _F1 |= {
        f"{_s}_count_log1p": f"ln(1 + coalesce({_s}_address_count, 0))",
        f"{_s}_value_range_log1p": f"CASE WHEN {_s}_btc_max IS NOT NULL THEN ln(1 + greatest({_s}_btc_max - {_s}_btc_min, 0)) ELSE 0 END",
        f"{_s}_max_mean_ratio": f"{_s}_btc_max / nullif({_s}_btc_mean, 0)",
        f"{_s}_median_share": f"{_s}_btc_median / nullif({_s}_btc_total, 0)",
    }


@query("f1_transaction_features", "SELECT txid, " + ", ".join(f"round({v}, 4) AS {k}" if not k.endswith("_missing") else f"{v} AS {k}" for k, v in _F1.items()) + " FROM tx")
def f1(spark, sf):
    return rounded(features.transaction_features(d.canonical(spark, sf)))


@query("f4_temporal_features", """SELECT txid, t.time_step, n AS time_step_transaction_count, round(n / m, 4) AS activity_ratio, round(n - m, 4) AS activity_deviation, round(ln(1 + n), 4) AS log_activity,
  round(p, 4) AS normalized_time, (p <= .25)::INT AS is_early_period, (p >= .75)::INT AS is_late_period FROM steps t JOIN
  (SELECT time_step, n, avg(n) OVER () AS m, CASE WHEN max(time_step) OVER () > min(time_step) OVER () THEN (time_step - min(time_step) OVER ())::DOUBLE / (max(time_step) OVER () - min(time_step) OVER ()) ELSE 0 END AS p
   FROM (SELECT time_step, count(*) AS n FROM steps GROUP BY 1)) c ON t.time_step = c.time_step""")
def f4(spark, sf):
    return rounded(features.temporal_features(d.steps(spark, sf)))


@query("f5_wallet_features", """SELECT txid, k AS wallet_overlap_count, round(CASE WHEN i > 0 THEN k / i ELSE 0 END, 4) AS input_overlap_ratio, round(CASE WHEN o > 0 THEN k / o ELSE 0 END, 4) AS output_overlap_ratio,
  round(CASE WHEN i + o - k > 0 THEN k / (i + o - k) ELSE 0 END, 4) AS wallet_jaccard, i + o - k AS unique_wallet_count, round(ln(1 + i + o - k), 4) AS log_unique_wallet_count, (k > 0)::INT AS has_wallet_overlap
  FROM (SELECT txid, len(input_wallets) AS i, len(output_wallets) AS o, len(list_intersect(input_wallets, output_wallets)) AS k FROM tx)""")
def f5(spark, sf):
    return rounded(features.wallet_features(d.canonical(spark, sf)))


for _side, _view, _members in (("input", "ins", d.tx_inputs), ("output", "outs", d.tx_outputs)):

    @query(f"w1_wallet_history_{_side}", f"""SELECT s.txid, coalesce(q.s, 0)::BIGINT AS {_side}_wallet_prior_frequency_sum, round(coalesce(a, 0), 4) AS {_side}_wallet_prior_frequency_mean, coalesce(m, 0)::BIGINT AS {_side}_wallet_prior_frequency_max,
      coalesce(seen, 0) AS {_side}_wallets_seen_before, round(coalesce(seen / k, 0), 4) AS {_side}_wallet_reuse_ratio, coalesce(rmin, 0) AS {_side}_wallet_recency_min, round(coalesce(rmean, 0), 4) AS {_side}_wallet_recency_mean, coalesce(rmax, 0) AS {_side}_wallet_recency_max
      FROM steps s LEFT JOIN (SELECT u.txid, sum(prior) AS s, avg(prior) AS a, max(prior) AS m, count(*) FILTER (WHERE prior > 0) AS seen, count(*) AS k, min(rec) AS rmin, avg(rec) AS rmean, max(rec) AS rmax
        FROM {_view} u JOIN steps t ON u.txid = t.txid JOIN (SELECT address, time_step, coalesce(sum(n) OVER (PARTITION BY address ORDER BY time_step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
          time_step - lag(time_step) OVER (PARTITION BY address ORDER BY time_step) AS rec FROM (SELECT address, time_step, count(*) AS n FROM {_view} JOIN steps USING (txid) GROUP BY ALL)) h
        ON h.address = u.address AND h.time_step = t.time_step GROUP BY u.txid) q ON s.txid = q.txid""")
    def _w1(spark, sf, side=_side, members=_members):
        return rounded(features.wallet_history(d.steps(spark, sf), members(spark, sf), side))


# --- address graph and entities --------------------------------------------------------------------------------


def _edges(spark, sf):
    return entity.address_edges(d.address_rows(spark, sf))


@query("a1_j3_address_edges", "SELECT e.source, e.target, e.observation_count, (e.source = e.target)::INT AS is_self_loop, (e.source <> e.target AND r.source IS NOT NULL)::INT AS has_reciprocal_edge FROM edges e LEFT JOIN edges r ON e.source = r.target AND e.target = r.source")
def a1(spark, sf):
    return _edges(spark, sf)


@query("a2_j4_address_nodes", """SELECT address, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o * n)::BIGINT AS out_observations, sum(i * n)::BIGINT AS in_observations, sum(s * n)::BIGINT AS self_loop_observations, sum(o + i)::BIGINT AS total_degree FROM
  (SELECT source AS address, (source <> target)::INT AS o, 0 AS i, (source = target)::INT AS s, observation_count AS n FROM edges UNION ALL SELECT target, 0, (source <> target)::INT, 0, observation_count FROM edges) GROUP BY address""")
def a2(spark, sf):
    return entity.address_nodes(_edges(spark, sf))


@query("a3_multi_input", "SELECT txid, count(DISTINCT address) AS input_count FROM ins GROUP BY txid HAVING count(DISTINCT address) > 1")
def a3(spark, sf):
    return entity.multi_input_transactions(d.tx_inputs(spark, sf))


def _pairs(spark, sf):
    return entity.cospend_pairs(d.address_rows(spark, sf).select("txid", F.col("input_address").alias("address")))


@query("j5_a4_cospend_pairs", "SELECT * FROM pairs")
def j5(spark, sf):
    return _pairs(spark, sf)


DEGREE = "degree AS (SELECT address, count(*) FILTER (WHERE shared_count >= 2) AS repeated_degree, max(shared_count) AS max_shared_count FROM (SELECT a AS address, shared_count FROM pairs UNION ALL SELECT b, shared_count FROM pairs) GROUP BY address)"


@query("a5_cospend_degree", "SELECT * FROM degree", DEGREE)
def a5(spark, sf):
    return entity.cospend_degree(_pairs(spark, sf))


def _cluster_ctes(*thresholds: int) -> list[str]:
    """Least labels handed on along links until none changes, for the addresses of both sides."""
    out = ["bothaddr AS (SELECT address FROM ins UNION SELECT address FROM outs)"]
    for k in thresholds:
        out += [
            f"link{k} AS (SELECT a, b FROM pairs WHERE shared_count >= {k} UNION ALL SELECT b, a FROM pairs WHERE shared_count >= {k})",
            f"comp{k}(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM link{k} UNION SELECT l.b, min(c.component) FROM comp{k} c JOIN link{k} l ON c.node = l.a JOIN recurring.comp{k} r ON r.node = l.b WHERE c.component < r.component GROUP BY l.b)",
            f"clus{k} AS (SELECT address, coalesce(component, address) AS cluster FROM addr LEFT JOIN comp{k} ON address = node)",
            f"clusn{k} AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM clus{k})",
            f"bothn{k} AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM (SELECT address, coalesce(component, address) AS cluster FROM bothaddr LEFT JOIN comp{k} ON address = node))",
        ]
    return out


def _clusters(spark, sf, least):
    return entity.cospend_clusters(_pairs(spark, sf), d.tx_inputs(spark, sf).select("address").distinct(), least)


def _at_threshold(least: int) -> None:
    ctes = _cluster_ctes(least)

    @query(f"g2_cospend_clusters_{least}", f"SELECT address, cluster, cluster_size, round(ln(1 + cluster_size), 6) AS log_size FROM clusn{least}", *ctes)
    def clusters(spark, sf):
        return _clusters(spark, sf, least)

    @query(f"a8_cluster_report_{least}", f"SELECT count(*) AS components, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS non_singleton_addresses FROM (SELECT cluster, count(*) AS n FROM clus{least} GROUP BY cluster)", *ctes)
    def report(spark, sf):
        return entity.cluster_report(_clusters(spark, sf, least))

    name = "j6_entity_evidence" if least == 3 else f"j6_entity_evidence_{least}"

    @query(name, f"SELECT addr.address, coalesce(repeated_degree, 0) AS repeated_degree, coalesce(max_shared_count, 0) AS max_shared_count, cluster_size FROM addr LEFT JOIN degree ON addr.address = degree.address JOIN clusn{least} c ON addr.address = c.address", DEGREE, *ctes)
    def evidence(spark, sf):
        addresses = d.tx_inputs(spark, sf).select("address").distinct()
        return entity.entity_evidence(addresses, entity.cospend_degree(_pairs(spark, sf)), _clusters(spark, sf, least))


for _least in (1, 2, 3):
    _at_threshold(_least)


G1 = [
    "glink AS (SELECT source AS a, target AS b FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target)",
    "gnode AS (SELECT source AS address FROM edges UNION SELECT target FROM edges)",
    "gcomp(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM glink UNION SELECT l.b, min(c.component) FROM gcomp c JOIN glink l ON c.node = l.a JOIN recurring.gcomp r ON r.node = l.b WHERE c.component < r.component GROUP BY l.b)",
    "groot AS (SELECT address, coalesce(component, address) AS root FROM gnode LEFT JOIN gcomp ON address = node)",
    "gnum AS (SELECT address, dense_rank() OVER (ORDER BY root) AS cluster_id FROM groot)",
    "gdeg AS (SELECT n.address, (SELECT count(DISTINCT target) FROM edges e WHERE e.source = n.address AND e.target <> n.address) AS o, (SELECT count(DISTINCT source) FROM edges e WHERE e.target = n.address AND e.source <> n.address) AS i FROM gnode n)",
]


@query("g1_a7_entity_clusters", "SELECT cluster_id, count(*) AS cluster_size, sum(o)::BIGINT AS out_degree_sum, sum(i)::BIGINT AS in_degree_sum, max(o + i) AS total_degree_max, (count(*) = 1)::INT AS is_singleton, round(ln(1 + count(*)), 6) AS log_cluster_size FROM gnum JOIN gdeg USING (address) GROUP BY cluster_id", *G1)
def g1(spark, sf):
    nodes = entity.address_nodes(_edges(spark, sf))
    return entity.cluster_summary(entity.entity_clusters(nodes, _edges(spark, sf)), nodes)


def _side_sql(side: str, members: str) -> str:
    """A side's evidence: entB rolled up to the transaction."""
    per = ", ".join(f"count(DISTINCT c{k}) AS d{k}, max(s{k}) AS s{k}" for k in (1, 2, 3))
    return (
        f"{side} AS (SELECT s.txid, coalesce(rep, 0) AS {side}_repeated_addresses, round(coalesce(rep / n, 0), 6) AS {side}_repeated_ratio, coalesce(deg, 0) AS {side}_repeated_degree_max, coalesce(shared, 0) AS {side}_shared_count_max, "
        + ", ".join(f"coalesce(d{k}, 0) AS {side}_distinct_clusters_t{k}, coalesce(s{k}, 0) AS {side}_cluster_size_max_t{k}" for k in (1, 2, 3))
        + f" FROM steps s LEFT JOIN (SELECT txid, count(*) AS n, count(*) FILTER (WHERE repeated_degree > 0) AS rep, max(repeated_degree) AS deg, max(max_shared_count) AS shared, {per} FROM {members} m LEFT JOIN entb ON m.address = entb.address GROUP BY txid) q ON s.txid = q.txid)"
    )


ENT = [
    *_cluster_ctes(1, 2, 3),
    "entb AS (SELECT b.address, coalesce(repeated_degree, 0) AS repeated_degree, coalesce(max_shared_count, 0) AS max_shared_count, x1.cluster AS c1, x1.cluster_size AS s1, x2.cluster AS c2, x2.cluster_size AS s2, x3.cluster AS c3, x3.cluster_size AS s3 "
    "FROM bothaddr b LEFT JOIN degree ON b.address = degree.address JOIN bothn1 x1 ON b.address = x1.address JOIN bothn2 x2 ON b.address = x2.address JOIN bothn3 x3 ON b.address = x3.address)",
    _side_sql("input", "ins"),
    _side_sql("output", "outs"),
]


@made_once
def side_lists(spark, sf) -> DataFrame:
    """txid, inputs, outputs: the distinct addresses of both sides, sorted, of transactions that have any."""
    return entity.side_lists(d.address_rows(spark, sf))


@made_once
def entity_sides(spark, sf) -> DataFrame:
    """Both sides' evidence with clusters at thresholds 1, 2 and 3, beside time_step and both sides' numbers of addresses."""
    lists = side_lists(spark, sf)
    evidence = entity.address_evidence(lists, (1, 2, 3))
    return entity.sides_evidence(d.steps(spark, sf), lists, evidence, (1, 2, 3))


@query("j7_transaction_entity_evidence", "SELECT * FROM input JOIN output USING (txid)", DEGREE, *ENT)
def j7(spark, sf):
    return entity_sides(spark, sf).drop("time_step", "input_address_count", "output_address_count")


def _shifted(df: DataFrame) -> DataFrame:
    """Spans are whole microseconds, so their fourth decimal is often a tie; both engines round it up."""
    return df.withColumn("span_seconds", F.col("span_seconds") + 1e-7)


# --- network --------------------------------------------------------------------------------------------------


def _matched(spark, sf):
    return network.correlate(d.observations(spark, sf), d.steps(spark, sf)).filter("matched")


@query("j10_network_correlation", "SELECT obs.*, time_step, time_step IS NOT NULL AS matched, CASE WHEN time_step IS NULL THEN 'UNMATCHED' ELSE 'TXID_EXACT' END AS match_type FROM obs LEFT JOIN steps ON obs.txid = steps.txid")
def j10(spark, sf):
    return network.correlate(d.observations(spark, sf), d.steps(spark, sf))


@query("w3_observation_context", """SELECT network_event_id, txid, row_number() OVER o AS observation_sequence, count(*) OVER p AS observation_count, row_number() OVER o = 1 AS is_first_observation, row_number() OVER o = count(*) OVER p AS is_last_observation,
  round(coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER o, 0) / 1e6, 3) AS seconds_since_previous, count(*) OVER p > 1 AS is_repeated FROM matched WINDOW p AS (PARTITION BY txid), o AS (PARTITION BY txid ORDER BY timestamp, network_event_id)""")
def w3(spark, sf):
    return network.observation_context(_matched(spark, sf))


@query("a10_temporal_statistics", "SELECT * REPLACE (round(span_seconds + 1e-7, 4) AS span_seconds) FROM stats")
def a10(spark, sf):
    return rounded(_shifted(network.temporal_statistics(_matched(spark, sf))))


@query("f11_temporal_evidence", "SELECT * REPLACE (round(span_seconds + 1e-7, 4) AS span_seconds, round(temporal_observation_evidence, 4) AS temporal_observation_evidence) FROM evidl")
def f11(spark, sf):
    return rounded(_shifted(network.temporal_evidence(network.temporal_statistics(_matched(spark, sf)))))


@query("j12_transaction_network_features", """SELECT s.txid, s.time_step, coalesce(observation_count, 0) AS observation_count, coalesce(unique_src_ips, 0) AS unique_src_ips, coalesce(unique_dst_ips, 0) AS unique_dst_ips, coalesce(unique_endpoints, 0) AS unique_endpoints, coalesce(unique_asns, 0) AS unique_asns,
  coalesce(unique_countries, 0) AS unique_countries, round(coalesce(span_seconds, 0) + 1e-7, 4) AS span_seconds, round(coalesce(temporal_observation_evidence, 0), 4) AS temporal_observation_evidence, coalesce(temporal_evidence_level, 'NONE') AS temporal_evidence_level, observation_count IS NOT NULL AS network_observation_available FROM steps s LEFT JOIN evidl ON s.txid = evidl.txid""")
def j12(spark, sf):
    return rounded(_shifted(network.transaction_network_features(d.steps(spark, sf), network.temporal_evidence(network.temporal_statistics(_matched(spark, sf))))))


@query("j13_best_intelligence", "SELECT ip, network_type, provider, confidence, source FROM best")
def j13(spark, sf):
    return network.best_intelligence(d.feed(spark, sf))


@query("a13_feed_conflicts", "SELECT ip, count(DISTINCT network_type) AS types FROM feed GROUP BY ip HAVING count(DISTINCT network_type) > 1")
def a13(spark, sf):
    return network.feed_conflicts(d.feed(spark, sf))


def _ev(side: str, kinds: str) -> str:
    return f"CASE WHEN {side}_network_type IN ({kinds}) THEN {side}_confidence ELSE 0 END"


_FAM = {k: ", ".join(f"'{x}'" for x in v) for k, v in network.FAMILIES.items()}


@query("f20_classified_observations", "SELECT *, " + ", ".join(f"{_ev(s, k)} AS {s}_{f}_evidence" for s in ("src", "dst") for f, k in _FAM.items()) + " FROM cls")
def f20(spark, sf):
    return network.classified_observations(d.observations(spark, sf), d.feed(spark, sf))


INTEL = "intel AS (SELECT txid, count(*) AS network_intelligence_observation_count, " + ", ".join(
    f"greatest(max({_ev('src', k)}), max({_ev('dst', k)})) AS {f}_evidence, count(*) FILTER (WHERE src_network_type IN ({k}) OR dst_network_type IN ({k})) AS {f}_observation_count" for f, k in _FAM.items()
) + ", coalesce(greatest(max(src_confidence), max(dst_confidence)), 0) AS network_intelligence_confidence, " + ", ".join(
    f"len(list_distinct(list_concat(list(src_{c}) FILTER (WHERE src_network_type <> 'UNKNOWN' AND src_{c} <> ''), list(dst_{c}) FILTER (WHERE dst_network_type <> 'UNKNOWN' AND dst_{c} <> '')))) AS network_intelligence_{c}_count" for c in ("provider", "source")
) + ", count(DISTINCT src_ip) AS classified_source_ip_count, count(DISTINCT dst_ip) AS classified_destination_ip_count, least(min(nullif(list_position(" + str(network.PRIORITY) + ", src_network_type), 0)), min(nullif(list_position(" + str(network.PRIORITY) + ", dst_network_type), 0))) AS place FROM cls GROUP BY txid)"


@query("a12_transaction_intelligence", f"""SELECT * EXCLUDE place, coalesce({network.PRIORITY}[place], 'UNKNOWN') AS network_intelligence_classification, greatest(vpn_evidence, proxy_evidence, tor_evidence, hosting_evidence) AS network_intelligence_evidence_score,
  greatest(vpn_evidence, proxy_evidence, tor_evidence, hosting_evidence) > 0 AS network_intelligence_available, CASE WHEN tor_evidence >= .9 THEN 'VERY_HIGH' WHEN tor_evidence >= .75 OR vpn_evidence >= .9 OR proxy_evidence >= .9 THEN 'HIGH'
  WHEN vpn_evidence >= .75 OR proxy_evidence >= .75 OR hosting_evidence >= .9 THEN 'MODERATE' WHEN greatest(vpn_evidence, proxy_evidence, tor_evidence, hosting_evidence) > 0 THEN 'LOW' ELSE 'NONE' END AS network_intelligence_evidence_level FROM intel""", INTEL)
def a12(spark, sf):
    return network.transaction_intelligence(network.classified_observations(d.observations(spark, sf), d.feed(spark, sf)))


# --- behaviour ------------------------------------------------------------------------------------------------


def _values(spark, sf):
    li = d.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("txid")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value"))


def _pred(spark, sf):
    rows = d.address_rows(spark, sf)
    return behavior.causal_predecessors(d.steps(spark, sf), _values(spark, sf), rows.select("txid", F.col("input_address").alias("address")), rows.select("txid", F.col("output_address").alias("address")))


@query("j8_causal_predecessors", "SELECT txid, previous, shared, gap, round(reduction + 1e-9, 4) + 0.0 AS reduction FROM pred")
def j8(spark, sf):
    return _pred(spark, sf).withColumn("reduction", F.round(F.col("reduction") + 1e-9, 4) + F.lit(0.0))


@query("w10_predecessor_summary", """SELECT txid, count(*) AS predecessor_count, sum(shared)::BIGINT AS shared_address_links, count(*) FILTER (WHERE ok) AS valid_predecessor_count, round(max(reduction) FILTER (WHERE ok) + 1e-9, 4) AS best_reduction,
  first(previous ORDER BY ok DESC, reduction DESC, previous::VARCHAR) FILTER (WHERE ok) AS best_previous, bool_or(gap = 1) AS direct_continuation, coalesce(bool_or(ok), false) AS gradual_reduction FROM (SELECT *, coalesce(reduction BETWEEN .05 AND .95, false) AS ok FROM pred) GROUP BY txid""")
def w10(spark, sf):
    return behavior.predecessor_summary(_pred(spark, sf)).withColumn("best_reduction", F.round(F.col("best_reduction") + 1e-9, 4))


@made_once
def predecessors(spark, sf) -> DataFrame:
    return _pred(spark, sf)


@made_once
def chains(spark, sf) -> DataFrame:
    return behavior.longest_chains(d.steps(spark, sf), predecessors(spark, sf))


def peeling(spark, sf):
    steps, pairs = d.steps(spark, sf), predecessors(spark, sf)
    metrics = behavior.chain_metrics(chains(spark, sf), _values(spark, sf), steps)
    return behavior.peeling(steps, behavior.predecessor_summary(pairs), metrics)


#: The chains step by step: each round of the recursion adds a step's transactions, with what is known of all earlier ones.
CHAINS = [
    "links AS (SELECT p.txid, p.previous, s.time_step FROM pred p JOIN steps s ON p.txid = s.txid WHERE p.reduction BETWEEN .05 AND .95)",
    "st AS (SELECT row_number() OVER (ORDER BY time_step) AS i, time_step FROM (SELECT DISTINCT time_step FROM steps))",
    "ch(txid, i, time_step, chain) USING KEY (txid) AS (SELECT txid, i, steps.time_step, [txid::VARCHAR] FROM steps JOIN st USING (time_step) WHERE i = 1 UNION "
    "SELECT s.txid, st.i, s.time_step, coalesce(b.g.chain, [s.txid::VARCHAR]) FROM (SELECT max(i) + 1 AS i FROM ch) n JOIN st ON st.i = n.i JOIN steps s ON s.time_step = st.time_step "
    "LEFT JOIN (SELECT txid, time_step, min({'n': -len(chain), 'chain': chain}) AS g FROM (SELECT l.txid, l.time_step, list_append(p.chain, l.txid::VARCHAR)[-10:] AS chain FROM links l JOIN recurring.ch p ON p.txid = l.previous) GROUP BY ALL) b ON b.txid = s.txid)",
]
PEELING = [
    *CHAINS,
    "vals AS (SELECT txid, round(sum(due), 4) AS value FROM raw GROUP BY txid)",
    "pts AS (SELECT c.txid, len(c.chain) AS n, pos, v.value, s.time_step AS step FROM (SELECT txid, chain, unnest(chain)::BIGINT AS member, generate_subscripts(chain, 1) AS pos FROM ch WHERE len(chain) >= 3) c JOIN vals v ON v.txid = member JOIN steps s ON s.txid = member)",
    "cuts AS (SELECT *, lag(value) OVER w AS before, step - lag(step) OVER w AS gap FROM pts WINDOW w AS (PARTITION BY txid ORDER BY pos))",
    "cutr AS (SELECT *, CASE WHEN before > 0 THEN (before - value) / before END AS cut FROM cuts)",
    "met AS (SELECT txid, any_value(n) AS chain_length, coalesce(bool_and(cut BETWEEN .05 AND .95) FILTER (WHERE pos > 1), true) AS chain_valid, max(step) - min(step) AS temporal_span, CASE WHEN arg_min(value, pos) > 0 THEN round((arg_min(value, pos) - arg_max(value, pos)) / arg_min(value, pos), 6) END AS total_reduction, "
    "round(min(cut), 6) AS min_reduction, round(max(cut), 6) AS max_reduction, coalesce(bool_and(gap = 1) FILTER (WHERE pos > 1), true) AS all_gaps_one FROM cutr GROUP BY txid)",
    "summ AS (SELECT txid, count(*) AS predecessor_count, sum(shared)::BIGINT AS shared_address_links, count(*) FILTER (WHERE ok) AS valid_predecessor_count, max(reduction) FILTER (WHERE ok) AS best_reduction, first(previous ORDER BY ok DESC, reduction DESC, previous::VARCHAR) FILTER (WHERE ok) AS best_previous, "
    "bool_or(gap = 1) AS direct_continuation, coalesce(bool_or(ok), false) AS gradual_reduction FROM (SELECT *, coalesce(reduction BETWEEN .05 AND .95, false) AS ok FROM pred) GROUP BY txid)",
    "peel0 AS (SELECT s.txid, s.time_step, coalesce(predecessor_count, 0) AS predecessor_count, coalesce(shared_address_links, 0) AS shared_address_links, coalesce(valid_predecessor_count, 0) AS valid_predecessor_count, best_reduction, best_previous, coalesce(direct_continuation, false) AS direct_continuation, "
    "coalesce(gradual_reduction, false) AS gradual_reduction, coalesce(chain_length, 0) AS chain_length, coalesce(chain_valid, false) AS chain_valid, coalesce(temporal_span, 0) AS temporal_span, total_reduction, min_reduction, max_reduction, coalesce(all_gaps_one, false) AS all_gaps_one "
    "FROM steps s LEFT JOIN summ ON s.txid = summ.txid LEFT JOIN met ON s.txid = met.txid)",
    "peel AS (SELECT *, round(least(1.0, .25 * direct_continuation::INT + .25 * gradual_reduction::INT + .25 * chain_valid::INT + chain_valid::INT * .05 * least(greatest(chain_length - 3, 0), 4) + .1 * chain_valid::INT * all_gaps_one::INT + .1 * (shared_address_links >= 2)::INT), 6)::DOUBLE AS peeling_evidence_score, direct_continuation OR gradual_reduction AS peeling_candidate FROM peel0)",
]


@query("g7_longest_chains", "SELECT txid, time_step, array_to_string(chain, '>') AS chain FROM ch", *CHAINS)
def g7(spark, sf):
    return chains(spark, sf).withColumn("chain", F.concat_ws(">", "chain"))


@query("g8_f7_peeling", "SELECT * FROM peel", *PEELING)
def g8(spark, sf):
    return peeling(spark, sf)


@query("j9_f10_behavioral_evidence", """SELECT *, CASE WHEN behavioral_evidence_score < .2 THEN 'LOW' WHEN behavioral_evidence_score < .5 THEN 'MODERATE' WHEN behavioral_evidence_score < .75 THEN 'HIGH' ELSE 'VERY_HIGH' END AS behavioral_level FROM (
  SELECT p.txid, p.time_step, peeling_evidence_score, peeling_candidate, mixing_evidence_score, mixing_candidate, round(.5 * peeling_evidence_score + .5 * mixing_evidence_score, 6) AS behavioral_evidence_score, peeling_candidate::INT + mixing_candidate::INT AS behavioral_signal_count FROM peel p JOIN mixing m ON p.txid = m.txid)""", *PEELING)
def j9(spark, sf):
    return behavior.behavioral_evidence(peeling(spark, sf), mixing(spark, sf))
