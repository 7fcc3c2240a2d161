"""Element-wise ingestion over texts and rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.operators import profile
from ledgerweave.plans.registry import query
from ledgerweave.sources import elements


@query("s2_s21_json_elements", """SELECT click_id, position, fault, f ->> '$.k' AS k, f ->> '$.sku' AS sku, f ->> '$.qty' AS qty, (f -> '$.tags') IS NOT NULL AS has_tags FROM (
  SELECT click_id, 0::INT AS position, CASE WHEN trim(coalesce(props, '')) = '' THEN 'EMPTY' ELSE 'MALFORMED' END AS fault, NULL::JSON AS f FROM clicks WHERE NOT coalesce(json_valid(props), false)
  UNION ALL SELECT click_id, 0, NULL, props::JSON FROM clicks WHERE json_valid(props) AND coalesce(json_type(props, '$.items'), '') <> 'ARRAY'
  UNION ALL SELECT click_id, (i - 1)::INT, CASE WHEN json_type(e) <> 'OBJECT' THEN 'NOT_AN_OBJECT' END, e FROM (SELECT click_id, unnest(props -> '$.items[*]') AS e, generate_subscripts(props -> '$.items[*]', 1) AS i FROM clicks WHERE json_valid(props) AND json_type(props, '$.items') = 'ARRAY'))""")
def s2(spark, sf):
    """Every element of the clicks' JSON: the items where there is a list of them, else the object, and what is neither."""
    found = elements.json_elements(d.table(spark, sf, "clicks").select("click_id", "props"), "props", ("items",))
    f = F.col("fields")
    return found.select("click_id", "position", "fault", f["k"].alias("k"), f["sku"].alias("sku"), f["qty"].alias("qty"), F.coalesce(F.map_contains_key("fields", "tags"), F.lit(False)).alias("has_tags"))


def _observed(spark, sf):
    """Observations as a feed gives them: all text, some sources blank, every fourth row twice."""
    o = d.observations(spark, sf)
    text = o.select(*(F.col(c).cast("string").alias(c) for c in o.columns if c not in ("timestamp", "observation_source")), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.when(F.col("asn") % 10 == 0, " ").otherwise(F.col("observation_source")).alias("observation_source"))
    return text.withColumn("n", F.explode(F.when(F.col("network_event_id").cast("long") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("network_event_id", F.concat_ws("-", "network_event_id", "n")).drop("n")


_CANON = "oc AS (SELECT network_event_id || '-' || n AS network_event_id, src_ip, src_port, dst_ip, CASE WHEN dst_port BETWEEN 0 AND 65535 THEN dst_port END AS dst_port, txid::VARCHAR AS txid, date_trunc('second', timestamp) AS timestamp, CASE WHEN asn % 10 = 0 THEN 'feed' ELSE observation_source END AS observation_source, asn FROM (SELECT *, unnest(CASE WHEN network_event_id::BIGINT % 4 = 0 THEN [0, 1] ELSE [0] END) AS n FROM obs))"


@query("s29_p23_network_observations", "SELECT min(network_event_id) AS network_event_id, epoch(timestamp)::BIGINT AS at, src_ip, src_port, dst_ip, dst_port, txid, asn, observation_source, count(*) AS copies FROM oc GROUP BY timestamp, src_ip, src_port, dst_ip, dst_port, txid, asn, observation_source", _CANON)
def s29(spark, sf):
    """Canonical observations, equal ones once."""
    found = elements.network_distinct(elements.network_canonical(_observed(spark, sf), "feed"))
    return found.select("network_event_id", F.col("timestamp").cast("long").alias("at"), "src_ip", "src_port", "dst_ip", "dst_port", "txid", "asn", "observation_source", "copies")


@query("p23_null_report", "SELECT 'network_event_id' AS \"column\", count(*) FILTER (WHERE network_event_id IS NULL) AS nulls, count(DISTINCT network_event_id) AS \"values\" FROM oc" + "".join(
    f" UNION ALL SELECT '{c}', count(*) FILTER (WHERE {e} IS NULL), count(DISTINCT {e}) FROM oc" for c, e in (("timestamp", "timestamp"), ("src_ip", "src_ip"), ("src_port", "src_port"), ("dst_ip", "dst_ip"), ("dst_port", "dst_port"), ("txid", "txid"), ("asn", "asn"), ("observation_source", "observation_source"), ("protocol", "NULL::VARCHAR"), ("direction", "NULL::VARCHAR"))
), _CANON)
def p23(spark, sf):
    return elements.null_report(elements.network_canonical(_observed(spark, sf), "feed")).filter("column <> 'geo_country'")


_KINDS = {"src_ip": "src_ip", "dst_ip": "dst_ip", "src_port": "src_port", "dst_port": "dst_port", "day": "strftime(timestamp, '%Y-%m-%d')", "country": "geo_country", "asn": "asn"}
_STACKED = "kinds AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, ({v})::VARCHAR AS value FROM obs" for k, v in _KINDS.items()) + "".join(f" UNION ALL SELECT '{k}', unnest({s}) FROM tx" for s in ("input_wallets", "output_wallets") for k in (s, "wallets")) + ")"
_MONEY = "money AS (SELECT 'input' AS part, input_btc_total AS v FROM tx UNION ALL SELECT 'output', output_btc_total FROM tx UNION ALL SELECT 'fee', fee_btc FROM tx)"


@query("a16_a17_import_profile", "SELECT 'unique' AS part, kind AS name, count(DISTINCT value) AS n, NULL::DOUBLE AS percentage, NULL::DOUBLE AS amount FROM kinds WHERE value IS NOT NULL GROUP BY kind "
       "UNION ALL SELECT kind, value, count(*), round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY kind), 2), NULL FROM kinds WHERE value IS NOT NULL AND kind IN ('day', 'country', 'asn') GROUP BY kind, value "
       + "".join(f"UNION ALL SELECT part, '{k}', count(*), NULL, round({v} + 1e-7, 2) FROM money WHERE v IS NOT NULL GROUP BY part " for k, v in {"total": "sum(v)", "mean": "avg(v)", "median": "quantile_cont(v, .5)", "min": "min(v)", "max": "max(v)"}.items()), _STACKED, _MONEY)
def a16(spark, sf):
    """Unique values, distributions and money of the whole import, in long form."""
    addresses = d.address_rows(spark, sf).join(d.steps(spark, sf).select("txid"), "txid", "left_semi")
    return profile.import_profile(d.canonical(spark, sf), addresses, d.observations(spark, sf)).withColumn("amount", F.round(F.col("amount") + 1e-7, 2))
