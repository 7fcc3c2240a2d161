"""The domain views as SQL, and a helper that puts them before a query's own text."""

DOMAIN = r"""
steps AS (SELECT o_orderkey AS txid, (floor(datediff('day', DATE '1995-01-01', o_orderdate::DATE) / 50) + 1)::INT AS time_step FROM orders),
raw AS (SELECT l_orderkey AS txid, 'W' || l_partkey AS input_address, 'W' || l_suppkey AS output_address,
        l_extendedprice AS paid, l_extendedprice * (1 - l_discount) AS due, l_tax FROM lineitem),
ins AS (SELECT DISTINCT txid, input_address AS address FROM raw),
outs AS (SELECT DISTINCT txid, output_address AS address FROM raw),
fig AS (SELECT txid, sum(paid * l_tax) AS fee_btc,
        min(paid) AS input_btc_min, max(paid) AS input_btc_max, avg(paid) AS input_btc_mean, quantile_cont(paid, 0.5) AS input_btc_median, sum(paid) AS input_btc_total,
        min(due) AS output_btc_min, max(due) AS output_btc_max, avg(due) AS output_btc_mean, quantile_cont(due, 0.5) AS output_btc_median, sum(due) AS output_btc_total,
        list_sort(list(DISTINCT input_address)) AS iw, list_sort(list(DISTINCT output_address)) AS ow FROM raw GROUP BY txid),
tx AS (SELECT s.txid, s.time_step, o_totalprice AS total_btc, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS label,
       fee_btc, input_btc_min, input_btc_max, input_btc_mean, input_btc_median, input_btc_total,
       output_btc_min, output_btc_max, output_btc_mean, output_btc_median, output_btc_total,
       coalesce(iw, []) AS input_wallets, coalesce(ow, []) AS output_wallets,
       len(iw)::DOUBLE AS input_address_count, len(ow)::DOUBLE AS output_address_count, iw IS NOT NULL AS has_address_relationships
       FROM steps s JOIN orders ON s.txid = o_orderkey LEFT JOIN fig ON s.txid = fig.txid),
obs AS (SELECT event_id::VARCHAR AS network_event_id, ts AS timestamp,
        '10.0.' || ((user_id % 65536) // 256) || '.' || (user_id % 256) AS src_ip, '10.1.0.' || (event_id % 200) AS dst_ip, 8333 AS src_port,
        coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS dst_port, (event_id // 3) * 6 AS txid,
        'C' || (user_id % 25) AS geo_country, user_id % 97 AS asn, event_type AS observation_source FROM events),
feed AS (SELECT '10.0.' || ((user_id % 65536) // 256) || '.' || (user_id % 256) AS ip,
         ['VPN','PROXY','TOR_EXIT','TOR_RELAY','HOSTING','DATACENTER','RESIDENTIAL','MOBILE','EDUCATIONAL','GOVERNMENT','UNKNOWN'][((user_id + 3 * k) % 11 + 1)::INT] AS network_type,
         'P' || (user_id % 7) AS provider, ((user_id + 31 * k) % 100) / 100.0::DOUBLE AS confidence, 'F' || k AS source
         FROM (SELECT DISTINCT user_id, unnest(CASE WHEN user_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS k FROM events)),
edges AS (SELECT input_address AS source, output_address AS target, count(*) AS observation_count FROM raw GROUP BY ALL),
pairs AS (SELECT a.address AS a, b.address AS b, count(*) AS shared_count FROM ins a JOIN ins b ON a.txid = b.txid AND a.address < b.address GROUP BY ALL),
addr AS (SELECT DISTINCT address FROM ins),
counts AS (SELECT s.txid, s.time_step, coalesce(i.n, 0) AS i, coalesce(o.n, 0) AS o FROM steps s
           LEFT JOIN (SELECT txid, count(*) AS n FROM ins GROUP BY txid) i ON s.txid = i.txid LEFT JOIN (SELECT txid, count(*) AS n FROM outs GROUP BY txid) o ON s.txid = o.txid),
mix AS (SELECT txid, time_step, i AS input_count, o AS output_count, round(CASE WHEN i > 0 THEN o / i ELSE 0 END, 6) AS output_input_ratio, i + o AS participant_count,
        round((i + o) / greatest(i, o, 1), 6) AS participant_density, i >= 5 AS fan_in_flag, o >= 5 AS fan_out_flag,
        (CASE WHEN i > 0 THEN o / i ELSE 0 END) BETWEEN 0.4 AND 2.5 AS balance_flag, i + o >= 10 AS participant_flag, i + o >= 25 AS high_participant_flag FROM counts),
mixing AS (SELECT *, fan_in_flag AND fan_out_flag AND balance_flag AND participant_flag AS mixing_candidate,
           round(0.25 * fan_in_flag::INT + 0.25 * fan_out_flag::INT + 0.2 * balance_flag::INT + 0.15 * participant_flag::INT + 0.1 * high_participant_flag::INT
                 + 0.05 * (fan_in_flag AND fan_out_flag AND balance_flag AND participant_flag)::INT, 6)::DOUBLE AS mixing_evidence_score FROM mix),
pred AS (SELECT p.txid, p.previous, count(*) AS shared, min(p.gap) AS gap, CASE WHEN any_value(v.due) > 0 THEN (any_value(v.due) - any_value(w.due)) / any_value(v.due) END AS reduction
         FROM (SELECT i.txid, o.txid AS previous, s.time_step - r.time_step AS gap FROM ins i JOIN steps s ON i.txid = s.txid JOIN outs o ON o.address = i.address
               JOIN steps r ON o.txid = r.txid WHERE s.time_step - r.time_step BETWEEN 1 AND 10) p
         JOIN (SELECT txid, round(sum(due), 4) AS due FROM raw GROUP BY txid) v ON v.txid = p.previous JOIN (SELECT txid, round(sum(due), 4) AS due FROM raw GROUP BY txid) w ON w.txid = p.txid GROUP BY p.txid, p.previous),
matched AS (SELECT obs.*, steps.time_step FROM obs JOIN steps ON obs.txid = steps.txid),
stats AS (SELECT txid, count(*) AS observation_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
          len(list_distinct(list_concat(list(src_ip), list(dst_ip)))) AS unique_endpoints, count(DISTINCT asn) AS unique_asns, count(DISTINCT geo_country) AS unique_countries,
          (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS span_seconds FROM matched GROUP BY txid),
evid AS (SELECT *, round(0.4 * (1 - exp(-observation_count / 5.0)) + 0.3 * (1 - exp(-unique_endpoints / 4.0)) + 0.3 * least(span_seconds / 60.0, 1.0), 6)::DOUBLE AS temporal_observation_evidence FROM stats),
evidl AS (SELECT *, CASE WHEN temporal_observation_evidence <= .25 THEN 'LOW' WHEN temporal_observation_evidence <= .5 THEN 'MODERATE' WHEN temporal_observation_evidence <= .75 THEN 'HIGH' ELSE 'VERY_HIGH' END AS temporal_evidence_level FROM evid),
best AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY confidence DESC, source) AS n FROM feed) WHERE n = 1),
cls AS (SELECT obs.*, coalesce(a.network_type, 'UNKNOWN') AS src_network_type, coalesce(b.network_type, 'UNKNOWN') AS dst_network_type, coalesce(a.provider, '') AS src_provider, coalesce(b.provider, '') AS dst_provider,
        a.confidence AS src_confidence, b.confidence AS dst_confidence, coalesce(a.source, '') AS src_source, coalesce(b.source, '') AS dst_source FROM obs LEFT JOIN best a ON obs.src_ip = a.ip LEFT JOIN best b ON obs.dst_ip = b.ip)
"""


def domain(text: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([DOMAIN.strip(), *more]) + "\n" + text
