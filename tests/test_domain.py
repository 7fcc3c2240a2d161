"""Domain operators on small frames, and the three input formats."""

import json
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerweave import domain
from ledgerweave.functions import normalize
from ledgerweave.operators import behavior, entity, features, graph, ml, ordering, risk, temporal_graph, validate
from ledgerweave.plans import registry_risk
from ledgerweave.sources import readers
from ledgerweave.streaming import flows


def test_wallet_history_sees_only_earlier_steps(spark):
    steps = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "txid long, time_step int")
    members = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "txid long, address string")
    got = {r.txid: r for r in features.wallet_history(steps, members).collect()}
    assert [got[t].input_wallets_seen_before for t in (1, 2, 3)] == [0, 0, 1]
    assert got[3].input_wallet_prior_frequency_max == 2
    apart = spark.createDataFrame([(1, 1), (2, 3)], "txid long, time_step int")
    got = {r.txid: r for r in features.wallet_history(apart, members.filter("txid < 3")).collect()}
    assert got[2].input_wallets_seen_before == 1 and got[2].input_wallet_recency_max == 2


@pytest.mark.parametrize("value,valid", [(0.05, True), (0.5, True), (0.95, True), (None, None), (0.0, False), (0.049, False), (0.951, False), (-0.1, False)])
def test_valid_reduction(spark, value, valid):
    df = spark.createDataFrame([(value,)], "r double")
    assert df.select(behavior.valid_reduction(F.col("r")).alias("v")).first().v == valid


def chains_by_hand(steps, links):
    best = {}
    for t, step in sorted(steps.items(), key=lambda x: x[1]):
        found = [best[p] + [str(t)] for x, p in links if x == t and steps[p] < step]
        found = [c[-4:] for c in found]
        best[t] = min(found, key=lambda c: (-len(c), c)) if found else [str(t)]
    return best


def test_longest_chains(spark):
    import random

    rng = random.Random(1)
    steps = {t: rng.randint(1, 12) for t in range(40)}
    links = [(a, b) for a in steps for b in steps if 1 <= steps[a] - steps[b] <= 10 and rng.random() < 0.06]
    s = spark.createDataFrame(list(steps.items()), "txid long, time_step int")
    p = spark.createDataFrame([(a, b, 0.5) for a, b in links], "txid long, previous long, reduction double")
    got = {r.txid: r.chain for r in behavior.longest_chains(s, p, 4).collect()}
    assert got == chains_by_hand(steps, links)


def test_temporal_components(spark):
    steps = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "txid long, time_step int")
    inputs = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (2, "C"), (3, "A"), (3, "C"), (4, "A"), (4, "D")], "txid long, address string")
    members = inputs.join(steps, "txid")
    states = temporal_graph.states_before(members, temporal_graph.pair_counts(inputs, steps))
    got = {(r.address, r.time_step): r.size_1 for r in states.collect()}
    assert got == {("A", 1): 1, ("B", 1): 1, ("B", 2): 2, ("C", 2): 1, ("A", 3): 3, ("C", 3): 3, ("A", 4): 3, ("D", 4): 1}


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d")], "a string, b string")
    assert {r.node: r.component for r in entity.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_shortest_path(spark):
    e = spark.createDataFrame([("1", "a", "b", "R"), ("2", "b", "c", "R"), ("3", "a", "d", "R"), ("4", "c", "d", "R"), ("5", "c", "e", "R")], "edge_id string, source string, target string, relation string")
    assert [r.node for r in graph.shortest_path(e, "a", "e").orderBy("hop").collect()] == ["a", "b", "c", "e"]
    assert graph.shortest_path(e, "a", "a").count() == 1
    assert graph.shortest_path(e, "a", "zz").count() == 0
    assert graph.path_edges(e, graph.shortest_path(e, "a", "e")).count() == 3


def test_signals(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)], "txid int, x double")
    ranks = {r.txid: r.p for r in risk.average_percent_rank(df, "x", "p").collect()}
    assert ranks == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-1.0,), (0.3,)], "x double")
    assert [r.v for r in odd.select(risk.bounded_unit_interval(F.col("x")).alias("v")).collect()] == [0.0, 0.0, 0.0, 0.0, 0.3]
    assert [r.v for r in odd.select(risk.clamp01(F.col("x")).alias("v")).collect()] == [0.0, 1.0, 0.0, 0.0, 0.3]
    flat = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r.x_signal for r in risk.percentile_signal(flat, ["x"]).collect()} == {1.0}


def test_normalisers(spark):
    df = spark.createDataFrame([("12.0", "2001:DB8:0:0::10", "tor"), ("1e3", "10.0.0.1", "data-center"), (None, "x", "y")], "t string, ip string, k string")
    got = df.select(normalize.txid_plain(F.col("t")).alias("a"), normalize.txid_numeric(F.col("t")).alias("b"), normalize.ip(F.col("ip")).alias("ip"), normalize.network_type(F.col("k")).alias("k")).collect()
    assert [tuple(r) for r in got] == [("12", "12", "2001:db8::10", "TOR_EXIT"), ("1e3", "1000", "10.0.0.1", "DATACENTER"), ("", "", None, None)]


def test_entity_signal_is_the_mean_of_six_components(spark):
    rows = [(t, t / 10, 0.0, t % 3, 0, t * 2, t, 5, 5, 1, 2 * t, 3, t) for t in range(11)]
    names = ["input_repeated_ratio", "output_repeated_ratio"] + [f"{side}_{c}" for c in registry_risk.ENTITY.values() for side in ("input", "output")]
    df = spark.createDataFrame(rows, "txid long, " + ", ".join(f"{n} double" if "ratio" in n else f"{n} long" for n in names))
    df = df.withColumn("input_repeated_addresses", F.col("txid") % 2).withColumn("output_repeated_addresses", F.lit(0))

    def scaled(values):
        a, b = (float(np.percentile(values, p)) for p in (1, 99))
        return [min(1, max(0, (v - a) / (b - a))) if b > a else float(b > 0) for v in values]

    columns = list(zip(*(r[1:] for r in rows)))
    parts = [columns[0], columns[1], *(scaled(c) for c in columns[2:])]
    want = {t: sum((parts[2 * k][t] + parts[2 * k + 1][t]) / 2 for k in range(6)) / 6 for t in range(11)}
    got = risk.entity_signal(df, registry_risk.ENTITY).collect()
    assert {r.txid: r.entity_signal for r in got} == pytest.approx(want)
    assert all(r.entity_available == (r.txid % 2 == 1) for r in got)


def test_ranges_of_a_total_order(spark):
    rows = [(i, (i * 7) % 5, float((i * 13) % 11)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int, x double").repartition(7)
    got = {r.k: (r.n, r.s) for r in ordering.running_sums(df, [F.desc("v"), F.asc("k")], n=F.lit(1), s=F.col("v")).collect()}
    total, want = 0, {}
    for n, (k, v, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        want[k] = (n, total)
    assert got == want
    xs = [r[2] for r in rows]
    shares = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}
    assert ordering.percentiles(df, "x", shares).first().asDict() == pytest.approx({k: float(np.percentile(xs, 100 * p)) for k, p in shares.items()})


def test_graphml_view(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "tx", 1), ("b", "w<", None), ("c", "ip", 3)], "node_id string, node_type string, time_step int")
    edges = spark.createDataFrame([("1", "a", "b", "X"), ("2", "b", "c", "Y&"), ("3", "c", "c", "Z")], "edge_id string, source string, target string, relation string")
    text = readers.graphml(nodes, edges, spark.createDataFrame([("a",), ("b",)], "node_id string"))
    readers.write_text(spark, text, str(tmp_path / "g.graphml"))
    root = ElementTree.parse(tmp_path / "g.graphml").getroot()
    tag = "{http://graphml.graphdrawing.org/xmlns}"
    assert [n.get("id") for n in root.iter(f"{tag}node")] == ["a", "b", "c"] and [e.get("id") for e in root.iter(f"{tag}edge")] == ["1", "2"]
    assert [d.text for d in root.iter(f"{tag}data")] == ["tx", "1", "w<", "ip", "3", "X", "Y&"]
    assert "<edge" not in readers.graphml(nodes, edges, most_nodes=0)


def test_gates_count_what_fails(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 120.0), (2, None)], "txid long, risk_score double")
    got = {r.check: r.failures for r in validate.checks(df, {"risk_in_range": F.col("risk_score").between(0, 100)}, ["txid"]).collect()}
    assert got == {"risk_in_range": 2, "unique_key": 1}
    nodes, ends = spark.createDataFrame([("a",)], "node_id string"), spark.createDataFrame([("a", "b")], "source string, target string")
    assert [r.node_id for r in graph.dangling(nodes, ends).collect()] == ["b"]


def test_exact_aliases(spark):
    names = [" Time_Stamp ", "SourceIP", "destinationport", "fee_btc", "Input_Amount_BTC", "tx_id", "country", "hash", "input-address", "Confidence Score"]
    assert [normalize.canonical_name(x, False) for x in names] == ["timestamp", "src_ip", "dst_port", "fee", "input_amount", "txid", "country", "hash", "input-address", "confidence score"]
    assert [normalize.canonical_name(x) for x in names] == ["timestamp", "src_ip", "dst_port", "fee", "input_amount", "txid", "geo_country", "hash", "input_wallets", "confidence"]
    kinds = {"tor exit": ("TOR_EXIT", "TOR_EXIT"), "Exit Node": ("TOR_EXIT", None), "exit": (None, "TOR_EXIT"), "data-center": ("DATACENTER", None), "": ("UNKNOWN", "UNKNOWN"), None: ("UNKNOWN", "UNKNOWN"), "host": (None, None), "vpn": ("VPN", "VPN")}
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    got = {r.k: (r.a, r.b) for r in df.select("k", normalize.network_type(F.col("k")).alias("a"), normalize.network_type(F.col("k"), feed=False).alias("b")).collect()}
    assert got == kinds


def test_numbers_as_ids(spark):
    # Text, with 15 significant digits, with the text kept
    want = [("1e3", "1000", "1000"), ("4304541.0", "4304541", "4304541"), ("0.5", "0.5", "0.5"), ("1.25e-2", "0.0125", "1.25e-2"), ("12.50", "12.5", "12.50"), ("0.00001250", "1.25e-05", "0.00001250"), ("-3.14159265358979312", "-3.14159265358979", "-3.14159265358979312"), ("inf", "", "inf"), ("nan", "", ""), (" ab ", "ab", "ab"), ("", "", ""), (None, "", "")]
    df = spark.createDataFrame([(w[0],) for w in want], "t string")
    got = df.select("t", normalize.txid_rounded(F.col("t")).alias("b"), normalize.txid_numeric(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == want
    df = spark.createDataFrame([("AS12",), (" as7 ",), ("15",), ("ASx",), (None,)], "a string")
    assert [r.a for r in df.select(normalize.asn_name(F.col("a")).alias("a")).collect()] == ["AS12", "AS7", "AS15", None, None]
    df = spark.createDataFrame([(["a", "b"],), ([],), (["a", " "],), (["a", None],), (None,)], "w array<string>")
    assert [r.ok for r in df.select(normalize.wallets_valid(F.col("w")).alias("ok")).collect()] == [True, True, False, False, False]


RECORD = dict(
    timestamp="2026-01-01T00:00:00Z", src_ip="10.0.0.1", dst_ip="10.0.0.2", src_port=8333, dst_port=8333, txid=12345, input_wallets=["wallet_in_1"], output_wallets=["wallet_out_1"],
    input_amount=1.5, output_amount=1.49, fee=0.01, script_type="P2PKH", geo_country="IN", asn="AS12345",
)


def test_import_formats(spark, tmp_path):
    second = RECORD | {"txid": 67890, "src_ip": "10.0.0.3"}
    (tmp_path / "a.json").write_text(json.dumps({"records": [RECORD, second]}))
    flat = [{k: "|".join(v) if isinstance(v, list) else str(v) for k, v in r.items()} for r in (RECORD, second)]
    (tmp_path / "a.csv").write_text("﻿" + ",".join(flat[0]) + "\n" + "\n".join(",".join(r.values()) for r in flat))
    (tmp_path / "a.xml").write_text("<records>" + "".join("<record>" + "".join(f"<{k}>{v}</{k}>" for k, v in r.items()) + "</record>" for r in flat) + "</records>")
    for suffix in ("json", "csv", "xml"):
        done = readers.Import(spark, str(tmp_path / f"a.{suffix}"))
        p = done.provenance.first()
        assert (p.records_read, p.valid_records, p.invalid_records, p.duplicates_removed, p.status) == (2, 2, 0, 0, "PASS"), suffix
        assert {r.txid for r in done.valid.collect()} == {"12345", "67890"}
    bad = [RECORD, RECORD, RECORD | {"src_ip": "not-an-ip", "src_port": 70000}, {k: v for k, v in RECORD.items() if k != "asn"}]
    (tmp_path / "b.json").write_text(json.dumps(bad))
    done = readers.Import(spark, str(tmp_path / "b.json"))
    p = done.provenance.first()
    assert (p.records_read, p.valid_records, p.invalid_records, p.duplicates_removed, p.status) == (4, 2, 2, 1, "WARNING")
    assert sorted((tuple(r.missing), tuple(sorted(r.invalid))) for r in done.rejects.collect()) == [((), ("src_ip", "src_port")), (("asn",), ())]
    readers.write_import(done, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest")).count() == 1
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.txt")


def test_synthetic_records_are_valid(spark):
    made = readers.synthetic_records(spark)
    assert made.count() == 100 and validate.validated(made, "COMBINED").filter("not valid").count() == 0
    assert sorted(made.collect()) == sorted(readers.synthetic_records(spark).collect())


def test_temperature_and_metrics(spark):
    rows = [(i, float(i % 2), [0.9, 0.1] if (i % 2 == 0) != (i % 5 == 0) else [0.1, 0.9]) for i in range(60)]
    df = spark.createDataFrame(rows, "txid long, label double, probabilities array<double>").withColumn("predicted", (F.get("probabilities", F.lit(1)) > 0.5).cast("int"))
    t = ml.fit_temperature(df, rounds=12)
    assert 1.2 < t < 2.2  # 80 % right at a stated 90 %
    m = ml.classification_metrics(df).first()
    assert m.accuracy == pytest.approx(0.8) and 0 < m.macro_f1 < 1


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = flows.observation_context(flows.event_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT user_id, max(sequence) AS n FROM seen GROUP BY 1").collect()
    assert {r.user_id: r.n for r in got} == {r.user_id: r.n for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect()}


def clusters_by_hand(spends, least):
    """Address: set of addresses linked by pairs that at least ``least`` transactions spend together."""
    group = {a: {a} for s in spends.values() for a in s}
    for a, b in [(a, b) for a in group for b in group if a < b and sum(a in s and b in s for s in spends.values()) >= least]:
        group |= dict.fromkeys(group[a] | group[b], group[a] | group[b])
    return group


def test_transaction_entity_evidence_has_real_clusters_of_both_sides(spark, tmp_path):
    spends = {1: "ab", 2: "ab", 3: "abc", 4: "cd", 5: "cd", 6: "e", 7: "ef"}
    pays = {1: "a", 2: "x", 3: "de", 4: "bc", 5: "xy", 6: "f", 7: "a"}
    number = {c: i for i, c in enumerate("abcdefxy", 1)}
    lines = [(t, number[i], number[o]) for t in spends for i in spends[t] for o in pays[t]]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.createDataFrame([(t, "1995-02-01") for t in range(1, 9)], "o_orderkey long, o_orderdate string")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    run = entry.queries()
    got = {r.txid: r for r in run["j7_transaction_entity_evidence"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 9)) and got[8].input_cluster_size_max_t1 == got[8].output_distinct_clusters_t1 == 0
    for least in (1, 2, 3):
        group = clusters_by_hand(spends, least)
        for side, members in (("input", spends), ("output", pays)):
            for t, m in members.items():
                own = [frozenset(group.get(a, a)) for a in m]
                assert got[t][f"{side}_cluster_size_max_t{least}"] == max(map(len, own))
                assert got[t][f"{side}_distinct_clusters_t{least}"] == len(set(own))
        sizes = {f"W{number[a]}": len(g) for a, g in group.items()}
        assert {r.address: r.cluster_size for r in run[f"g2_cospend_clusters_{least}"](spark, str(tmp_path)).collect()} == sizes
        report = run[f"a8_cluster_report_{least}"](spark, str(tmp_path)).first()
        assert report.largest == max(sizes.values()) and report.non_singleton_addresses == sum(n > 1 for n in sizes.values())
        j6 = "j6_entity_evidence" + ("" if least == 3 else f"_{least}")
        assert {r.address: r.cluster_size for r in run[j6](spark, str(tmp_path)).collect()} == sizes
    assert got[3].input_repeated_addresses == 3 and got[4].output_repeated_addresses == 2


def test_links_grow_with_the_inputs_and_not_with_their_pairs(spark, tmp_path, monkeypatch):
    from ledgerweave.operators import entity

    lines = [(1, k, 100 + k) for k in range(40)] + [(2, k, 7) for k in (3, 5, 200)] + [(3, 300, 300)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(t, "1995-02-01") for t in (1, 2, 3, 4)], "o_orderkey long, o_orderdate string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    linked, plain = [], entity.threshold_components
    monkeypatch.setattr(entity, "threshold_components", lambda edges, *a, **k: linked.append(edges.count()) or plain(edges, *a, **k))
    got = {r.txid: r for r in entry.queries()["j7_transaction_entity_evidence"](spark, str(tmp_path)).collect()}
    assert linked == [39 + 2 + 1]  # a star a transaction and one pair that two of them spend, not 780 and 3 pairs
    one = got[1]
    assert (one.input_repeated_addresses, one.input_shared_count_max, one.input_cluster_size_max_t1, one.input_cluster_size_max_t2) == (2, 2, 41, 2)
    assert (one.input_distinct_clusters_t1, one.input_distinct_clusters_t2, one.input_distinct_clusters_t3, one.output_distinct_clusters_t1) == (1, 39, 40, 40)
    assert (got[3].input_shared_count_max, got[3].output_cluster_size_max_t1, got[4].input_distinct_clusters_t1) == (0, 1, 0)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert domain.steps(spark, "/root/testdata/sf0.001").count() > 0
