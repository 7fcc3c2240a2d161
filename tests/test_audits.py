"""Each audit finds nothing in right results and names what was broken."""

import pytest
from pyspark.sql import functions as F

from ledgerweave import domain as d
from ledgerweave.operators import audits, behavior, ordering, risk
from ledgerweave.plans import registry, registry_audits, registry_risk


def failures(df):
    return {r["check"]: r.failures for r in df.collect() if r.failures}


def test_chains(spark, sf_dir):
    steps, rows, values = d.steps(spark, sf_dir), d.address_rows(spark, sf_dir), registry._values(spark, sf_dir)
    chains = behavior.longest_chains(steps, registry._pred(spark, sf_dir)).select("txid", "chain").checkpoint()
    replay = lambda c: failures(audits.replay_chains(c, steps, rows, values))
    assert replay(chains) == {}
    long = chains.filter(F.size("chain") > 2).orderBy("txid").first()
    others = chains.filter(F.col("txid") != long.txid)
    put = lambda *members: others.unionByName(spark.createDataFrame([(long.txid, [str(m) for m in members])], "txid long, chain array<string>"))
    assert set(replay(others)) == {"every_transaction"}
    assert "ends_at_itself" in replay(put(*long.chain[:-1])) and "length" in replay(put())
    assert "begins_at_the_beginning" in replay(put(*long.chain[1:]))
    backwards = replay(put(long.chain[-1], *long.chain[1:]))
    assert {"no_member_twice", "forward_in_time", "value_is_peeled"} <= set(backwards)
    assert "members_known" in replay(put(-1, long.txid))
    assert {"one_chain_each"} <= set(replay(chains.unionByName(chains.limit(1))))
    step = steps.filter(F.col("txid") == long.txid).first().time_step
    made = rows.select("output_address").join(rows.filter(F.col("txid") == long.txid).select(F.col("input_address").alias("output_address")), "output_address", "left_semi")
    far = rows.join(made, "output_address", "left_anti").join(steps.filter(F.col("time_step") == step - 1), "txid").select("txid").distinct().join(rows.join(made, "output_address", "left_semi").select("txid"), "txid", "left_anti").first()
    if far is not None:
        assert "common_address" in replay(put(far.txid, long.txid))


def test_mixing_and_fusion(spark, sf_dir):
    steps, rows, m = d.steps(spark, sf_dir), d.address_rows(spark, sf_dir), registry.mixing(spark, sf_dir).checkpoint()
    assert failures(audits.replay_mixing(m, steps, rows)) == {}
    wrong = m.withColumn("fan_in_flag", F.when(F.col("txid") == 1, ~F.col("fan_in_flag")).otherwise(F.col("fan_in_flag")))
    assert failures(audits.replay_mixing(wrong, steps, rows)) == {"fan_in_flag": 1}
    assert failures(audits.replay_mixing(m.withColumn("mixing_evidence_score", F.col("mixing_evidence_score") + 0.01), steps, rows)) == {"mixing_evidence_score": m.count()}
    assert set(failures(audits.replay_mixing(m.filter("txid <> 1"), steps, rows))) >= {"every_transaction", "input_count"}
    peels = steps.select("txid", "time_step", (F.col("txid") % 5 / 5).alias("peeling_evidence_score"), (F.col("txid") % 2 == 0).alias("peeling_candidate"))
    both = behavior.behavioral_evidence(peels, m).checkpoint()
    assert failures(audits.replay_fusion(both, peels, m)) == {}
    assert failures(audits.replay_fusion(both.withColumn("behavioral_level", F.when(F.col("txid") == 1, "X").otherwise(F.col("behavioral_level"))), peels, m)) == {"level": 1}
    assert failures(audits.replay_fusion(both.withColumn("behavioral_signal_count", F.lit(3)), peels, m)) == {"signal_count": both.count()}


def test_alerts(spark, sf_dir):
    channels = registry_risk.given_channels(spark, sf_dir)
    a = risk.ranked_alerts(risk.scores(channels)).checkpoint()
    assert failures(audits.replay_alerts(a, channels)) == {}
    one = F.col("investigation_rank") == 5
    change = lambda c, v: failures(audits.replay_alerts(a.withColumn(c, F.when(one, v).otherwise(F.col(c))), channels))
    assert set(change("risk_score", F.lit(0.0))) >= {"risk_score", "scores_fall_with_rank"}
    assert change("alert_priority", F.lit("LOWEST")) == {"alert_priority": 1}
    assert "ranks_in_sequence" in change("investigation_rank", F.lit(6).cast("long"))
    assert set(failures(audits.replay_alerts(a.filter(~one), channels))) >= {"every_transaction", "ranks_in_sequence"}


def test_ends(spark):
    edges = spark.createDataFrame([("tx:1", "wallet:a"), ("tx:2", "ip:x"), ("tx:1", "moon:1")], "source string, target string")
    known = {k: spark.createDataFrame([(v,) for v in vs], "node_id string") for k, vs in {"tx": ["tx:1"], "wallet": ["wallet:a"], "ip": ["ip:y"]}.items()}
    assert failures(audits.unknown_ends(edges, known)) == {"other": 1, "tx": 1, "ip": 1}


def test_percentiles_by_group(spark):
    rows = spark.createDataFrame([(g, float((k * 7919) % 13) if k % 9 else None) for g in ("a", "b", None) for k in range(40 if g else 5)], "g string, v double")
    want = {r.g: (r.m, r.p) for r in rows.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.95)).alias("p")).collect() if r.g}
    got = {r.g: (r.m, r.p) for r in ordering.percentiles_by(rows.filter("g is not null"), "g", "v", {"m": 0.5, "p": 0.95}).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_registered():
    assert {"q1_chains_replayed", "q8_j21_alerts_replayed", "d12_unknown_ends"} <= set(registry.SQL) and registry_audits.q1


def test_unknown_ends_make_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame([("tx:1", "wallet:a"), ("wallet:b", "tx:1"), ("ip:9", "tx:3"), ("x:1", "tx:1")], "source string, target string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "node_id string")
    got = audits.unknown_ends(rows.mapInPandas(seen, "source string, target string"), {"tx": names("tx:1"), "wallet": names("wallet:a", "wallet:b"), "ip": names("ip:9")})
    assert {r.check: r.failures for r in got.collect()} == {"other": 1, "tx": 1, "wallet": 0, "ip": 0}
    assert read.value == 4
