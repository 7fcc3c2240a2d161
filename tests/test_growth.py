"""Plans whose cost must not grow faster than the input, and the results that they must still give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import behavior, boosting, entity, ordering, profile
from ledgerweave.plans import registry, registry_models, registry_more, registry_risk, registry_sources  # noqa: F401  the last adds to the first


def _optimized(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_predecessors_are_made_once_and_not_moved(spark):
    steps = spark.createDataFrame([(1, 1), (2, 3), (3, 11), (4, 12), (5, 30)], "txid long, time_step int")
    values = spark.createDataFrame([(1, 10.0), (2, 8.0), (3, 0.0), (4, 4.0), (5, 1.0)], "txid long, value double")
    outputs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "c"), (2, "b"), (2, "d"), (3, "a"), (3, None)], "txid long, address string")
    inputs = spark.createDataFrame([(2, "c"), (2, "b"), (2, "a"), (2, "a"), (3, "d"), (3, "b"), (4, "a"), (4, "b"), (4, "c"), (5, "a"), (5, None), (1, "z")], "txid long, address string")
    found = behavior.causal_predecessors(steps, values, inputs, outputs)
    assert sorted(map(tuple, found.collect())) == [(2, 1, 3, 2, 0.2), (3, 1, 1, 10, 1.0), (3, 2, 2, 8, 1.0), (4, 2, 1, 9, 0.5), (4, 3, 1, 1, None)]
    plan = _optimized(found)
    first = next(i for i, line in enumerate(plan) if "Join" in line)
    assert "block" in plan[first]
    assert not any("Aggregate" in line for line in plan[:first])


def test_lone_predecessors_are_not_carried_through_the_rounds(spark, monkeypatch):
    steps = spark.createDataFrame([(t, 1) for t in range(1, 31)] + [(50, 3), (60, 5), (70, 20)], "txid long, time_step int")
    links = [(50, t, 0.5) for t in range(1, 31)] + [(60, 50, 0.5), (60, 2, 0.5), (60, 30, 0.5), (70, 60, 0.99)]
    rounds = []
    whole = behavior.kept

    def counted(df, by=None, key=None):
        out = whole(df, by, key)
        if by is not None:
            rounds.append(out.count())
        return out

    monkeypatch.setattr(behavior, "kept", counted)
    got = {r.txid: r.chain for r in behavior.longest_chains(steps, spark.createDataFrame(links, "txid long, previous long, reduction double")).collect()}
    assert got[50] == ["1", "50"] and got[60] == ["1", "50", "60"] and got[70] == ["70"] and got[2] == ["2"] and len(got) == 33
    assert sum(rounds) == 3  # the smallest lone predecessor of 50 and of 60, and the link from 60 to 50


def test_plans_of_chains_do_not_grow_with_the_rounds(spark):
    steps = spark.createDataFrame([(t, t) for t in range(1, 15)], "txid long, time_step int")
    links = spark.createDataFrame([(t, t - 1, 0.5) for t in range(2, 15)] + [(9, 3, 0.5)], "txid long, previous long, reduction double")
    found = behavior.longest_chains(steps, links)
    assert sum("Relation " in line for line in _optimized(found)) == 2  # the linked transactions, and all rounds in one scan
    got = {r.txid: r.chain for r in found.collect()}
    assert got == {t: [str(k) for k in range(max(1, t - 9), t + 1)] for t in range(1, 15)}


def test_the_entity_signal_searches_one_threshold(spark, sf_dir, monkeypatch):
    asked, plain = [], entity.threshold_components
    monkeypatch.setattr(entity, "threshold_components", lambda edges, weight, thresholds: asked.append(thresholds) or plain(edges, weight, thresholds))
    registry.forget(spark)
    whole = registry.entity_sides(spark, sf_dir)
    got = registry_risk.entity_signal(spark, sf_dir)
    assert asked == [(1, 2, 3), (1,)]
    want = registry_risk.risk.entity_signal(whole, registry_risk.ENTITY, ("time_step", *registry_risk.COUNTS))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_of_two_leaves_of_a_split_the_smaller_is_counted():
    rng = np.random.default_rng(3)
    bins, scores, label = rng.integers(0, 40, (500, 2)).astype(np.uint8), rng.normal(size=(500, 2)), rng.integers(0, 2, 500).astype(np.int32)
    label[bins[:, 0] < 10] = 1
    batch = pa.record_batch([pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([r.tobytes() for r in scores], pa.binary()), pa.array(label), pa.array(np.ones(500)), pa.array(np.arange(500))], names=["bins", "scores", "label", "weight", "draw"])
    trees, before = [boosting.Growing(), boosting.Growing()], [{}, {}]
    for level in range(3):
        found = pa.Table.from_batches(list(boosting._histograms(trees, 2, 0, 1.0)([batch]))).to_pandas()
        for k, tree in enumerate(trees):
            mine = found[found["k"] == k]
            assert mine["leaf"].nunique() == (1 if level == 0 else len(tree.open) // 2)
            before[k] = boosting.level_sums(tree, mine, 2, before[k])
            assert sorted(before[k]) == sorted(tree.open)
            at = tree.leaves(bins)
            for node in tree.open:
                assert np.array_equal(before[k][node][2, 1, :40], np.bincount(bins[at == node, 1], minlength=40))
            boosting.grow_level(tree, {slot: before[k][node] for slot, node in enumerate(tree.open)}, np.ones(2, bool), boosting.Settings(least_rows=5))


def test_features_of_a_transaction_come_from_one_pass(spark):
    rows, columns = registry_models.unified(spark, "/root/testdata/sf0.001")
    plan = _optimized(rows)
    assert sum("Relation" in line and "l_partkey" in line for line in plan) == 1
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert len(columns) == len(set(columns)) == 44 and columns[0] == "amount_features_missing" and columns[-1] == "is_late_period"


def test_tasks_that_count_pairs_grow_with_the_pairs(spark, monkeypatch):
    rows = [(t, f"A{(t + 3 * k) % 17}") for t in range(40) for k in range(5)] + [(1, "A1"), (None, "A1"), (None, "A2")]
    inputs = spark.createDataFrame(rows, "txid long, address string")
    want = {}
    for t in range(40):
        mine = sorted({a for u, a in rows if u == t})
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    parts = []
    for limit in (100, 25):
        monkeypatch.setattr(entity, "PAIRS_A_TASK", limit, raising=False)
        found = entity.cospend_pairs(inputs)
        assert {(r.a, r.b): r.shared_count for r in found.collect()} == want
        parts.append(found.rdd.getNumPartitions())
    assert parts == [7, 25]


def test_a_fit_does_not_make_its_rows_anew(spark):
    plan = _optimized(registry_more._predicted(spark, "/root/testdata/sf0.001", "logistic"))
    assert not any("l_orderkey" in line or "o_orderkey" in line for line in plan)


def test_an_import_profile_gathers_no_lists(spark, sf_dir):
    plan = _optimized(registry.QUERIES["a16_a17_import_profile"](spark, sf_dir))
    assert not any("collect_set" in line or "sort_array" in line for line in plan)
    assert sum("Relation" in line and "l_partkey" in line for line in plan) == 1
    assert not any("l_extendedprice" in line and "Aggregate" in line for line in plan)
    assert not any("Relation" in line and "user_id" in line for line in plan)


def test_an_import_profile_counts_each_wallet_once(spark):
    tx = spark.createDataFrame([(1, 10.0, 9.0, 0.5), (2, 4.0, None, 0.25), (3, None, None, None)], "txid long, input_btc_total double, output_btc_total double, fee_btc double")
    addresses = spark.createDataFrame([(1, "W1", "W2"), (1, "W1", "W3"), (2, "W2", "W9"), (2, None, "W9"), (2, "W4", None)], "txid long, input_address string, output_address string")
    seen = spark.createDataFrame([("a", "x", 1, 5, "C1", 7), ("b", "x", 1, None, "C1", None), ("a", "y", 1, 6, None, 7)], "src_ip string, dst_ip string, src_port int, dst_port int, geo_country string, asn long")
    seen = seen.withColumn("timestamp", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = {(r.part, r.name): (r.n, r.percentage, r.amount) for r in profile.import_profile(tx, addresses, seen).collect()}
    unique = {name: n for (part, name), (n, _, _) in got.items() if part == "unique"}
    assert unique == {"src_ip": 2, "dst_ip": 2, "src_port": 1, "dst_port": 2, "day": 1, "country": 1, "asn": 1, "input_wallets": 3, "output_wallets": 3, "wallets": 5}
    assert got["country", "C1"] == (2, 100.0, None) and got["asn", "7"] == (2, 100.0, None) and got["day", "2024-01-02"] == (3, 100.0, None)
    assert got["input", "median"] == (2, None, 7.0) and got["input", "total"] == (2, None, 14.0) and got["output", "mean"] == (1, None, 9.0) and got["fee", "max"] == (2, None, 0.5)
    assert len(got) == 10 + 3 + 15
    assert profile.import_profile(tx.limit(0), addresses.limit(0), seen.limit(0)).collect() == []


def test_only_values_next_to_the_median_are_put_in_order(spark, monkeypatch):
    ordered, whole = [], ordering.running_sums

    def counted(df, order, **sums):
        ordered.append(df.count())
        return whole(df, order, **sums)

    monkeypatch.setattr(ordering, "running_sums", counted)
    tx = spark.range(5000).select(F.col("id").alias("txid"), (F.col("id") * 1.0).alias("input_btc_total"), (F.col("id") % 2 * 3.0).alias("output_btc_total"), F.lit(None).cast("double").alias("fee_btc"))
    none = spark.createDataFrame([], "input_address string, output_address string, src_ip string, dst_ip string, src_port int, dst_port int, geo_country string, asn long, timestamp timestamp")
    got = {(r.part, r.name): r.amount for r in profile.import_profile(tx, none, none).collect()}
    assert got["input", "median"] == 2499.5 and got["output", "median"] == 1.5 and len(got) == 10
    assert sum(ordered) < 400  # of 5002 distinct amounts


def test_a_percentile_of_few_groups_is_exact_whatever_its_window(spark):
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=801), "skewed": rng.exponential(size=400) ** 6, "equal": np.full(50, 2.0), "one": np.array([-3.0]), "two": np.array([1.0, 4.0]), "steps": rng.integers(0, 3, 300) * 1.0}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)], "g string, v double").repartition(3)
    for share in (0.5, 0.95):
        for margin in (0.01, 0.0, -0.04):  # the last bounds a window that holds nothing, so the whole group is ordered
            got = {r.g: r.value for r in ordering.percentile_of_few(rows, "g", "v", share, margin).collect()}
            assert got == {k: pytest.approx(float(np.percentile(xs, 100 * share))) for k, xs in groups.items()}
