"""Components, spanning forests and states before each step, against plain walks over small graphs."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import forests, graph, temporal_graph
from ledgerweave.operators.kept import kept
from ledgerweave.plans import registry, registry_graph


def labels(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def random_edges(seed, nodes=60, n=90):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.randrange(1, 6)) for _ in range(n)]


@pytest.mark.parametrize("one_task", [1_000_000, 3])
def test_components(spark, one_task):
    edges = random_edges(1, n=50)
    df = spark.createDataFrame([e[:2] for e in edges], "a string, b string")
    got = {r.node: r.component for r in forests.components(df, one_task=one_task).collect()}
    assert got == labels([e[:2] for e in edges])
    assert forests.components(df.limit(0), one_task=one_task).collect() == []


@pytest.mark.parametrize("one_task", [1_000_000, 5])
def test_spanning_forest_is_the_least_one(spark, one_task):
    edges = sorted({(min(a, b), max(a, b), w) for a, b, w in random_edges(2) if a != b})
    df = spark.createDataFrame(edges, "a string, b string, w int").repartition(3)
    got = {tuple(r) for r in forests.spanning_forest(df, ["w"], one_task=one_task).collect()}
    want, done = set(), []
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        of = labels(done)
        if of.get(a, a) != of.get(b, b):
            want.add((a, b, w))
            done.append((a, b))
    assert got == want


def test_thresholds_in_one_search(spark):
    edges = random_edges(3)
    df = spark.createDataFrame(edges, "a string, b string, w int").filter("a <> b").repartition(4)
    got = forests.threshold_components(df, "w", (1, 3, 5)).collect()
    for k in (1, 3, 5):
        assert {r.node: r.component for r in got if r.threshold == k} == labels([e[:2] for e in edges if e[2] >= k and e[0] != e[1]])


@pytest.mark.parametrize("steps,one_task", [(1, 100), (2, 100), (7, 100), (16, 2), (49, 100)])
def test_components_before_each_step(spark, steps, one_task):
    rng = random.Random(steps)
    edges = [(rng.choice([1, 2]), f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.randint(3, steps + 2)) for _ in range(26)]
    edges = [e for e in edges if e[1] != e[2]]
    asks = [(k, f"n{x}", t) for k in (1, 2) for x in range(16) for t in range(1, steps + 6)]
    e = spark.createDataFrame(edges, "k int, a string, b string, active_from int")
    got = forests.components_before(e, spark.createDataFrame(asks, "k int, address string, time_step int"), one_task=one_task).collect()
    assert len(got) == len(asks)
    of = {(r.k, r.address, r.time_step): r for r in got}
    for k in (1, 2):
        for t in range(1, steps + 6):
            want = labels([x[1:3] for x in edges if x[0] == k and x[3] < t])
            size = {c: list(want.values()).count(c) for c in want.values()}
            rows = [of[k, f"n{x}", t] for x in range(16)]
            assert [r.component_size for r in rows] == [size.get(want.get(r.address), 1) for r in rows]
            for r in rows:
                for s in rows:
                    assert (r.component == s.component) == (want.get(r.address, r.address) == want.get(s.address, s.address))


def by_walking(steps, inputs, outputs):
    """All figures, by walking the steps in order and adding each step's transactions once it has been read."""
    count, seen, out = {}, set(), {}
    for t in sorted(set(steps.values())):
        now = [x for x in steps if steps[x] == t]
        sets = {k: labels([p for p, n in count.items() if n >= k]) for k in (1, 2, 3)}
        for x in now:
            row = []
            for side in (sorted(inputs.get(x, ())), sorted(outputs.get(x, ()))):
                degree = [sum(n >= 2 for p, n in count.items() if a in p) for a in side]
                shared = [max((n for p, n in count.items() if a in p), default=0) for a in side]
                row += [sum(v > 0 for v in degree), sum(v > 0 for v in degree) / len(side) if side else 0, max(degree, default=0), max(shared, default=0)]
                row += [len({s[a] for a in side if a in s}) for s in sets.values()]
                row += [max((list(s.values()).count(s[a]) if a in s else 1 for a in side), default=1) for s in sets.values()]
                row.append(sum(a in seen for a in side))
            out[x] = row
        for x in now:
            side = sorted(inputs.get(x, ()))
            for i, a in enumerate(side):
                for b in side[i + 1 :]:
                    count[a, b] = count.get((a, b), 0) + 1
            seen |= {*side, *outputs.get(x, ())}
    return out


def test_graph_features_equal_a_walk_over_the_steps(spark):
    rng = random.Random(4)
    steps = {x: rng.randint(1, 9) for x in range(60)}
    inputs = {x: {f"A{rng.randrange(9)}" for _ in range(rng.randint(1, 4))} for x in range(55)}
    outputs = {x: {f"A{rng.randrange(12)}" for _ in range(rng.randint(1, 3))} for x in range(5, 60)}
    s = spark.createDataFrame(list(steps.items()), "txid long, time_step int")
    i, o = (spark.createDataFrame([(x, a) for x, m in side.items() for a in m], "txid long, address string") for side in (inputs, outputs))
    got = temporal_graph.graph_features(s, i, o)
    assert len(got.columns) == 24
    want = by_walking(steps, inputs, outputs)
    for r in got.collect():
        assert [float(x) for x in r[2:]] == pytest.approx([float(x) for x in want[r.txid]])
    assert {r.check: r.failures for r in registry_graph.first_step_gates(got).collect()} == dict.fromkeys([*registry_graph._GATES, "unique_key"], 0)
    broken = got.withColumn("entity_input_address_count", F.when(F.col("time_step") == 1, F.lit(2)).otherwise(F.col("entity_input_address_count")))
    found = {r.check: r.failures for r in registry_graph.first_step_gates(broken).collect()}
    assert found["entity_input_address_count"] == sum(t == 1 for t in steps.values()) and sum(found.values()) == found["entity_input_address_count"]


def test_members_are_made_once_for_the_features(spark, monkeypatch):
    steps = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "txid long, time_step int")
    inputs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "c")], "txid long, address string")
    plans, whole = [], temporal_graph.kept
    monkeypatch.setattr(temporal_graph, "kept", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or whole(df))
    got = {r.txid: r for r in temporal_graph.graph_features(steps, inputs, inputs).collect()}
    assert (got[2].input_repeated_cosponsor_count, got[2].input_max_shared_transaction_count, got[2].input_max_cluster_size_t1, got[1].input_max_cluster_size_t1) == (0, 1, 3, 1)
    assert [c for c, _ in plans] == [["txid", "address", "time_step"]] * 2 + [["a", "b", "time_step", "n", "upto"], ["address", "time_step"], plans[-1][0]]
    assert all("Join" not in p for c, p in plans[2:4])  # pairs and asks come from the kept members
    pairs = temporal_graph.pair_counts(inputs, steps).collect()
    assert sorted((r.a, r.b, r.time_step, r.n, r.upto) for r in pairs) == [("a", "b", 1, 1, 1), ("a", "b", 2, 1, 2), ("a", "c", 1, 1, 1), ("b", "c", 1, 1, 1)]


def test_the_first_step_is_checked_without_later_ones(spark, sf_dir, monkeypatch):
    asked, whole = [], temporal_graph.graph_features
    monkeypatch.setattr(temporal_graph, "graph_features", lambda s, i, o: asked.append(s) or whole(s, i, o))
    got = registry_graph.q9(spark, sf_dir).collect()
    first = registry_graph.d.steps(spark, sf_dir).agg(F.min("time_step")).first()[0]
    assert {r.time_step for r in asked[0].collect()} == {first} and asked[0].count() == registry_graph.d.steps(spark, sf_dir).filter(F.col("time_step") == first).count()
    assert {r.check: r.failures for r in got} == dict.fromkeys([*registry_graph._GATES, "unique_key"], 0)


@pytest.mark.parametrize("sent", [1000, 0])
def test_shortest_paths_against_a_plain_walk(spark, sent, monkeypatch):
    edges = [(f"e{i}", a, b) for i, (a, b, _) in enumerate(random_edges(5, nodes=40, n=48))]
    near = {}
    for _, a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walk(source, target, most):
        paths = {source: [source]}
        front = dict(paths)
        for _ in range(most):
            if target in paths:
                break
            found = {}
            for x, p in front.items():
                for y in near.get(x, ()):
                    if y not in paths:
                        found[y] = min(found.get(y, [*p, y]), [*p, y])
            paths |= found
            front = found
        return paths.get(target, [])

    made = []
    monkeypatch.setattr(graph, "kept", lambda df: made.append(df.columns) or df.localCheckpoint())
    df = spark.createDataFrame(edges, "edge_id string, source string, target string")
    nodes = sorted(near)
    for source, target, most in ((nodes[0], nodes[-1], 6), (nodes[1], nodes[7], 6), (nodes[3], nodes[20], 3), (nodes[5], nodes[9], 2)):
        got = [r.node for r in graph.shortest_path(df, source, target, most, sent).orderBy("hop").collect()]
        assert got == walk(source, target, most)
    assert made.count(["a", "b"]) == 4  # the edges are made once a search, not once a round


def test_a_forest_of_many_nodes_is_not_made_anew_a_batch(monkeypatch):
    calls, plain = [], forests.kruskal
    monkeypatch.setattr(forests, "HELD", 20)
    monkeypatch.setattr(forests, "kruskal", lambda e: calls.append(len(e)) or plain(e))
    path = pd.DataFrame({"a": [f"n{i}" for i in range(1000)], "b": [f"n{i + 1}" for i in range(1000)]})
    out = list(forests._local([])(path[i : i + 10] for i in range(0, 1000, 10)))
    assert sum(map(len, out)) == 1000
    assert sum(calls) < 5000  # edges that were looked at; in proportion to those given


def test_equal_fees_are_one_value_whatever_the_order_of_adding(spark, tmp_path):
    orders = [(k, 1, "F", 1.0, datetime(1996, 1, k + 1), "1") for k in range(3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    fees = [(0, (0.1, 0.2, 0.3)), (1, (0.3, 0.2, 0.1)), (2, (0.1, 0.2, 0.4))]
    lines = [(k, i, i, price, 0.0, 1.0) for k, prices in fees for i, price in enumerate(prices)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_tax double")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["column"]: r.distinct for r in registry.QUERIES["a26_column_audit"](spark, str(tmp_path)).collect()}
    assert got["fee_btc"] == 2


def test_a_step_reads_its_own_folder(spark):
    df = spark.createDataFrame([(k, k % 5) for k in range(50)], "txid long, time_step int")
    step = kept(df, "time_step", "txid").filter("time_step = 3")
    assert sorted(r.txid for r in step.collect()) == list(range(3, 50, 5))
    assert all("time_step=3" in f for f in {r.f for r in step.select(F.input_file_name().alias("f")).collect()})
    assert kept(df.limit(0), "time_step", "txid").count() == 0


def test_asks_before_any_edge_need_no_search(spark, monkeypatch):
    searched = []
    plain = forests.components
    monkeypatch.setattr(forests, "components", lambda *a, **k: searched.append(1) or plain(*a, **k))
    e = spark.createDataFrame([(1, "a", "b", 2), (1, "b", "c", 4), (2, "a", "b", 5)], "k int, a string, b string, active_from int")
    asks = lambda rows: spark.createDataFrame(rows, "k int, address string, time_step int")
    early = forests.components_before(e, asks([(1, "a", 2), (1, "c", 4), (2, "b", 5), (2, "c", 9)])).collect()
    assert sorted((r.k, r.address, r.component, r.component_size) for r in early) == [(1, "a", "a", 1), (1, "c", "c", 1), (2, "b", "b", 1), (2, "c", "c", 1)]
    assert not searched
    both = forests.components_before(e, asks([(1, "c", 4), (1, "c", 5)])).collect()
    assert sorted((r.time_step, r.component_size) for r in both) == [(4, 1), (5, 3)] and searched


def test_a_forest_is_that_of_taking_edges_one_by_one():
    rng = np.random.default_rng(8)
    for n, m in ((1, 3), (2, 5), (9, 12), (200, 150), (200, 2000)):
        edges = pd.DataFrame({"a": rng.integers(0, n, m), "b": rng.integers(0, n, m)})
        group = {x: {x} for x in range(n)}
        want = []
        for x, y in zip(edges["a"], edges["b"], strict=True):
            want.append(group[x] is not group[y])
            if want[-1]:
                whole = group[x] | group[y]
                group |= dict.fromkeys(whole, whole)
        assert forests.kruskal(edges).index.tolist() == [i for i, w in enumerate(want) if w]
        stars = pd.concat(forests._stars(iter([edges])))
        assert all(min(group[x]) == c for x, c in zip(stars["node"], stars["component"], strict=True)) and set(stars["node"]) == {*edges["a"], *edges["b"]}
