"""Saved models that are refused when their parts disagree, and layouts that reads prune."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import artifacts, boosting, layout, ml, positional
from ledgerweave.sources.readers import write_text


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    rows = spark.createDataFrame([(k, k % 3, 1.0, float(k % 7) if k % 11 else None, float(k % 3 * 2)) for k in range(200)], "id long, label int, weight double, x double, y double")
    imputer = ml.fit_imputer(rows, ["x", "y"])
    filled, names = ml.impute(rows, imputer)
    model = boosting.fit(filled, "id", names, 3, boosting.Settings(iterations=2, rate=0.5, least_rows=5))
    artifacts.save(spark, path, model, imputer, [1, 2, 3])
    return path, rows, boosting.predict(filled, model, ["id"])


def test_scores_are_those_of_the_model(spark, saved):
    path, rows, want = saved
    model = artifacts.SavedModel(spark, path)
    got = model.score(rows, ["id"])
    expected = {r.id: (r.predicted + 1, pytest.approx(r.probabilities)) for r in want.collect()}
    assert {r.id: (r.predicted_class, r.probabilities) for r in got.collect()} == expected
    assert {r["check"]: r.failures for r in artifacts.scoring_checks(rows, got, "id", [1, 2, 3]).collect()} == dict.fromkeys(("unique_key", "known_class", "adds_up", "confidence", "lost", "gained"), 0)
    broken = got.filter("id <> 3").withColumn("predicted_class", F.when(F.col("id") == 4, 9).otherwise(F.col("predicted_class")))
    found = {r["check"]: r.failures for r in artifacts.scoring_checks(rows, broken, "id", [1, 2, 3]).collect()}
    assert found["lost"] == 1 and found["known_class"] == 1
    text = rows.withColumn("x", F.when(F.col("id") == 5, "n/a").otherwise(F.col("x").cast("string")))
    assert model.score(text, ["id"]).count() == 200


def test_rows_that_cannot_be_scored(spark, saved):
    model = artifacts.SavedModel(spark, saved[0])
    with pytest.raises(ValueError, match="missing: y"):
        model.score(saved[1].drop("y"), ["id"])
    with pytest.raises(ValueError, match="infinite values: x"):
        model.score(saved[1].withColumn("x", F.lit(float("-inf"))), ["id"])


@pytest.mark.parametrize("change,reason", [
    ({"features": []}, "no features"), ({"feature_count": 9}, "feature_count"), ({"transformed": ["x", "y"]}, "transformed"), ({"labels": [1, 1, 2]}, "labels"), ({"trees": 1}, "trees"), ({"nodes_sha256": "0"}, "nodes_sha256"), ({"medians": {"x": 1.0}}, "medians"),
])
def test_parts_that_disagree(spark, saved, tmp_path, change, reason):
    text = spark.read.text(f"{saved[0]}/schema.json", wholetext=True).first().value
    path = str(tmp_path / "m")
    spark.read.parquet(f"{saved[0]}/nodes").write.parquet(f"{path}/nodes")
    with pytest.raises(FileNotFoundError):
        artifacts.SavedModel(spark, path)
    write_text(spark, json.dumps(json.loads(text) | change), f"{path}/schema.json")
    with pytest.raises(ValueError, match=reason):
        artifacts.SavedModel(spark, path)
    write_text(spark, "{", f"{path}/schema.json")
    with pytest.raises(ValueError, match="no JSON"):
        artifacts.SavedModel(spark, path)


def test_steps_replace_only_themselves(spark, tmp_path):
    path = str(tmp_path / "steps")
    rows = spark.createDataFrame([(k, k % 4) for k in range(40)], "txid long, time_step int")
    layout.write_by_step(rows, path)
    layout.write_by_step(rows.filter("time_step = 2").withColumn("txid", F.col("txid") + 100), path)
    got = spark.read.parquet(path)
    assert {r.time_step: r["count"] for r in got.groupBy("time_step").count().collect()} == dict.fromkeys(range(4), 10)
    assert got.filter("time_step = 2").agg(F.min("txid")).first()[0] == 102
    assert "PartitionFilters: [isnotnull(time_step" in got.filter("time_step = 2")._jdf.queryExecution().toString()


def test_history_of_an_address_reads_one_bucket(spark, tmp_path):
    rows = spark.createDataFrame([(f"A{k % 50}", k % 9, k, "INPUT" if k % 2 else "OUTPUT") for k in range(500)], "address string, time_step int, txid long, role string")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored LOCATION '{tmp_path}'")
    layout.store_by_address(rows, "stored.roles", 8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # the plan then shows what is pruned
    try:
        found = layout.history_of(spark, "stored.roles", "A7")
        plan = found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    assert [tuple(r) for r in found.collect()] == sorted((tuple(r) for r in rows.collect() if r.address == "A7"), key=lambda r: (r[1], str(r[2]), r[3]))
    with pytest.raises(KeyError):
        layout.history_of(spark, "stored.roles", "nobody")
    spark.sql("DROP DATABASE stored CASCADE")


def test_blocks_by_position(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("txid"), (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"))
    for name, n in (("a", 7), ("b", 3)):
        positional.write_ordered(rows.select("txid", name).repartition(n), str(tmp_path / name), "txid")
    a, b = (positional.numbered(spark, str(tmp_path / n)) for n in "ab")
    assert [r.ordinal for r in a.orderBy("txid").collect()] == list(range(1000))
    got = positional.side_by_side({"a": a, "b": b}, "txid")
    assert got.columns == ["ordinal", "txid", "a", "b"] and got.filter("ordinal <> txid or a <> 2 * txid or b <> 3 * txid").count() == 0
    for change, reason in ((b.filter("txid < 900"), "unequal length"), (b.withColumn("txid", F.when(F.col("txid") == 5, 6).otherwise(F.col("txid"))), r"\{'b': 1\}"), (b.withColumnRenamed("b", "a"), "more than one block: a")):
        with pytest.raises(ValueError, match=reason):
            positional.side_by_side({"a": a, "b": change}, "txid")
    twice = [x.withColumn("txid", F.when(F.col("txid") == 5, 6).otherwise(F.col("txid"))) for x in (a, b)]
    with pytest.raises(ValueError, match="repeat"):
        positional.side_by_side({"a": twice[0], "b": twice[1]}, "txid")
