"""Saved models: a node table and a schema beside it, checked against one another when they are read.

Both lie in one folder that driver and executors share.  A model that is incomplete, or
whose parts do not belong together, is refused, and so are rows that it cannot score.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import boosting, ml
from ledgerweave.operators.trees import Tree, Trees
from ledgerweave.sources.readers import write_text

_NODES = "tree int, node int, feature int, cut double, left int, right int, cover double, value array<double>"


def _rows(trees: Trees) -> list[tuple]:
    return [
        (t, n, int(tree.feature[n]), float(tree.cut[n]), int(tree.left[n]), int(tree.right[n]), float(tree.cover[n]), [float(v) for v in tree.value[n]])
        for t, tree in enumerate(trees.trees) for n in range(len(tree.feature))
    ]


def _digest(rows: list[tuple]) -> str:
    return hashlib.sha256(json.dumps(rows).encode()).hexdigest()


def save(spark: SparkSession, path: str, trees: Trees, imputer: dict, labels: list[int]) -> None:
    """``labels``: the original class of each encoded one.  The schema is written last, so that a folder without it is no model."""
    rows = _rows(trees)
    spark.createDataFrame(rows, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    schema = {
        "features": imputer["columns"], "feature_count": len(imputer["columns"]), "transformed": trees.columns, "transformed_count": len(trees.columns), "medians": imputer["medians"], "flags": imputer["flags"],
        "labels": labels, "base": [float(v) for v in trees.base], "trees": len(trees.trees), "nodes_sha256": _digest(rows),
    }
    write_text(spark, json.dumps(schema, indent=1, sort_keys=True), f"{path}/schema.json")


class SavedModel:
    """A model read back; every disagreement between its parts is a ValueError that names it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        for part in ("nodes", "schema.json"):
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
            if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
                raise FileNotFoundError(f"{path}/{part}")
        text = spark.read.text(f"{path}/schema.json", wholetext=True).first()
        try:
            s = json.loads(text.value)
        except (AttributeError, ValueError) as e:
            raise ValueError("the schema is no JSON") from e
        rows = [tuple(r) for r in spark.read.schema(_NODES).parquet(f"{path}/nodes").orderBy("tree", "node").collect()]  # as many as the model has nodes
        if not s.get("features"):
            raise ValueError("the schema names no features")
        wanted = [*s["features"], *(f"{c}_missing" for c in s["flags"])]
        for name, ok in {
            "feature_count": s["feature_count"] == len(s["features"]), "transformed": s["transformed"] == wanted, "transformed_count": s["transformed_count"] == len(s["transformed"]), "medians": set(s["medians"]) == set(s["features"]),
            "labels": len(set(s["labels"])) == len(s["labels"]) == len(s["base"]), "trees": s["trees"] == len({r[0] for r in rows}), "nodes_sha256": s["nodes_sha256"] == _digest(rows),
        }.items():
            if not ok:
                raise ValueError(f"the model and its schema disagree: {name}")
        by: dict[int, list[tuple]] = {}
        for r in rows:
            by.setdefault(r[0], []).append(r)
        columns = lambda own: [np.array([r[k] for r in own]) for k in range(2, 8)]
        self.labels, self.imputer = s["labels"], {"columns": s["features"], "medians": s["medians"], "flags": s["flags"]}
        self.trees = Trees(s["transformed"], [Tree(*columns(own)) for own in by.values()], np.array(s["base"]))

    def checked(self, df: DataFrame) -> DataFrame:
        """The features as numbers; what is no number is null.  A missing column or an infinite value is refused."""
        lacking = [c for c in self.imputer["columns"] if c not in df.columns]
        if lacking:
            raise ValueError(f"features are missing: {', '.join(lacking)}")
        df = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in self.imputer["columns"]})
        one = df.agg(*(F.count_if(F.abs(F.col(c)) == float("inf")).alias(c) for c in self.imputer["columns"])).first()
        infinite = [c for c in self.imputer["columns"] if one[c]]
        if infinite:
            raise ValueError(f"infinite values: {', '.join(infinite)}")
        return df

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep``, the original class, the confidence, and the probabilities in the order of ``labels``."""
        filled, _ = ml.impute(self.checked(df), self.imputer)
        out = boosting.predict(filled, self.trees, keep)
        return out.withColumn("predicted_class", F.get(F.array(*map(F.lit, self.labels)), F.col("predicted"))).select(*keep, "predicted_class", "confidence", "probabilities")


def scoring_checks(rows: DataFrame, scored: DataFrame, key: str, labels: list[int]) -> DataFrame:
    """check, failures of a scoring: rows lost or gained, repeated keys, unknown classes, probabilities that do not add up to 1, and confidences that are not their largest."""
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    one = scored.agg(
        (F.count("*") - F.countDistinct(key)).alias("unique_key"), F.count_if(~F.col("predicted_class").isin(labels)).alias("known_class"), F.count_if(F.abs(total - 1) > 1e-6).alias("adds_up"), F.count_if(F.col("confidence") != F.array_max("probabilities")).alias("confidence")
    )
    both = rows.select(key).distinct().join(scored.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "full").agg(F.count_if(F.col("__k").isNull()).alias("lost"), F.count_if(F.col(key).isNull()).alias("gained"))
    one = one.crossJoin(both)  # one row each
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("failures")) for c in one.columns))).alias("e")).select("e.*")
