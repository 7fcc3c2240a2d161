"""Chronological splits, models of Spark ML, metrics as plans, calibration and isolation trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.ordering import running_sums, value_counts


def step_split(steps: DataFrame, train: float = 0.6, validation: float = 0.8) -> DataFrame:
    """time_step, n, part: distinct steps in order, cut at whole steps so that no step is in two parts."""
    distinct = steps.select("time_step").distinct()
    n = F.row_number().over(Window.orderBy("time_step"))  # one row a step
    k = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    part = F.when(n <= F.floor(k * train), "train").when(n <= F.floor(k * validation), "validation").otherwise("test")
    return distinct.select("time_step", n.alias("n"), part.alias("part"))


def with_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    """A 0/1 column for each feature that can be missing."""
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns})


def pipeline(columns: list[str], model: str, seed: int = 42) -> Pipeline:
    """Median imputation, missing indicators, scaling where it helps, and a classifier of ``label`` (0 .. k - 1), weighted by ``weight``."""
    filled = [f"{c}_filled" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=[*filled, *(f"{c}_missing" for c in columns)], outputCol="raw_features")]
    if model == "logistic":
        stages += [StandardScaler(withMean=True, inputCol="raw_features", outputCol="features"), LogisticRegression(maxIter=60, weightCol="weight", featuresCol="features")]
    elif model == "forest":
        stages.append(RandomForestClassifier(numTrees=60, maxDepth=10, minInstancesPerNode=2, weightCol="weight", featuresCol="raw_features", seed=seed))
    elif model == "boosting":
        stages.append(OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, featuresCol="raw_features", seed=seed), featuresCol="raw_features"))
    else:
        raise ValueError(model)
    return Pipeline(stages=stages)


def balanced(df: DataFrame) -> DataFrame:
    """A weight that makes all classes count alike: one small table of class counts, joined on the label."""
    n = df.groupBy("label").agg(F.count("*").alias("__n"))
    total = F.sum("__n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    k = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.join(F.broadcast(n.select("label", (total / (k * F.col("__n"))).alias("weight"))), "label")  # one row a class


def train(df: DataFrame, columns: list[str], model: str) -> PipelineModel:
    return pipeline(columns, model).fit(balanced(with_indicators(df, columns)))


def predict(model: PipelineModel, df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with probabilities (array), predicted class and confidence."""
    out = model.transform(with_indicators(df, columns).withColumn("weight", F.lit(1.0)))
    p = vector_to_array("probability")
    return out.withColumn("probabilities", p).withColumn("predicted", F.col("prediction").cast("int")).withColumn("confidence", F.array_max(p)).select(*df.columns, "probabilities", "predicted", "confidence")


def classification_metrics(df: DataFrame) -> DataFrame:
    """accuracy, macro F1, log loss and Brier score of (label, predicted, probabilities), in one pass and a small roll-up."""
    truth = F.get("probabilities", F.col("label").cast("int"))
    brier = F.aggregate(F.zip_with("probabilities", F.transform(F.sequence(F.lit(0), F.size("probabilities") - 1), lambda i: (i == F.col("label")).cast("double")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    rows = df.select("label", "predicted", (-F.log(F.greatest(truth, F.lit(1e-15)))).alias("loss"), brier.alias("brier"))
    cells = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"), F.sum("brier").alias("brier"))
    by_class = cells.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e"), "n", (F.col("label") == F.col("predicted")).alias("hit"))
    f1 = by_class.groupBy("e.c").agg(F.sum(F.col("n") * F.col("e.t")).alias("t"), F.sum(F.col("n") * F.col("e.p")).alias("p"), F.sum(F.when(F.col("hit") & (F.col("e.t") == 1), F.col("n")).otherwise(0)).alias("h"))
    f1 = f1.filter("t > 0").agg(F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    whole = cells.agg((F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), (F.sum("loss") / F.sum("n")).alias("log_loss"), (F.sum("brier") / F.sum("n")).alias("brier"))
    return whole.crossJoin(f1)  # one row each


def ranking_metrics(df: DataFrame, score: str, positive: str, ks: tuple[int, ...] = (50, 100, 250, 500, 1000)) -> DataFrame:
    """k, precision and recall at the k highest scores (ties by ``txid``)."""
    top = df.select(F.col(score).alias("s"), F.col(positive).cast("int").alias("y"), "txid").orderBy(F.desc("s"), "txid").limit(max(ks))
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "txid")))  # max(ks) rows
    total = df.agg(F.sum(F.col(positive).cast("int")).alias("total"))
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    per = ranked.select("r", "y", k).filter("r <= k").groupBy("k").agg(F.sum("y").alias("hits"))
    return per.crossJoin(total).select("k", (F.col("hits") / F.col("k")).alias("precision"), F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)).alias("recall"))


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve from average ranks of distinct scores: counts by score, then one small window."""
    counts = value_counts(df, score, p=F.sum(F.col(positive).cast("int")))
    ranked = counts.select("p", "c", (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"))
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("c") - F.col("p")).alias("n"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the precision-recall curve as the sum of precision times gained recall over distinct scores."""
    cum = value_counts(df, score, descending=True, p=F.sum(F.col(positive).cast("int"))).select("p", F.col("p_upto").alias("tp"), F.col("upto").alias("k"))
    return cum.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("k")), F.sum("p")).alias("pr_auc"))


def _lacks(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def fit_imputer(train: DataFrame, columns: list[str]) -> dict:
    """Medians of ``train`` (0 where a column is null throughout), and which columns lack values there."""
    one = train.agg(*(F.percentile_approx(F.when(~_lacks(c), F.col(c).cast("double")), 0.5, 10_000).alias(c) for c in columns), *(F.max(_lacks(c).cast("int")).alias(f"{c}_missing") for c in columns)).first()
    return {"columns": list(columns), "medians": {c: float(one[c]) if one[c] is not None else 0.0 for c in columns}, "flags": [c for c in columns if one[f"{c}_missing"]]}


def impute(df: DataFrame, imputer: dict) -> tuple[DataFrame, list[str]]:
    """``df`` with the medians in place of nulls and NaN, and a 0/1 column ``<c>_missing`` for each flagged column; and all feature names."""
    filled = {c: F.when(_lacks(c), F.lit(imputer["medians"][c])).otherwise(F.col(c).cast("double")) for c in imputer["columns"]}
    return df.withColumns({f"{c}_missing": _lacks(c).cast("double") for c in imputer["flags"]} | filled), [*imputer["columns"], *(f"{c}_missing" for c in imputer["flags"])]


def imputed(df: DataFrame, train: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Both in one; nothing is learned from rows outside ``train``."""
    return impute(df, fit_imputer(train, columns))


def ranked_areas(df: DataFrame, by: str, classes: int) -> DataFrame:
    """``by``, class, positives, negatives, roc_auc and pr_auc of each class against the rest, from (by, label, probabilities).

    All groups and classes are stacked into counts by score, and one ordered pass
    over these gives every area; null where a group has only one kind.
    """
    each = df.select(by, "label", F.posexplode("probabilities").alias("c", "s")).filter(F.col("c") < classes)
    counts = each.groupBy(by, "c", "s").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("c")).alias("p"))
    upto = running_sums(counts, [F.col(by).asc(), F.col("c").asc(), F.col("s").desc()], k=F.col("n"), tp=F.col("p"))
    total = counts.groupBy(by, "c").agg(F.sum("n").alias("all"), F.sum("p").alias("pos"))
    order = Window.orderBy(by, "c").rowsBetween(Window.unboundedPreceding, -1)  # groups times classes rows
    total = total.select("*", F.coalesce(F.sum("all").over(order), F.lit(0)).alias("k0"), F.coalesce(F.sum("pos").over(order), F.lit(0)).alias("tp0"))
    rows = upto.join(total, [by, "c"]).select(by, "c", "n", "p", (F.col("k") - F.col("k0")).alias("k"), (F.col("tp") - F.col("tp0")).alias("tp"), "all", "pos")
    miss = F.col("n") - F.col("p")
    areas = rows.groupBy(by, "c").agg(
        F.max("pos").alias("positives"), (F.max("all") - F.max("pos")).alias("negatives"),
        F.sum(miss * (F.col("tp") - F.col("p") + F.col("p") / 2)).alias("won"), F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("gained"),
    )
    return areas.select(by, F.col("c").alias("class"), "positives", "negatives", F.try_divide("won", F.col("positives") * F.col("negatives")).alias("roc_auc"), F.try_divide("gained", "positives").alias("pr_auc"))


def metrics_by(df: DataFrame, by: str, classes: int) -> DataFrame:
    """``by``, n, accuracy, macro_f1, log_loss, brier, roc_auc and pr_auc (means over the classes that have both kinds) from (by, label, predicted, probabilities)."""
    truth = F.get("probabilities", F.col("label").cast("int"))
    brier = F.aggregate(F.transform("probabilities", lambda p, i: (p - (i == F.col("label")).cast("double")) * (p - (i == F.col("label")).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    rows = df.select(by, F.col("label").cast("int").alias("label"), "predicted", (-F.log(F.greatest(truth, F.lit(1e-15)))).alias("loss"), brier.alias("brier"))
    cells = rows.groupBy(by, "label", "predicted").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"), F.sum("brier").alias("brier"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    whole = cells.groupBy(by).agg((F.sum(hit) / F.sum("n")).alias("accuracy"), (F.sum("loss") / F.sum("n")).alias("log_loss"), (F.sum("brier") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))
    ends = cells.select(by, "n", hit.alias("h"), F.explode(F.array(F.struct(F.col("label").alias("c"), F.lit(1).alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t")))).alias("e"))
    f1 = ends.groupBy(by, "e.c").agg(F.sum("n").alias("both"), F.sum(F.col("h") * F.col("e.t")).alias("h"))
    f1 = f1.groupBy(by).agg(F.avg(2 * F.col("h") / F.col("both")).alias("macro_f1"))
    areas = ranked_areas(df, by, classes).groupBy(by).agg(F.avg("roc_auc").alias("roc_auc"), F.avg(F.when(F.col("positives") > 0, F.col("pr_auc"))).alias("pr_auc"))
    return whole.join(f1, by).join(areas, by).select(by, "n", "accuracy", "macro_f1", "log_loss", "brier", "roc_auc", "pr_auc")


METRICS = ("accuracy", "macro_f1", "log_loss", "brier", "roc_auc", "pr_auc")


def window_deltas(metrics: DataFrame, by: str, early: str, late: str) -> DataFrame:
    """metric, early, late and delta (late less early) of two of the groups of :func:`metrics_by`."""
    one = lambda which: metrics.filter(F.col(by) == which).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("e")).select("e.metric", F.col("e.v").alias(which))
    return one(early).join(one(late), "metric").select("metric", F.col(early).alias("early"), F.col(late).alias("late"), (F.col(late) - F.col(early)).alias("delta"))


def fit_temperature(df: DataFrame, low: float = 0.05, high: float = 10.0, rounds: int = 24) -> float:
    """Temperature with the least log loss of (label, probabilities): golden-section search, one aggregation a round."""
    logits = df.select("label", F.transform("probabilities", lambda p: F.log(F.greatest(p, F.lit(1e-15)))).alias("z")).cache()

    def loss(t: float) -> float:
        scaled = F.transform("z", lambda z: z / t)
        norm = F.log(F.aggregate(F.transform(scaled, F.exp), F.lit(0.0), lambda a, x: a + x))
        return logits.agg(F.avg(norm - F.get(scaled, F.col("label").cast("int"))).alias("l")).first().l

    ratio = (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    logits.unpersist()
    return (low + high) / 2


class IsolationForest:
    """Isolation trees (Liu, Ting and Zhou 2008) in numpy: grown on a bounded sample, scored where the rows are."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42) -> None:
        self.n, self.sample, self.seed = trees, sample, seed

    def fit(self, rows: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(rows))
        self.depth, self.norm = int(np.ceil(np.log2(max(2, size)))), self._expected(size)
        self.trees = [self._grow(rows[rng.choice(len(rows), size, replace=False)], 0, rng) for _ in range(self.n)]
        self.flat = [self._flat(t) for t in self.trees]
        return self

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, level: int, rng):
        spread = x.max(axis=0) > x.min(axis=0) if len(x) else np.zeros(0, bool)
        if level >= self.depth or len(x) < 2 or not spread.any():
            return level + self._expected(len(x))
        f = int(rng.choice(np.flatnonzero(spread)))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], level + 1, rng), self._grow(x[~left], level + 1, rng)

    def _flat(self, tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A tree as a complete one, level by level: features, cuts, and the last level's path lengths (a leaf above it is repeated below)."""
        feature, cut, level = np.zeros((1 << self.depth) - 1, np.intp), np.zeros((1 << self.depth) - 1), [tree]
        for depth in range(self.depth):
            below = []
            for i, node in enumerate(level, (1 << depth) - 1):
                if isinstance(node, tuple):
                    feature[i], cut[i] = node[:2]
                below += node[2:] if isinstance(node, tuple) else (node, node)
            level = below
        return feature, cut, np.array(level, float)

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1); higher is stranger.  Some thousand rows go down a tree together, a level at a time."""
        parts = [self._lengths(x[i : i + 4096]) for i in range(0, len(x), 4096)]
        total = np.concatenate(parts) if parts else np.zeros(0)
        return 2 ** (-(total / len(self.trees)) / max(self.norm, 1e-9))

    def _lengths(self, x: np.ndarray) -> np.ndarray:
        values, total = np.ascontiguousarray(x).ravel(), np.zeros(len(x))
        begin = np.arange(len(x)) * x.shape[1]
        for feature, cut, length in self.flat:
            node = np.zeros(len(x), np.intp)
            for _ in range(self.depth):
                node = 2 * node + 2 - (values.take(begin + feature.take(node)) < cut.take(node))
            total += length.take(node - len(feature))
        return total


def isolation_scores(df: DataFrame, key: str, columns: list[str], train: DataFrame | None = None, sample: int = 4096, trees: int = 300, contamination: float = 0.01) -> DataFrame:
    """key, anomaly_score, decision (below 0 for the strange) and flag (-1 for them, else 1).

    The forest learns from at most ``sample`` rows of ``train``, chosen by a hash of
    the key, and the limit is the score that ``contamination`` of them exceed.
    """
    rows = (df if train is None else train).select(key, *columns).dropna()
    known = np.array([r[1:] for r in rows.orderBy(F.xxhash64(key), key).limit(sample).collect()], float).reshape(-1, len(columns))
    grown = IsolationForest(trees).fit(known)
    limit = float(np.quantile(grown.score(known), 1 - contamination)) if len(known) else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = grown.score(b[columns].fillna(0.0).to_numpy(float))
            yield pd.DataFrame({key: b[key], "anomaly_score": score, "decision": limit - score, "flag": np.where(score > limit, -1, 1)})

    kind = dict(df.dtypes)[key]
    return df.select(key, *columns).mapInPandas(run, f"{key} {kind}, anomaly_score double, decision double, flag int")


def linear_contributions(df: DataFrame, weights: dict[str, float], key: str, k: int = 10) -> DataFrame:
    """The ``k`` features of each row with the largest absolute weight times value, exactly, without Python."""
    each = F.array(*(F.struct((-F.abs(F.col(c) * w)).alias("order"), F.lit(c).alias("feature"), (F.col(c) * w).alias("contribution")) for c, w in weights.items()))
    return df.select(key, F.transform(F.slice(F.array_sort(F.filter(each, lambda e: e["contribution"].isNotNull())), 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution"))).alias("top"))


def model_contributions(model: PipelineModel, df: DataFrame, columns: list[str], key: str, k: int = 10, label: int = 0) -> DataFrame:
    """As :func:`linear_contributions`, by a fitted logistic model's coefficients for one class, over its scaled features."""
    names = [*columns, *(f"{c}_missing" for c in columns)]
    weights = model.stages[-1].coefficientMatrix.toArray()[label].tolist()
    scaled = model.transform(with_indicators(df, columns).withColumn("weight", F.lit(1.0))).select(key, vector_to_array("features").alias("x"))
    rows = scaled.select(key, *(F.get("x", F.lit(i)).alias(name) for i, name in enumerate(names)))
    return linear_contributions(rows, dict(zip(names, weights, strict=True)), key, k)
