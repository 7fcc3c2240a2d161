"""Co-spend state of addresses as it was before each step: what a step sees is the graph of strictly earlier steps.

A pair of addresses becomes an edge at threshold k in the step of its k-th common
transaction.  Degrees and counts are running values by step; components come from
halving the steps (:func:`forests.components_before`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.forests import components_before
from ledgerweave.operators.kept import kept

THRESHOLDS = (1, 2, 3)


def pair_events(inputs: DataFrame, steps: DataFrame) -> DataFrame:
    """a, b, time_step, nth: every common spend of a pair, numbered by step and transaction."""
    used = inputs.join(steps, "txid")
    a = used.select("txid", "time_step", F.col("address").alias("a"))
    b = used.select("txid", F.col("address").alias("b"))
    order = Window.partitionBy("a", "b").orderBy("time_step", "txid")
    return a.join(b, "txid").filter("a < b").select("a", "b", "time_step", F.row_number().over(order).alias("nth"))


def activations(events: DataFrame, threshold: int) -> DataFrame:
    return events.filter(F.col("nth") == threshold).select("a", "b", F.col("time_step").alias("active_from"))


def degree_before(members: DataFrame, events: DataFrame, threshold: int = 2) -> DataFrame:
    """txid, degree and shared count of each of its addresses over strictly earlier steps.

    ``members``: txid, address, time_step.  Both figures are running values per
    address, made on the address's own events and read by a window, so no pair is
    joined with every later transaction.
    """
    ends = events.select(F.explode(F.array("a", "b")).alias("address"), "time_step", "nth")
    per = ends.groupBy("address", "time_step").agg(F.count_if(F.col("nth") == threshold).alias("gained"), F.max("nth").alias("top"))
    asks = members.select("address", "time_step").distinct().withColumns({"gained": F.lit(0).cast("long"), "top": F.lit(0)})
    order = Window.partitionBy("address").orderBy("time_step").rangeBetween(Window.unboundedPreceding, -1)
    line = per.unionByName(asks).groupBy("address", "time_step").agg(F.sum("gained").alias("gained"), F.max("top").alias("top"))
    state = line.select("address", "time_step", F.coalesce(F.sum("gained").over(order), F.lit(0)).alias("degree"), F.coalesce(F.max("top").over(order), F.lit(0)).alias("max_shared"))
    return members.join(state, ["address", "time_step"]).select("txid", "address", "time_step", "degree", "max_shared")


def roll_up(steps: DataFrame, states: DataFrame, side: str = "input") -> DataFrame:
    """One row a transaction; a side without addresses has zeros."""
    per = states.groupBy("txid").agg(F.count_if(F.col("degree") > 0).alias("r"), F.max("degree").alias("m"), F.avg("degree").alias("a"), F.max("max_shared").alias("s"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return steps.select("txid").join(per, "txid", "left").select("txid", z("r").alias(f"{side}_repeated_addresses"), z("m").alias(f"{side}_max_degree"), F.round(z("a"), 6).alias(f"{side}_mean_degree"), z("s").alias(f"{side}_max_shared"))


def pair_counts(inputs: DataFrame, steps: DataFrame) -> DataFrame:
    """a, b, time_step, n, upto: common spends of a pair in a step, and up to it; counted by step before anything is ordered."""
    return counted_pairs(placed(inputs, steps))


def placed(members: DataFrame, steps: DataFrame) -> DataFrame:
    """The members beside their time_step; a transaction without one is before and behind nothing, and left out."""
    return members.join(steps.filter(F.col("time_step").isNotNull()), "txid")


def counted_pairs(members: DataFrame) -> DataFrame:
    """As :func:`pair_counts`, from txid, address and time_step: pairs come from each transaction's list, without a join."""
    lists = members.groupBy("txid", "time_step").agg(F.sort_array(F.collect_set("address")).alias("all")).filter(F.size("all") > 1)
    each = lists.select("time_step", "all", F.posexplode("all").alias("i", "a"))
    pairs = each.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"), "time_step")
    n = pairs.groupBy("a", "b", "time_step").agg(F.count("*").alias("n"))
    return n.withColumn("upto", F.sum("n").over(Window.partitionBy("a", "b").orderBy("time_step")))


def thresholds_reached(counts: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """k, a, b, active_from: the step in which a pair's count comes to k."""
    each = counts.withColumn("k", F.explode(F.array(*map(F.lit, thresholds))))
    return each.filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select("k", "a", "b", F.col("time_step").alias("active_from"))


def states_before(members: DataFrame, counts: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """State of each (address, time_step) of ``members`` over strictly earlier steps.

    seen (whether any earlier transaction has it), degree (pairs of two or more
    common spends), max_shared, and for each threshold component_k (null without a
    pair) and size_k (then 1).
    """
    asks = kept(members.select("address", "time_step").distinct())
    ends = counts.select(F.explode(F.array("a", "b")).alias("address"), "time_step", "n", "upto")
    per = ends.groupBy("address", "time_step").agg(F.count_if((F.col("upto") >= 2) & (F.col("upto") - F.col("n") < 2)).alias("gained"), F.max("upto").alias("top"))
    per = per.withColumn("asked", F.lit(0)).unionByName(asks.withColumns({"gained": F.lit(0).cast("long"), "top": F.lit(0).cast("long"), "asked": F.lit(1)}))
    line = per.groupBy("address", "time_step").agg(F.sum("gained").alias("gained"), F.max("top").alias("top"), F.max("asked").alias("asked"))
    before = Window.partitionBy("address").orderBy("time_step").rangeBetween(Window.unboundedPreceding, -1)
    z = lambda c: F.coalesce(c, F.lit(0))
    state = line.select("address", "time_step", "asked", z(F.sum("gained").over(before)).alias("degree"), z(F.max("top").over(before)).alias("max_shared"), (F.sum("asked").over(before) > 0).alias("seen"))
    state = state.filter("asked = 1").select("address", "time_step", "degree", "max_shared", F.coalesce("seen", F.lit(False)).alias("seen"))
    found = components_before(thresholds_reached(counts, thresholds), asks.withColumn("k", F.explode(F.array(*map(F.lit, thresholds)))))
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = [x for k in thresholds for x in (of(k, "named").alias(f"component_{k}"), of(k, "component_size").alias(f"size_{k}"))]
    found = found.withColumn("named", F.when(F.col("component_size") > 1, F.col("component")))
    return state.join(found.groupBy("address", "time_step").agg(*wide), ["address", "time_step"])


def graph_features(steps: DataFrame, inputs: DataFrame, outputs: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """txid, time_step and 22 figures of both sides' addresses, each as it was before the transaction's step.

    A side without addresses has zeros and largest clusters of 1.
    """
    sides = {"input": kept(placed(inputs, steps)), "output": kept(placed(outputs, steps))}
    counts = kept(counted_pairs(sides["input"]))
    states = kept(states_before(sides["input"].unionByName(sides["output"]), counts, thresholds))
    out = steps.select("txid", "time_step")
    z = lambda c, d=0: F.coalesce(c, F.lit(d))
    for side, members in sides.items():
        clusters = [x for k in thresholds for x in (F.countDistinct(f"component_{k}").alias(f"c{k}"), F.max(f"size_{k}").alias(f"s{k}"))]
        per = members.join(states, ["address", "time_step"]).groupBy("txid").agg(
            F.count("*").alias("n"), F.count_if(F.col("degree") > 0).alias("r"), F.max("degree").alias("d"), F.max("max_shared").alias("m"), F.count_if("seen").alias("seen"), *clusters
        )
        out = out.join(per, "txid", "left").select(
            *out.columns, z("r").alias(f"{side}_repeated_cosponsor_count"), z(F.col("r") / F.col("n"), 0.0).alias(f"{side}_repeated_cosponsor_ratio"), z("d").alias(f"{side}_max_repeated_cosponsor_degree"), z("m").alias(f"{side}_max_shared_transaction_count"),
            *(z(f"c{k}").alias(f"{side}_distinct_clusters_t{k}") for k in thresholds), *(z(f"s{k}", 1).alias(f"{side}_max_cluster_size_t{k}") for k in thresholds), z("seen").alias(f"entity_{side}_address_count"),
        )
    return out


def first_states(steps: DataFrame, inputs: DataFrame, outputs: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Each address at the first step that has it: its state before that step, so nothing has been seen of it."""
    members = placed(inputs.unionByName(outputs), steps)
    first = members.groupBy("address").agg(F.min("time_step").alias("time_step"))
    return states_before(first, kept(pair_counts(inputs, steps)), thresholds)
