"""Mixing indicators, value-peeling chains and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.features import ratio_or_zero
from ledgerweave.operators.kept import Rounds, kept

#: Steps that a predecessor may lie back, and the share of value that a peel may take.
WINDOW, LOW, HIGH, LONGEST = 10, 0.05, 0.95, 10


def mixing_indicators(counts: DataFrame) -> DataFrame:
    """Fan-in, fan-out, balance and participant flags, the candidate flag and the weighted score."""
    i, o = F.col("input_count"), F.col("output_count")
    total, ratio = i + o, ratio_or_zero(o, i)
    flags = {
        "fan_in_flag": i >= 5,
        "fan_out_flag": o >= 5,
        "balance_flag": ratio.between(0.4, 2.5),
        "participant_flag": total >= 10,
        "high_participant_flag": total >= 25,
    }
    out = counts.withColumn("output_input_ratio", F.round(ratio, 6)).withColumn("participant_count", total).withColumn("participant_density", F.round(total / F.greatest(i, o, F.lit(1)), 6))
    for k, v in flags.items():
        out = out.withColumn(k, v)
    candidate = flags["fan_in_flag"] & flags["fan_out_flag"] & flags["balance_flag"] & flags["participant_flag"]
    b = lambda f: f.cast("int")
    score = 0.25 * b(flags["fan_in_flag"]) + 0.25 * b(flags["fan_out_flag"]) + 0.20 * b(flags["balance_flag"]) + 0.15 * b(flags["participant_flag"]) + 0.10 * b(flags["high_participant_flag"]) + 0.05 * b(candidate)
    return out.withColumn("mixing_candidate", candidate).withColumn("mixing_evidence_score", F.round(score, 6))


def side_counts(steps: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Distinct addresses of each side of each transaction; 0 where there are none."""
    n = lambda df, c: df.groupBy("txid").agg(F.count("*").alias(c))
    return steps.join(n(inputs, "input_count"), "txid", "left").join(n(outputs, "output_count"), "txid", "left").fillna(0, ["input_count", "output_count"])


def value_reduction(previous: Column, current: Column) -> Column:
    """(previous - current) / previous; null unless both are finite and the first is positive."""
    q = F.when(previous > 0, (previous - current) / previous)
    return F.when(~F.isnan(q) & (F.abs(q) < float("inf")), q)


def causal_predecessors(steps: DataFrame, values: DataFrame, inputs: DataFrame, outputs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs (txid, previous): an input address of txid is an output of previous, one to ``window`` steps earlier.

    A range join on an equal address: each output is placed under the block of
    ``window`` steps it lies in, each input under its own block and the one
    before, so a hot address meets only nearby steps.  Columns: gap, shared
    (addresses in common) and reduction of value.

    Each side's row brings its transaction's value and other addresses, those
    before and those after its own.  A pair is made at the first address it has in
    common and counts the later ones there, so pairs are not moved once they are made.
    Inputs that are nobody's output can make no pair and are left out at the start.
    """
    block = lambda c: F.floor(F.col(c) / window)
    known = steps.join(values.select("txid", "value"), "txid")

    def side(members: DataFrame) -> DataFrame:
        lists = members.groupBy("txid").agg(F.sort_array(F.collect_set("address")).alias("all"))
        placed = known.join(lists, "txid").select("txid", "time_step", "value", "all", F.posexplode("all").alias("i", "address"))
        return placed.select("txid", "time_step", "value", "address", F.slice("all", F.lit(1), F.col("i")).alias("lower"), F.slice("all", F.col("i") + 2, F.size("all")).alias("higher"))

    spent = side(inputs.join(outputs.select("address").distinct(), "address", "left_semi")).withColumn("block", F.explode(F.array(block("time_step"), block("time_step") - 1)))
    made = side(outputs).select(F.col("txid").alias("previous"), "address", F.col("time_step").alias("previous_step"), F.col("value").alias("then"), F.col("lower").alias("made_lower"), F.col("higher").alias("made_higher"), block("time_step").alias("block"))
    gap = F.col("time_step") - F.col("previous_step")
    pairs = spent.join(made, ["address", "block"]).filter((gap > 0) & (gap <= window) & ~F.arrays_overlap("lower", "made_lower"))
    shared = (F.size(F.array_intersect("higher", "made_higher")) + 1).cast("long")
    return pairs.select("txid", "previous", shared.alias("shared"), gap.alias("gap"), value_reduction(F.col("then"), F.col("value")).alias("reduction"))


def valid_reduction(c: Column) -> Column:
    return c.between(LOW, HIGH)


def predecessor_summary(pairs: DataFrame) -> DataFrame:
    """Counts over all predecessors, and the best valid one: largest reduction, then smallest id as text."""
    ok = valid_reduction(F.col("reduction"))
    best = F.min_by(F.col("previous"), F.when(ok, F.struct((-F.col("reduction")).alias("r"), F.col("previous").cast("string").alias("t"))))
    return pairs.groupBy("txid").agg(
        F.count("*").alias("predecessor_count"), F.sum("shared").alias("shared_address_links"), F.count_if(ok).alias("valid_predecessor_count"), F.max(F.when(ok, F.col("reduction"))).alias("best_reduction"), best.alias("best_previous"),
        (F.count_if(F.col("gap") == 1) > 0).alias("direct_continuation"), (F.count_if(ok) > 0).alias("gradual_reduction"),
    )


def longest_chains(steps: DataFrame, pairs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The longest chain of valid links that ends at each transaction: txid, chain (array of ids as text).

    A chain keeps its last ``longest`` ids; of equal lengths the smallest array
    wins.  Links only lead forward in time, so one pass over the steps in order
    is enough; each step joins only the chains of the window before it, from a
    folder a step, which one scan reads.  A predecessor without a link of its own stands for itself, so of
    these only the smallest of each transaction is kept, and none is joined.
    """
    valid = pairs.filter(valid_reduction(F.col("reduction"))).select("txid", "previous")
    linked = kept(valid.select("txid").distinct().join(steps, "txid").select("txid", "time_step"))
    times = [r.time_step for r in linked.select("time_step").distinct().orderBy("time_step").collect()]  # one row a step
    links = valid.join(linked.select(F.col("txid").alias("previous"), F.lit(True).alias("goes_on")), "previous", "left").join(linked, "txid")
    text = F.when(F.col("goes_on").isNull(), F.col("previous").cast("string"))
    links = links.withColumn("lone", text).withColumn("least", F.min("lone").over(Window.partitionBy("txid")))
    links = kept(links.filter(F.col("goes_on") | (F.col("lone") == F.col("least"))).select("txid", "previous", "lone", "time_step"), "time_step", "txid")
    alone = steps.join(linked.select("txid"), "txid", "left_anti").select("txid", "time_step", F.array(F.col("txid").cast("string")).alias("chain"))
    found, done = Rounds(steps.sparkSession), []
    for t in times:
        here = links.filter(F.col("time_step") == t)
        now = here.filter("lone is not null").select("txid", F.array("lone").alias("before"))
        if near := [s for s in done if s >= t - WINDOW]:
            earlier = found.read(near).select(F.col("txid").alias("previous"), F.col("chain").alias("before"))
            now = now.unionByName(here.filter("lone is null").join(earlier, "previous").select("txid", "before"))
        grown = F.concat("before", F.array(F.col("txid").cast("string")))
        grown = F.when(F.size(grown) > longest, F.slice(grown, -longest, longest)).otherwise(grown)
        best = now.withColumn("chain", grown).groupBy("txid").agg(F.min(F.struct((-F.size("chain")).alias("n"), F.col("chain"))).alias("b"))
        found.add(t, best.select("txid", F.lit(t).alias("time_step"), F.col("b.chain").alias("chain")))
        done.append(t)
    return alone.unionByName(found.read(done)) if done else alone


def chain_metrics(chains: DataFrame, values: DataFrame, steps: DataFrame) -> DataFrame:
    """Length, validity, span, reductions and gaps along each chain of three or more."""
    at = F.posexplode("chain").alias("place", "member")
    long = chains.select("txid", F.size("chain").alias("chain_length"), "chain").filter("chain_length >= 3").select("txid", "chain_length", at)
    v = values.join(steps, "txid").select(F.col("txid").cast("string").alias("member"), "value", F.col("time_step").alias("step"))
    points = long.join(v, "member").groupBy("txid", "chain_length").agg(F.array_sort(F.collect_list(F.struct("place", "value", "step"))).alias("p"))
    pair = lambda f: F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), f)
    points = points.withColumn("cuts", pair(lambda a, b: value_reduction(a["value"], b["value"]))).withColumn("gaps", pair(lambda a, b: b["step"] - a["step"]))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    return points.select(
        "txid",
        "chain_length",
        F.forall("cuts", valid_reduction).alias("chain_valid"),
        (last["step"] - first["step"]).alias("temporal_span"),
        F.round(value_reduction(first["value"], last["value"]), 6).alias("total_reduction"),
        F.round(F.array_min("cuts"), 6).alias("min_reduction"),
        F.round(F.array_max("cuts"), 6).alias("max_reduction"),
        F.forall("gaps", lambda g: g == 1).alias("all_gaps_one"),
    )


def peeling(steps: DataFrame, summary: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every transaction with its peeling figures and additive score, at most 1."""
    out = steps.join(summary, "txid", "left").join(metrics, "txid", "left")
    out = out.fillna(0, ["predecessor_count", "shared_address_links", "valid_predecessor_count", "chain_length", "temporal_span"]).fillna(False, ["direct_continuation", "gradual_reduction", "chain_valid", "all_gaps_one"])
    b = lambda c: F.col(c).cast("int")
    valid = b("chain_valid")
    score = 0.25 * b("direct_continuation") + 0.25 * b("gradual_reduction") + 0.25 * valid + valid * 0.05 * F.least(F.greatest(F.col("chain_length") - 3, F.lit(0)), F.lit(4)) + 0.10 * valid * b("all_gaps_one") + 0.10 * (F.col("shared_address_links") >= 2).cast("int")
    return out.withColumn("peeling_evidence_score", F.round(F.least(score, F.lit(1.0)), 6)).withColumn("peeling_candidate", F.col("direct_continuation") | F.col("gradual_reduction"))


def level(score: Column) -> Column:
    """Bands closed on the left at .2, .5 and .75."""
    return F.when(score < 0.2, "LOW").when(score < 0.5, "MODERATE").when(score < 0.75, "HIGH").otherwise("VERY_HIGH")


def behavioral_evidence(peels: DataFrame, mixing: DataFrame) -> DataFrame:
    """One-to-one fusion of both detectors."""
    both = peels.select("txid", "time_step", "peeling_evidence_score", "peeling_candidate").join(mixing.select("txid", "mixing_evidence_score", "mixing_candidate"), "txid")
    score = F.round(0.5 * F.col("peeling_evidence_score") + 0.5 * F.col("mixing_evidence_score"), 6)
    return both.withColumn("behavioral_evidence_score", score).withColumn("behavioral_signal_count", F.col("peeling_candidate").cast("int") + F.col("mixing_candidate").cast("int")).withColumn("behavioral_level", level(score))
