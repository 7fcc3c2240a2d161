"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Whole copies that every document of
the source is certain of come first; what is left of the target is a sample
without replacement with unequal probabilities.  A document's inclusion
probability is proportional to a measure of its size, at most 1, with the factor
at which the expected words are what is left.  The measure is one over the
square root of the size: beside equal odds, under which a few very long documents
would be most of a source's sample, it spreads the words over more documents, and
those that reach 1 are certain.  Each document draws a random number u from its
id, and the documents are ranked by u / (1 - u) divided by p / (1 - p), its random
odds over its inclusion odds (Pareto order sampling); each is taken in that order
if its words still fit, so the sample has a fixed size in words.  One closing
document, the one whose size is nearest to what is still missing, ends the
sample when no other fits.

No source is sorted: two histograms of the rank (sums by source and bucket,
combined before they are shuffled) find the bucket of the first document that
does not fit, and only that bucket's rows are ranked one by one.  Behind it the
order goes on over the documents whose size is at most what is missing, the next
``STEP`` of a source at a time, until none is left that fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import written

#: Buckets at each of the two levels of the histogram.
BUCKETS = 4096
#: Documents of a source that are tried one by one at a time.
STEP = 1024


def word_count(text: Column) -> Column:
    """Number of longest runs of characters outside the blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_number(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of an MD5 digest, so that SQL engines agree on it."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], total_share: float, max_copies: float) -> DataFrame:
    """source, source_size, target for a table (source, source_size) with one row a source.

    Sources by code point, null last, take the weights in turn.  Together they
    get ``total_share`` of all sizes; a target stops at ``max_copies`` times its
    source's size and the rest is shared anew by weight.  The fixed point is one
    level: target = min(cap, weight * level), found by sorting sources by
    cap / weight.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("n") % F.lit(len(weights)) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    full = Window.orderBy(F.col("cap") / F.col("w"), "n")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(total_share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levelled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    # The first source in this order that stays below its cap sets the level of all after it.
    final = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * final, F.col("cap"))).alias("target"))


def measure(size: Column) -> Column:
    """What a document's inclusion probability is proportional to."""
    return 1 / F.sqrt(F.greatest(size, F.lit(1)))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; the smallest are taken, certain ones first.  Null where ``p`` is 0."""
    return (u / (1 - u)) * ((1 - p) / F.nullif(p, F.lit(0.0)))


def inclusion_factor(sized: DataFrame, needs: DataFrame) -> DataFrame:
    """source, factor: p = min(1, factor * measure(size)) makes the sum of p * size the need.

    ``needs`` has one row a source (source, need).  Sizes are counted first, so
    what is sorted is one row for each source and distinct size: with the
    smaller sizes certain, the factor that the others would need is right at the
    first size that it leaves uncertain.
    """
    counts = sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("m"))
    right = needs.filter("need > 0").select(F.col("source").alias("its_source"), "need")
    rows = counts.join(right, F.col("source").eqNullSafe(F.col("its_source")))
    x, by_size = measure(F.col("size")), Window.partitionBy("source").orderBy("size")
    certain = F.coalesce(F.sum(F.col("m") * F.col("size")).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("m") * F.col("size") * x).over(by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("factor", (F.col("need") - certain) / rest)
    return rows.filter(F.col("factor") * x < 1).groupBy("source").agg(F.min_by("factor", "size").alias("factor"))


def _cuts(sized: DataFrame, weights: Sequence[float], total_share: float, max_copies: float) -> DataFrame:
    """One row a source: its target, the whole copies, where the rounds of its sample end, and the closing document."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # floor() of a quotient that should be whole must not fall short of it
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(ratio + F.lit(1e-12))
    targets = source_targets(per_source, weights, total_share, max_copies).withColumn("whole", whole).withColumn("p", F.greatest(ratio - whole, F.lit(0.0)))
    targets = written(targets.withColumn("need", F.col("p") * F.col("source_size")).drop("p"), "targets")
    factor = inclusion_factor(sized, targets).withColumnRenamed("source", "x0")
    targets = written(targets.join(factor, F.col("source").eqNullSafe(F.col("x0")), "left").drop("x0"), "factors")
    cut = _first_end(sized, targets)
    while not cut.filter("going").isEmpty():
        cut = _further(sized, cut)
    near = _ranked(sized, cut).filter(~_sampled() & (F.col("need") > 0))
    miss = F.abs(F.col("room") - F.col("size"))
    near = near.filter(miss < F.col("room")).groupBy("source").agg(F.min(F.struct(miss.alias("m"), F.col("q"), F.col("doc_id"), F.col("size"))).alias("closing"))
    return written(_beside(cut, near), "cut")


def _beside(cut: DataFrame, found: DataFrame) -> DataFrame:
    """The table of sources with the columns of another, both with one row a source."""
    return cut.join(found.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")), "left").drop("its")


def _first_end(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the place of the first document that does not fit (buckets and the last one that does), the words still missing, and no further ones."""
    ranked = _ranked(sized, targets).filter("need > 0 and size > 0")
    up_to = Window.partitionBy("source").orderBy("b")

    def end_of(rows: DataFrame, bucket: str, passed: str) -> DataFrame:
        """The bucket in which the sums pass the need, and the sum before it."""
        sums = rows.groupBy("source", "need", passed, F.col(bucket).alias("b")).agg(F.sum("size").alias("s"))
        sums = sums.withColumn("cum", F.col(passed) + F.sum("s").over(up_to))
        return sums.filter("cum > need").groupBy("source").agg(F.min("b").alias(f"end_{bucket}"), F.min(F.struct("b", (F.col("cum") - F.col("s")).alias("v"))).getField("v").alias(f"before_{bucket}"))

    first = written(end_of(ranked.withColumn("none", F.lit(0).cast("long")), "b1", "none"), "cut1")
    inside = ranked.join(first.withColumnRenamed("source", "source1"), F.col("source").eqNullSafe(F.col("source1")) & (F.col("b1") == F.col("end_b1"))).drop("source1")
    second = written(end_of(inside, "b2", "before_b1"), "cut2")
    inside = inside.join(second.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2")) & (F.col("b2") == F.col("end_b2"))).drop("source2")
    one_by_one = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("cum", F.col("before_b2") + F.sum("size").over(one_by_one)).filter("cum <= need")
    last = inside.groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("last"), F.max("cum").alias("got"))
    # An empty bucket before the end leaves no row in it: every earlier bucket still counts.
    ends = _beside(_beside(_beside(targets, first), second), last)
    # Without an end, every document fits and nothing is missing.
    room = F.when(F.col("end_b1").isNull(), F.lit(0.0)).otherwise(F.col("need") - F.coalesce("got", "before_b2", F.lit(0)))
    ends = ends.withColumns({"room": room, "first_room": room, "tried": F.col("last"), "further": F.array().cast("array<struct<doc_id: bigint, size: bigint>>")})
    ends = ends.drop("before_b1", "before_b2", "got").withColumn("going", F.col("room") >= 1)
    return written(ends, "end")


def _further(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """``cut`` after the next ``STEP`` documents of each source that may fit were tried in order."""
    ranked = _ranked(sized, cut.filter("going")).filter("size > 0 and size <= room").filter(~_before_end())
    ranked = ranked.filter(F.col("tried").isNull() | (F.struct("q", "doc_id") > F.col("tried")))
    number = F.row_number().over(Window.partitionBy("source").orderBy("q", "doc_id", "size"))
    ranked = ranked.withColumn("number", number).filter(F.col("number") <= STEP)  # each partition keeps so many before the shuffle
    tried = ranked.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("number", "q", "doc_id", "size"))).alias("next"), F.count("*").alias("n"))
    both = _beside(cut, tried)
    state = F.struct(F.col("room").alias("room"), F.col("further").alias("further"))

    def take(a: Column, x: Column) -> Column:
        more = F.concat(a["further"], F.array(F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"))))
        return F.when(x["size"] <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), more.alias("further"))).otherwise(a)

    ended = F.aggregate(F.coalesce("next", F.array().cast("array<struct<number: int, q: double, doc_id: bigint, size: bigint>>")), state, take)
    both = both.withColumn("ended", ended).withColumn("tip", F.element_at("next", -1))
    both = both.withColumns({"room": F.col("ended.room"), "further": F.col("ended.further"), "tried": F.when(F.col("tip").isNotNull(), F.struct(F.col("tip.q").alias("q"), F.col("tip.doc_id").alias("doc_id"))).otherwise(F.col("tried"))})
    going = F.col("going") & (F.coalesce("n", F.lit(0)) == STEP) & (F.col("room") >= 1)
    return written(both.withColumn("going", going).select(*cut.columns), "further")


def _ranked(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with their source's figures, Pareto rank and buckets.  The table of sources is joined by Spark's own choice."""
    right = per_source.withColumnRenamed("source", "its_source")
    rows = sized.join(right, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    chance = F.least(F.lit(1.0), F.col("factor") * measure(F.col("size")))
    rows = rows.withColumn("q", pareto_rank(F.col("u"), chance))
    spread = F.col("q") / (1 + F.col("q")) * BUCKETS
    rows = rows.withColumn("b1", F.floor(spread).cast("int"))
    return rows.withColumn("b2", F.floor((spread - F.col("b1")) * BUCKETS).cast("int"))


def _before_end() -> Column:
    """Whether the row lies before the first document that does not fit."""
    here = F.coalesce(F.struct("q", "doc_id") <= F.col("last"), F.lit(False))
    inner = (F.col("b2") < F.col("end_b2")) | ((F.col("b2") == F.col("end_b2")) & here)
    return F.col("end_b1").isNull() | (F.col("b1") < F.col("end_b1")) | ((F.col("b1") == F.col("end_b1")) & F.coalesce(inner, F.lit(False)))


def _sampled() -> Column:
    """Whether the sample has the row; one without words, where it lies before the first document that does not fit."""
    further = (F.col("size") <= F.col("first_room")) & F.array_contains("further", F.struct("doc_id", "size"))
    return F.coalesce((F.col("need") > 0) & (_before_end() | further), F.lit(False))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    total_share: float = 1.5,
    max_copies: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words, ``taken`` the words that the mix takes, so
    ``copies * size``.

    * Null or empty text has size 0 and takes no words.  Null is a source of its
      own, the last.  A source without words has target 0.
    * Rows that repeat an id draw the same random number; of them, those of one
      source and size are taken together.  A null id draws a number too.
    * Rows of equal rank are ordered by id.  An empty table gives an empty result.
    * The result depends on ids, sizes, sources and the seed alone.  Very long
      texts are counted whole.
    """
    sized = _sized(docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.col(source_col).alias("s")), "d", "t", "s", seed)
    sized = written(sized.select("doc_id", "source", "size", "u"), "sized")
    return _decided(sized, _cuts(sized, weights, total_share, max_copies))


def _sized(rows: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = rows.withColumn("doc_id", F.col(id_col).cast("long")).withColumn("source", F.col(source_col).cast("string")).withColumn("size", word_count(F.col(text_col)))
    return rows.withColumn("u", random_number(F.col("doc_id"), seed))


def _copies() -> Column:
    closes = (F.col("doc_id") == F.col("closing.doc_id")) & (F.col("size") == F.col("closing.size"))
    return (F.col("whole") + F.when(_sampled() | F.coalesce(closes, F.lit(False)), 1).otherwise(0)).cast("long")


def _decided(sized: DataFrame, cut: DataFrame) -> DataFrame:
    rows = _ranked(sized, cut).withColumn("copies", _copies()).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "copies", "taken")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    total_share: float = 1.5,
    max_copies: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it; cases as in :func:`mix_sources`.

    A row's copies follow from its own values and its source's figures, so texts
    are not shuffled, and rows that share an id in two sources are told apart.
    """
    columns = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = _sized(docs.toDF(*columns.values()), columns[id_col], columns[text_col], columns[source_col], seed)
    sized = written(rows.select("doc_id", "source", "size", "u"), "sized")
    taken = _ranked(rows, _cuts(sized, weights, total_share, max_copies)).withColumn("copies", _copies()).filter("copies > 0")
    # The copies make rows of an array of their numbers, next to the text, which is not read into it
    every = taken.select(*columns.values(), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return every.select(*columns.values()).toDF(*columns)
