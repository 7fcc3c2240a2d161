"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions alone.

A sketch is the sorted array of the k smallest distinct 48-bit hashes of a text's
word shingles.  The sketch of a union is the k smallest of the sketches'
union, so sketches of parts merge; from sketches follow estimates of
resemblance, containment and the number of distinct shingles.  A set of fewer
than k shingles is held whole, and its estimates are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import BLANKS, partitions

#: Hashes in a sketch, and bits of a hash.
K, BITS = 256, 48


def words_of(text: Column) -> Column:
    """Array of the runs of characters outside the blanks."""
    spaced = F.trim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return F.when(F.length(spaced) == 0, F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = 5) -> DataFrame:
    """``df`` with the sketch of column ``text`` (no nulls) as a column ``name``.

    The array of word hashes is a column of its own until it has been used, so
    that the shingles read it and do not compute it anew.
    """
    hashes = F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))
    df = df.withColumn("__words", hashes)
    n = F.size("__words")
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(F.col("__words"), i + j) for j in range(width))))
    short = F.array(F.xxhash64(F.lit(-1), "__words"))
    every = F.when(n >= width, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    kept = F.transform(every, lambda x: F.shiftrightunsigned(x, 64 - BITS))
    df = df.withColumn("__every", F.sort_array(F.array_distinct(kept)))
    return df.withColumn(name, F.slice("__every", 1, k)).drop("__words", "__every")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a share of all."""
    kth = F.element_at(sketch, k).cast("double") / F.lit(float(1 << BITS))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both have; two empty sets resemble each other fully."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's set that lies in b's, between 0 and 1; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: eight characters of base64 for each hash."""
    return F.base64(F.unhex(F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.hex(x), BITS // 4, "0")))))


def merge_groups(df: DataFrame, group: str, sketch: str, k: int = K) -> DataFrame:
    """One merged sketch a group: columns ``group`` and ``sketch``.

    Equal hashes are combined and each map task keeps its k smallest of a group
    before the shuffle (window group limit), so a hot group sends k rows a task.
    """
    values = df.select(group, F.explode(sketch).alias("__h")).distinct()
    least = values.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("__h"))).filter(F.col("__n") <= k)
    return least.groupBy(group).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def with_next_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with ``next_text`` of the row after it by descending id; after the last comes the first.

    The ids are cut into ranges at sampled quantiles.  Texts are shuffled once,
    by range; the first row of each range also goes to the range before it (the
    first of all to the last), as many extra rows as there are ranges.
    There are four ranges a shuffle partition, so they grow in number with the data.
    Null ids come last; rows with one id are ordered by their text's hash and stay
    in one range.
    The columns ``__range`` and ``__extra`` stay, for windows over the same ranges.
    """
    spark = docs.sparkSession
    ranges = 4 * partitions(spark)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.withColumn("__key", key)
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("__key", F.array(*map(F.lit, shares)), F.lit(max(20_000, 10 * ranges))).alias("c")).first().c if ranges > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    # The number of cuts above the key, in two looks: which stretch of cuts, then how many of it
    stretch = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + stretch] for i in range(0, len(cuts), stretch)]
    one = spark.createDataFrame([([p[0] for p in parts], parts)], "__heads array<bigint>, __parts array<array<bigint>>")
    rows = rows.crossJoin(F.broadcast(one))  # one row
    above = lambda c: F.size(F.filter(c, lambda x: x > F.col("__key")))
    rows = rows.withColumn("__n", above(F.col("__heads")))
    number = F.when(F.col("__n") == 0, 0).otherwise((F.col("__n") - 1) * stretch + above(F.get("__parts", F.col("__n") - 1)))
    rows = rows.withColumn("__range", number.cast("int")).drop("__heads", "__parts", "__n")
    firsts = rows.groupBy("__range").agg(F.max("__key").alias("k")).orderBy("__range").collect()  # one row a range
    before = [(r.k, firsts[i - 1]["__range"]) for i, r in enumerate(firsts)]
    extra = F.broadcast(spark.createDataFrame(before, "__first long, __other int"))
    rows = rows.join(extra, rows["__key"] == extra["__first"], "left").drop("__first")
    copies = F.filter(F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("x")), F.struct(F.col("__other").alias("r"), F.lit(True).alias("x"))), lambda s: s["r"].isNotNull())
    rows = rows.withColumn("__to", F.explode(copies))
    rows = rows.select("doc_id", "text", "__key", F.col("__to.r").alias("__range"), F.col("__to.x").alias("__extra"), F.xxhash64("text").alias("__tie"))
    return rows.withColumn("next_text", F.lead("text").over(next_row()))


def next_row() -> Window:
    return Window.partitionBy("__range").orderBy("__extra", F.desc("__key"), "__tie")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = 5) -> DataFrame:
    """Fingerprints of each row and of its text as edited by the next row, one row for each row of ``docs``.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_distinct (estimated distinct shingles).  The edited
    text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next row's text; the next row is as in
    :func:`with_next_text`, and a lone row is its own next.

    * Null text counts as empty; an empty text has the empty fingerprint, and two
      of them resemble each other with 1.
    * A text with fewer words than a shingle has one shingle of all of them.
    * Repeated rows get equal fingerprints.  An empty table gives an empty result;
      other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next_text(rows).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_sketch(with_sketch(rows, "text", "own", k, width).drop("text"), "edited", "other", k, width).drop("edited")
    rows = rows.withColumn("next", F.lead("own").over(next_row())).filter("not __extra")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        distinct_count(F.col("own"), k).alias("n_distinct"),
    )
