"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of word shingles; two are linked when their sets' Jaccard
similarity reaches a threshold.  The steps:

1.  Equal sets are one class, counted before anything is shuffled by content, so
    copies never meet one another again.
2.  Prefix filter: with shingles ordered rare first, linked sets share a shingle
    among the first n - ceil(t n) + 1 of each.  The order uses the counts of all
    shingles that are frequent in some partition; every other shingle counts as
    rare.  Any one order is right; this one keeps the lists short.
    Before that, a count over one in four shingles (by hash) drops classes that
    cannot be linked: a linked set lacks at most n - ceil(t n) shingles of the
    other, so a class with more sampled shingles that no other class has is out.
3.  Classes that share a prefix shingle form families (connected components over
    one edge from each class to the list's smallest, never all pairs).
4.  Within a family, each class is a query against an inverted index of the
    family.  DivideSkip: to share at least T shingles, a class must be found at
    least T - L times in the short lists, which are merged by sorting; only those
    candidates are probed in the L longest lists by binary search.  Sizes bound T.
    A family larger than one index is cut into index blocks in order of set
    size, and each pair of blocks whose sizes can link is a task of its own.
5.  Tasks return a forest of the links they found and the number of links of each
    class; the forests' components are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, partitions, slices, text_buffers, written
from ledgerweave.llm.components import connected_components, forest
from ledgerweave.llm.wordhash import LOWER, mix, shingle_hashes, strong_word_hashes

#: A shingle is ranked by its count where a partition has it in at least this share of its rows, and at least so often.
FREQUENT_SHARE, FREQUENT_LEAST = 0.002, 8
#: The ranks of at most so many of the most frequent shingles are sent to the tasks (the others count as rare).
FREQUENT_KEPT = 100_000
#: Shingles in an index block, about.
BLOCK_SHINGLES = 1_000_000
#: Stands for a null id, which is the largest.
NULL_ID = (1 << 63) - 1
#: One in so many shingles (by hash) is counted over all sets before candidates are sought.
SAMPLED = 4


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    buf, off = text_buffers(texts)
    word, row = strong_word_hashes(LOWER[buf], off)
    every, at = shingle_hashes(word, row, width)
    return [np.unique(every[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _sign(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap that a set of ``n`` can have with a set it is linked to: ceil(percent n / 100)."""
    return -(-n * percent // 100)


_SIGNED = "doc_id long, content long, n long, sign binary, shingle long, count long"


def _signs(width: int):
    """Size and sign of each row's set; and at the end, shingles that many rows of the partition have, with their counts."""
    names = [f.split()[0] for f in _SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, rough, parts = 0, np.zeros(1 << 20, np.int32), []
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch, 1):
                sets = shingle_sets(part["text"], width)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.record_batch([part["doc_id"], part["content"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_sign(s) for s in sets], pa.binary()), none, none], names=names)
                every = np.concatenate(sets or [np.empty(0, np.uint64)])
                rough += np.bincount((every >> np.uint64(44)).astype(np.int64), minlength=1 << 20).astype(np.int32)
                parts.append(every)
                if sum(map(len, parts)) > 4_000_000:  # bounded: only what may still be frequent stays
                    parts = [_common(parts, rough, 2)]
        least = max(FREQUENT_LEAST, math.ceil(FREQUENT_SHARE * rows))
        if parts:
            found, n = np.unique(_common(parts, rough, least), return_counts=True)
            keep = n >= least
            none = pa.nulls(int(keep.sum()), pa.int64())
            yield pa.record_batch([none, none, none, pa.nulls(len(none), pa.binary()), pa.array(found[keep].view(np.int64)), pa.array(n[keep])], names=names)

    return run


def _common(parts: list[np.ndarray], rough: np.ndarray, least: int) -> np.ndarray:
    every = np.concatenate(parts)
    return every[rough[(every >> np.uint64(44)).astype(np.int64)] >= least]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int64)])))


def _prefixes(width: int, percent: int, frequent: np.ndarray, count: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part["text"], width)
                prefix, sample = [], []
                for s in sets:
                    rank = np.zeros(len(s), np.int64)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        rank = np.where(frequent[at] == s, count[at], 0)
                    mixed = mix(s)
                    sample.append(s[mixed < np.uint64((1 << 64) // SAMPLED)].view(np.int64))
                    order = np.lexsort((mixed, rank))
                    prefix.append(s[order[: len(s) - needed(len(s), percent) + 1 if len(s) else 0]].view(np.int64))
                sign = [_sign(s) for s in sets]
                columns = [part["doc_id"], part["content"], pa.array([len(s) for s in sets], pa.int64()), pa.array(sign, pa.binary()), _lists(prefix), _lists(sample)]
                yield pa.record_batch(columns, names=["doc_id", "content", "n", "sign", "prefix", "sample"])

    return run


class Index:
    """Inverted lists over some sets; a posting is the set's number, and numbers ascend in every list."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        self.key, self.start = np.unique(every, return_index=True)
        self.end = np.append(self.start[1:], len(every))

    def search(self, query: np.ndarray, percent: int, below: int | None = None) -> np.ndarray:
        """Numbers (under ``below``) of the sets whose Jaccard similarity with ``query`` is at least percent / 100."""
        n = len(query)
        at = np.minimum(np.searchsorted(self.key, query), len(self.key) - 1)
        at = at[self.key[at] == query]
        need = int(needed(n, percent))  # no linked set shares fewer
        if len(at) < need:
            return np.empty(0, np.int64)
        length = self.end[at] - self.start[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        # DivideSkip's choice of the number of long lists, which are not merged
        skip = min(need - 1, max(0, int(need / (0.01 * math.log2(max(2, int(length[-1]))) + 1))))
        short = at[: len(at) - skip]
        merged = np.sort(np.concatenate([self.owner[self.start[k] : self.end[k]] for k in short]), kind="stable")
        if below is not None:
            merged = merged[merged < below]
        if not len(merged):
            return merged
        head = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[head], np.diff(np.append(head, len(merged)))
        size = self.size[found]
        both = -(-(percent * (n + size)) // (100 + percent))  # overlap that the two sizes ask for
        fits = (count >= both - skip) & (size * 100 >= percent * n) & (n * 100 >= percent * size)
        found, count, both = found[fits], count[fits], both[fits]
        for j, k in enumerate(at[len(at) - skip :]):
            if not len(found):
                break
            long = self.owner[self.start[k] : self.end[k]]
            p = np.minimum(np.searchsorted(long, found), len(long) - 1)
            count = count + (long[p] == found)
            alive = count >= both - (skip - 1 - j)
            found, count, both = found[alive], count[alive], both[alive]
        return found[count >= both]


def _joined(width: int, percent: int):
    """Rows of one task come sorted by tile and side: the links of each tile as a forest, and each class's number of links."""

    def tile(rows: list[tuple]) -> pa.RecordBatch:
        left = [r for r in rows if r[1] == 0]
        right = [r for r in rows if r[1] == 1]
        sets = [r[5] for r in left]
        index = Index(sets)
        ids = np.array([r[2] for r in left], np.int64)
        weight = np.array([r[3] for r in left], np.int64)
        pairs_a, pairs_b = [], []
        linked, links = [], []
        if right:  # two blocks: each row of the second is a query against the first
            total = np.zeros(len(left), np.int64)
            for r in right:
                found = index.search(r[5], percent)
                total[found] += r[3]
                if len(found):
                    linked.append(r[4])
                    links.append(int(weight[found].sum()))
                    pairs_a.append(np.full(len(found), r[2], np.int64))
                    pairs_b.append(ids[found])
                if sum(map(len, pairs_a)) > 500_000:
                    pairs_a, pairs_b = _shrink(pairs_a, pairs_b)
        else:  # one block against itself, each pair once
            total = np.zeros(len(left), np.int64)
            for i, s in enumerate(sets):
                found = index.search(s, percent, below=i)
                total[found] += weight[i]
                total[i] += int(weight[found].sum())
                if len(found):
                    pairs_a.append(np.full(len(found), ids[i], np.int64))
                    pairs_b.append(ids[found])
                if sum(map(len, pairs_a)) > 500_000:
                    pairs_a, pairs_b = _shrink(pairs_a, pairs_b)
        pairs_a, pairs_b = _shrink(pairs_a, pairs_b)
        more = np.flatnonzero(total)
        linked += [left[i][4] for i in more.tolist()]
        links += total[more].tolist()
        a, b = (pairs_a[0], pairs_b[0]) if pairs_a else (np.empty(0, np.int64),) * 2
        none = [None] * len(a)
        return pa.record_batch(
            [pa.array([*a.tolist(), *[None] * len(links)], pa.int64()), pa.array([*b.tolist(), *[None] * len(links)], pa.int64()), pa.array([*none, *linked], pa.binary()), pa.array([*none, *links], pa.int64())],
            names=["a", "b", "sign", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple] = set()
        for batch in batches:
            for part in slices(batch, 5):
                sets = shingle_sets(part["text"], width)
                for *row, sign, shingles in zip(*(part[c].to_pylist() for c in ("tile", "side", "doc_id", "weight", "sign")), sets, strict=True):
                    if held and held[0][0] != row[0]:
                        yield tile(held)
                        held, seen = [], set()
                    # Rows that share id and text come each; a class is wanted once
                    if (row[1], sign) in seen or _sign(shingles) != sign:
                        continue
                    seen.add((row[1], sign))
                    held.append((*row, sign, shingles))
        if held:
            yield tile(held)

    return run


def _shrink(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    if not a:
        return [], []
    node, root = forest(np.concatenate(a), np.concatenate(b))
    return [node[node != root]], [root[node != root]]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, n_links.

    ``component_id`` is the smallest id that links lead to (a row's own id where
    there is none); ``n_links`` is the number of other rows linked to the row.

    * Null or empty text, or one without words: an empty set, linked with nothing.
    * Fewer than ``width`` words: the whole sequence is the one shingle.
    * Rows with equal sets are linked.  Rows that share an id are one node of the
      graph, which has the links of all of them, and each of them gets its row;
      ``n_links`` counts its own.  A null id is a node like any other, the largest.
    * Very long texts are read whole, and a task works on few at a time.
    * An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("content", F.xxhash64("text"))
    first = written(rows.mapInArrow(_signs(width), _SIGNED), "signs")
    signed = first.filter("sign is not null").select("doc_id", "content", "n", "sign")
    frequent = first.filter("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("n"))
    top = frequent.orderBy(F.desc("n"), "shingle").limit(FREQUENT_KEPT).collect()
    key = np.array([r.shingle for r in top], np.int64).view(np.uint64)
    order = np.argsort(key)
    count = np.array([r.n for r in top], np.int64)[order]
    # Prefixes and samples, the bulk of it, go to their classes without being written before.
    listed = rows.mapInArrow(_prefixes(width, percent, key[order], count), "doc_id long, content long, n long, sign binary, prefix array<long>, sample array<long>")
    classes = listed.filter("n > 0").groupBy("sign").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "content")).alias("first"), F.count("*").alias("weight"), F.min("n").alias("n"), F.expr("min_by(struct(prefix, sample), doc_id)").alias("lists"))
    # Where postings are many, a class goes by 64 bits of its sign, as shingles do.
    classes = written(classes.select("sign", F.xxhash64("sign").alias("node"), "first.*", "weight", "n", "lists.*"), "classes")
    sampled = classes.select("node", F.explode("sample").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("m"))
    alone = sampled.filter("m = 1").groupBy("node").agg(F.count("*").alias("alone"))
    least = F.ceil(F.col("n") * percent / F.lit(100))
    open_ = classes.join(alone, "node", "left").filter(F.coalesce("alone", F.lit(0)) <= F.col("n") - least)
    open_ = written(open_.select("node", "sign", "rep", "content", "weight", "n", "prefix"), "open")
    postings = open_.select("node", F.explode("prefix").alias("shingle"))
    hubs = postings.groupBy("shingle").agg(F.min("node").alias("hub"), F.count("*").alias("m")).filter("m > 1").select("shingle", "hub")
    stars = postings.join(hubs, "shingle").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    family = written(connected_components(stars), "families")

    members = written(open_.select("node", "sign", "rep", "content", "weight", "n").join(family, "node").drop("node"), "members")
    sizes = written(members.groupBy("component").agg(F.sum("n").alias("shingles")), "sizes")
    large = sizes.filter(F.col("shingles") > block)
    tiled = members.join(sizes, "component")
    # Blocks in order of set size, from sums by size: sets of one size are split by their id's hash.
    steps = members.join(large.select("component"), "component", "left_semi").groupBy("component", "n").agg(F.sum("n").alias("s"))
    before = F.sum("s").over(Window.partitionBy("component").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.select("component", "n", F.floor(F.coalesce(before, F.lit(0)) / block).alias("from_block"), F.ceil((F.coalesce(before, F.lit(0)) + F.col("s")) / block).alias("to_block"))
    cut = tiled.filter(F.col("shingles") > block).join(steps, ["component", "n"])
    cut = cut.withColumn("at", F.col("from_block") + F.pmod(F.xxhash64("sign"), F.greatest(F.col("to_block") - F.col("from_block"), F.lit(1))))
    cut = written(cut.select("component", "sign", "rep", "content", "weight", "n", "at"), "blocks")
    edge = cut.groupBy("component", "at").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = edge.select(F.col("component").alias("c2"), F.col("at").alias("at2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    # Block i meets block j >= i only where their sizes can link.
    meets = edge.join(other, (F.col("component") == F.col("c2")) & (F.col("at2") >= F.col("at")) & (F.col("low2") * percent <= F.col("high") * 100))
    tiles = meets.select("component", "at", "at2")
    first = cut.join(tiles, ["component", "at"]).select("sign", "rep", "content", "weight", F.xxhash64("component", "at", "at2").alias("tile"), F.lit(0).alias("side"))
    second = cut.withColumnRenamed("at", "at2").join(tiles.filter("at2 > at"), ["component", "at2"]).select("sign", "rep", "content", "weight", F.xxhash64("component", "at", "at2").alias("tile"), F.lit(1).alias("side"))
    whole = tiled.filter(F.col("shingles") <= block).select("sign", "rep", "content", "weight", F.xxhash64("component").alias("tile"), F.lit(0).alias("side"))
    placed = whole.unionByName(first).unionByName(second)

    placed = written(placed, "placed")
    # Only texts with candidates go to the tasks; their sets are made there.
    # A class goes by the id and the content of its first text, so that rows which share an id do not meet one another.
    tasks = rows.join(placed.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), ["doc_id", "content"]).select("tile", "side", "doc_id", "weight", "sign", "text")
    tasks = tasks.repartition(partitions(spark), "tile").sortWithinPartitions("tile", "side", "doc_id")
    found = written(tasks.mapInArrow(_joined(width, percent), "a long, b long, sign binary, links long"), "links")

    # An id with several texts joins their classes: edges to each class's smallest id
    several = signed.filter("n > 0").groupBy("doc_id").agg(F.min("sign").alias("low"), F.max("sign").alias("high")).filter("low <> high")
    bound = signed.filter("n > 0").join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("sign", "rep"), "sign").filter("doc_id <> rep")
    edges = found.filter("links is null").select("a", "b").unionByName(bound.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    component = connected_components(edges)
    links = found.filter("links is not null").groupBy("sign").agg(F.sum("links").alias("links"))
    named = classes.select("sign", "rep", "weight").join(written(component, "components").withColumnRenamed("node", "rep"), "rep", "left").join(links, "sign", "left")
    out = signed.select("doc_id", "n", "sign").join(named, "sign", "left")
    linked = F.col("n") > 0
    real = lambda c: F.nullif(c, F.lit(NULL_ID))
    return out.select(
        real(F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real(F.when(linked, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when(linked, F.coalesce("links", F.lit(0)) + F.col("weight") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
