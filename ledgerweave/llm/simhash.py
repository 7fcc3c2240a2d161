"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of the XXH64 values of
its word shingles (repeats included) have it.  Fingerprints that differ in at
most ``radius`` bits are linked, and links make components.

Covering: each bit gets a vector of ``radius + 1`` bits that is not zero, and for
each vector v that is not zero there is one mask, of the bits whose vector has an
odd product with v.  For any ``radius`` bits there is a v orthogonal to all of
their vectors, so two fingerprints that differ in these bits alone are equal
under v's mask: every pair within the radius meets in some table, with about half
of the bits to tell the others apart.

A bucket of more than ``LARGE`` fingerprints is dealt again by a covering family
over the bits that its mask leaves open, so that its pairs keep the guarantee.
Each such step leaves about half of the open bits (for radius 3: 32, 16, then 8), so
a bucket of the third step holds at most 256 fingerprints.  No bucket is dropped or cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, partitions, slices, text_buffers, written
from ledgerweave.llm.components import EDGES, connected_components

WIDTH, RADIUS, SEED, BITS = 3, 3, 42, 64
#: Fingerprints of one bucket that are compared with one another; a larger bucket is dealt again.  At least ``LEAST_LARGE``, which so few open bits cannot exceed that steps end.
LARGE, LEAST_LARGE = 2048, 256
#: Buckets up to this size are compared together with others, by shifting.
SMALL = 12


def shingle_values(data: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of all shingles of a UTF-8 text, repeats included: A-Z as a-z, words joined by one space."""
    words = data.lower().split()  # of bytes: A-Z and the six blanks of ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(words) - width + 1)


def majority(values: np.ndarray) -> int:
    """The bits set in more than half of ``values``; 0 for none."""
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(values), 1 << 15):
        part = np.ascontiguousarray(values[k : k + (1 << 15)], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                buf, off = text_buffers(part["text"])
                found = [majority(shingle_values(buf[a:b].tobytes(), width)) for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.record_batch([part["doc_id"], pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "print"])

    return run


def covering_masks(open_bits: int, radius: int = RADIUS) -> list[int]:
    """Masks within the bits of ``open_bits`` such that any two numbers that differ in at most ``radius`` of these bits, and in no others, are equal under one of them."""
    places = [b for b in range(BITS) if open_bits >> b & 1]
    most = (1 << (radius + 1)) - 1
    vector = {b: 1 + k % most for k, b in enumerate(places)}
    return [sum(1 << b for b in places if (vector[b] & v).bit_count() % 2) for v in range(1, most + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _deeper(spark: SparkSession, kept: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """For each mask the masks of the next step, which keep its bits and more; (radius-dependent, data-independent) rows."""
    every = (1 << BITS) - 1
    rows = [(_signed(k), [_signed(k | m) for m in covering_masks(every & ~k, radius)]) for k in kept]
    return spark.createDataFrame(rows, "mask long, masks array<long>"), sorted({m & every for _, ms in rows for m in ms})


def links_within(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between distinct fingerprints: each with the first that it leads to."""
    near = np.empty((len(x), len(x)), bool)
    for k in range(0, len(x), 256):
        near[k : k + 256] = np.bitwise_count(x[k : k + 256, None] ^ x[None, :]) <= radius
    root = np.full(len(x), -1)
    for first in range(len(x)):
        if root[first] >= 0:
            continue
        edge = np.array([first])
        while len(edge):
            root[edge] = first
            edge = np.flatnonzero(near[edge].any(axis=0) & (root < 0))
    led = np.flatnonzero(root != np.arange(len(x)))
    return x[led], x[root[led]]


def _compared(radius: int):
    """Rows come sorted by bucket: a forest of each bucket's links, or the links themselves in small buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in _ended(batches):
            if batch is not None:
                held = [np.concatenate([h, batch[c].to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("mask", "key", "print"), strict=True)]
            mask, key, x = held
            if not len(x):
                continue
            heads = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            done = len(x) if batch is None else int(heads[-1])  # the last bucket may go on
            heads = heads[heads < done]
            held = [h[done:] for h in held]
            if not len(heads):
                continue
            x = x[:done].view(np.uint64)
            size = np.diff(np.append(heads, done))
            group = np.repeat(np.arange(len(heads)), size)
            a, b = [], []
            small = np.repeat(size <= SMALL, size)
            for shift in range(1, min(SMALL, done)):
                ok = small[:-shift] & (group[:-shift] == group[shift:])
                ok &= np.bitwise_count(x[:-shift] ^ x[shift:]) <= radius
                a.append(x[shift:][ok])
                b.append(x[:-shift][ok])
            for g in np.flatnonzero(size > SMALL).tolist():
                one, other = links_within(x[heads[g] : heads[g] + size[g]], radius)
                a.append(one)
                b.append(other)
            if a:
                yield pa.record_batch([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_links(prints: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """Links a, b that connect whatever fingerprints of ``prints`` (print: long, distinct) lie within the radius of one another.

    Not every such pair comes out, but each pair's ends are connected by those that do.
    """
    if large < LEAST_LARGE:
        raise ValueError(f"large must be at least {LEAST_LARGE}")
    spark = prints.sparkSession
    rows, kept, found = prints.select("print", F.lit(0).cast("long").alias("mask")), [0], []
    while True:
        deeper, kept = _deeper(spark, kept, radius)
        rows = rows.join(F.broadcast(deeper), "mask").select("print", F.explode("masks").alias("mask"))
        rows = rows.withColumn("key", F.col("print").bitwiseAND(F.col("mask")))
        sizes = written(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        tasks = rows.join(sizes.filter(F.col("n") <= large), ["mask", "key"]).select("mask", "key", "print")
        tasks = tasks.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "print")
        found.append(written(tasks.mapInArrow(_compared(radius), EDGES), "near"))
        crowded = sizes.filter(F.col("n") > large)
        if crowded.isEmpty():
            break
        rows = written(rows.join(crowded.drop("n"), ["mask", "key"], "left_semi").select("print", "mask").distinct(), "crowded")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    ``component_id`` is the smallest id of a row whose fingerprint is reached by
    links, the row itself included.

    * Null or empty text, or one without words: fingerprint zero, linked like any other.
    * Fewer than ``width`` words: the whole sequence is the one shingle.
    * Links are between fingerprints: rows that share an id but not a fingerprint are
      not linked by it.  A null id is passed over where another id is reached.
    * Very long texts are read whole; a task holds about a megabyte of texts, or one.
    * An empty table gives an empty result; other columns are not read.
    """
    prints = written(id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(width), "doc_id long, print long"), "fingerprints")
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "print-classes")
    label = written(connected_components(near_links(classes.select("print"), radius, large)).withColumnRenamed("node", "print"), "print-labels")
    lowest = label.join(classes, "print").groupBy("component").agg(F.min("least").alias("lowest"))
    named = classes.join(label, "print", "left").join(lowest, "component", "left")
    named = named.select("print", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id"))
    return prints.join(named, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
