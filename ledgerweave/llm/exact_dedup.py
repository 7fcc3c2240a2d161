"""Exact dedup by content sort.

Texts are equal when they are identical after all blanks are deleted.  Rows are
range-partitioned by their normalised bytes at sampled splitters and sorted
within each partition by Spark's external sorter, which spills; equal texts then
lie side by side, and each row is compared in full with its neighbour.

The splitter key is the first bytes of the normalised text, then its digest, and
then the row's rank among equals, so a key stays short however long the texts
are and a group of copies that holds a third of all rows is spread over as many
partitions as its size asks for.  Runs that touch the edge of a partition are
joined by a table of two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.common import BLANKS, partitions, written

#: Characters of the normalised text that stand in a splitter, before its digest.
SPLITTER_CHARS = 32

_GONE = str.maketrans("", "", BLANKS)
_ADDED = "__part int, __edge boolean, __head boolean, __size long, __keep_id long"


def _closed(parts: list[pa.RecordBatch], heads: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
    """Whole runs with their size and first id; ``first`` and ``last``: the outer runs touch the partition's edge."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    starts = np.flatnonzero(heads)
    size = np.diff(np.append(starts, rows.num_rows))
    which = np.repeat(np.arange(len(starts)), size)
    edge = np.zeros(rows.num_rows, bool)
    if first:
        edge[: size[0]] = True
    if last:
        edge[starts[-1] :] = True
    part = np.full(rows.num_rows, TaskContext.get().partitionId(), np.int32)
    added = (part, edge, heads, size[which], pc.take(rows["__id"], pa.array(starts[which])))
    for field, values in zip(_ADDED.split(", "), added, strict=True):
        rows = rows.append_column(field.split()[0], values if isinstance(values, pa.ChunkedArray) else pa.array(values))
    return rows.combine_chunks().to_batches()[0]


def _runs(text_at: int, carry: bool):
    """Adds to each sorted row its run's size and first row within the partition.

    Rows are held until their run ends: without texts unless they are carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the run that is still open
        held_heads: list[np.ndarray] = []
        sha_before = text_before = None
        first = True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sha, text = batch["__sha"], batch.column(text_at)
            head = np.ones(n, bool)
            head[1:] = ~pc.equal(sha.slice(1), sha.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            head[0] = sha[0].as_py() != sha_before
            for k in np.flatnonzero(~head):  # the digests agree: compare the texts in full
                before = (text[int(k) - 1].as_py() if k else text_before) or ""
                now = text[int(k)].as_py() or ""
                head[k] = before != now and before.translate(_GONE) != now.translate(_GONE)
            sha_before, text_before = sha[n - 1].as_py(), text[n - 1].as_py()
            rows = batch if carry else batch.drop_columns([batch.schema.names[text_at]])
            starts = np.flatnonzero(head)
            if not len(starts):
                held.append(rows)
                held_heads.append(head)
                continue
            if held:
                begin, end = int(starts[0]), int(starts[-1])
                yield _closed([*held, rows.slice(0, begin)], np.concatenate([*held_heads, head[:begin]]), first, False)
                first = False
            else:
                begin, end = 0, int(starts[-1])
            if end > begin:
                yield _closed([rows.slice(begin, end - begin)], head[begin:end], first, False)
                first = False
            held, held_heads = [rows.slice(end)], [head[end:]]
        if held:
            yield _closed(held, np.concatenate(held_heads), first, True)

    return run


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, prefer_longer: bool, carry: bool) -> DataFrame:
    """Each row with its run; with ``carry`` also the columns of ``docs``, as ``c0``, ``c1`` and so on."""
    spark = docs.sparkSession
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(at[text_col], F.lit(""))
    bare = F.translate(text, BLANKS, "")
    rows = named.select(
        *(named.columns if carry else [F.col(at[text_col])]),
        F.col(at[id_col]).cast("long").alias("__id"),
        F.length(text).alias("__n"),
        F.substring(bare, 1, SPLITTER_CHARS).alias("__start"),
        F.sha2(bare, 256).alias("__sha"),
    )
    order = [F.col("__start"), F.col("__sha"), *([F.col("__n").desc()] if prefer_longer else []), F.col("__id").asc_nulls_last()]
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("__start", "__n")
    fields = [f for f in placed.schema.fields if carry or f.name != at[text_col]]
    schema = T.StructType(fields + T._parse_datatype_string(_ADDED).fields)
    found = written(placed.mapInArrow(_runs(placed.columns.index(at[text_col]), carry), schema), "runs")
    # Two rows a partition at most, whatever the input: the runs that may go on in another partition.
    edges = found.filter("__edge and __head").groupBy("__sha").agg(F.min("__part").alias("from_part"), F.expr("min_by(__keep_id, __part)").alias("from_id"), F.sum("__size").alias("total"))
    edges = edges.withColumnRenamed("__sha", "sha")
    out = found.join(F.broadcast(edges), (found["__sha"] == edges["sha"]) & found["__edge"], "left")
    return out.select(
        *(c for c in found.columns if c not in ("__head", "__edge", "__part", "__size", "__keep_id")),
        F.when(F.col("sha").isNull(), F.col("__keep_id")).otherwise(F.col("from_id")).alias("__keep_id"),
        F.coalesce("total", "__size").alias("__size"),
        (F.col("__head") & (F.col("sha").isNull() | (F.col("__part") == F.col("from_part")))).alias("__kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefer_longer: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest id stays; with ``prefer_longer``, the row with
    the most code points before normalisation, then the smallest id.

    * Null text counts as empty; empty texts are equal to one another.
    * A null id comes after all others.  Repeated rows are members of one group,
      and exactly one of them is kept.
    * An empty table gives an empty result; other columns are not read.
    """
    return _sorted_runs(docs, id_col, text_col, prefer_longer, False).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep_id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefer_longer: bool = False) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; cases as in :func:`exact_dedup`."""
    runs = _sorted_runs(docs, id_col, text_col, prefer_longer, True).filter("__kept")
    return runs.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
