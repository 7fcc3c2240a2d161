"""Exact rolling medians and median absolute deviations by square-root decomposition.

Each row's window holds the values of its series from the time after its own less
the window's length up to its own.  Medians are doubled, so that they are whole.

1.  Rows are range-partitioned by series, time, value and id into blocks of about
    ``BLOCK_ROWS`` rows, so a hot series is many blocks and a hot moment too.
2.  A block needs the rows before it that its windows reach.  Whole blocks that lie
    in the windows of all its rows come as counts by value bucket: the table of
    cumulative counts per block boundary and bucket, one row of it subtracted
    from another.  Only the blocks that some of its windows hold in part send rows.
3.  Where whole blocks were summed, a first pass finds the buckets in which medians and
    deviations can lie, and only their values are fetched.  With blocks of R rows
    and windows of W, that is in the order of R + W / buckets values a block.
4.  In a block, the same table is kept over small time blocks: two of its rows are
    subtracted, the partial blocks corrected, and one bucket is scanned for the
    median.  The deviation's radius is bisected over the buckets' counts and
    decided in the two buckets at its ends.

So no task holds a series or a window, and nothing but bucket edges leaves the tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerweave.llm.common import partitions, written

WINDOW_US = 3_600_000_000
#: Rows of a block, value buckets, rows of a block's small time blocks, and rows that are packed into one.
BLOCK_ROWS, BUCKETS, SMALL_BLOCK, RUN = 200_000, 256, 64, 4096
#: Queries answered at once.
STEP = 2048
#: Stands for no cents, or for a null id.
NONE = -(1 << 63)
#: Values from here on have no cents: their doubled differences would leave 64 bits.
MOST_VALUE = 1e15

PACKED = "p int, series string, tail boolean, first long, last long, us array<long>, cents array<long>, ids array<long>"
#: What meets in a block's task: 0 the moment that the next block goes on with, 1 counts by bucket, 2 values by bucket, 3 rows ahead, 4 own rows.
MEET = "p int, tag int, series string, us array<long>, cents array<long>, ids array<long>"
ANSWER = "click_id long, series string, us long, cents long, n long, median2 long, mad4 long, pending boolean"


def micros(ts: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a timestamp; without a zone, by its own calendar whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_micros(ts.cast("timestamp"))


class Edges:
    """Value buckets: bucket j holds the values from edge j - 1 to the one before edge j."""

    def __init__(self, edges: list[int], least: int, most: int) -> None:
        self.cut = np.array(sorted(set(edges)), np.int64)
        self.n = len(self.cut) + 1
        self.low = np.concatenate([[least], self.cut])
        self.high = np.concatenate([self.cut - 1, [most]])

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cut, x, "right")


def _ragged(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place of every element of the slices start .. start + count - 1."""
    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


class Rows:
    """Values in time order with the table of counts per small block and bucket; some queries also see a fixed set."""

    def __init__(self, x: np.ndarray, edges: Edges, counts: np.ndarray | None = None, values: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.x, self.edges, self.bucket = x, edges, edges.of(x)
        small = len(x) // SMALL_BLOCK + 1
        table = np.bincount(np.arange(len(x)) // SMALL_BLOCK * edges.n + self.bucket, minlength=small * edges.n).reshape(small, edges.n)
        self.table = np.zeros((small + 1, edges.n), np.int32)
        np.cumsum(table, axis=0, out=self.table[1:])
        self.by_bucket = np.argsort(self.bucket, kind="stable")
        self.key = self.bucket[self.by_bucket] * (len(x) + 1) + self.by_bucket
        self.counts = counts
        order = np.argsort(values, kind="stable") if values is not None else np.empty(0, np.int64)
        self.values = values[order] if values is not None else np.empty(0, np.int64)
        self.weights = weights[order] if weights is not None else np.empty(0, np.int64)
        self.value_bucket = edges.of(self.values)
        self.known = np.unique(self.value_bucket)

    def coarse(self, lo: np.ndarray, hi: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Cumulative counts by bucket for each query: one row more than there are buckets."""
        out = np.zeros((len(lo), self.edges.n + 1), np.int64)
        part = self.table[hi // SMALL_BLOCK] - self.table[lo // SMALL_BLOCK]
        for sign, at in ((1, hi), (-1, lo)):
            start = at // SMALL_BLOCK * SMALL_BLOCK
            owner, place = _ragged(start, at - start)
            part += (sign * np.bincount(owner * self.edges.n + self.bucket[place], minlength=part.size)).reshape(part.shape).astype(np.int32)
        np.cumsum(part, axis=1, out=out[:, 1:])
        if self.counts is not None and fixed.any():
            out[fixed, 1:] += np.cumsum(self.counts)
        return out

    def elements(self, lo: np.ndarray, hi: np.ndarray, fixed: np.ndarray, query: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, value and weight of all that each ``query`` sees in its ``bucket``."""
        base = bucket * (len(self.x) + 1)
        start = np.searchsorted(self.key, base + lo[query])
        owner, place = _ragged(start, np.searchsorted(self.key, base + hi[query]) - start)
        owner, value, weight = query[owner], self.x[self.by_bucket[place]], np.ones(len(place), np.int64)
        sees = np.flatnonzero(fixed[query]) if self.counts is not None else np.empty(0, np.int64)
        if len(sees):
            whole = sees[self.counts[bucket[sees]] > 0]
            if not np.isin(bucket[whole], self.known).all():
                raise AssertionError("a bucket was scanned whose values had not been fetched")
            start = np.searchsorted(self.value_bucket, bucket[whole])
            more, place = _ragged(start, np.searchsorted(self.value_bucket, bucket[whole], "right") - start)
            owner, value, weight = np.concatenate([owner, query[whole[more]]]), np.concatenate([value, self.values[place]]), np.concatenate([weight, self.weights[place]])
        return owner, value, weight


def _chosen(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, ranks: list[np.ndarray]) -> list[np.ndarray]:
    """For each query the elements of the given ranks (from 0) among its own."""
    order = np.lexsort((value, owner))
    owner, value, upto = owner[order], value[order], np.cumsum(weight[order])
    first = np.searchsorted(owner, np.arange(len(ranks[0])))
    before = np.concatenate([[0], upto])[first]
    return [value[np.searchsorted(upto, before + k, "right")] for k in ranks]


class Bracket:
    """For each query the radii between which its deviations of rank k1 and k2 lie, as far as bucket counts tell."""

    def __init__(self, edges: Edges, upto: np.ndarray, low2: np.ndarray, high2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> None:
        q, n = np.arange(len(k1)), upto[:, -1]
        # k2 + 1 neighbouring values around the median bound the radius from both sides
        one = n // 4
        near, far = self._bucket(upto, one), self._bucket(upto, np.minimum(one + k2, n - 1))
        inner, outer = self._bucket(upto, np.minimum(one + 1, n - 1)), self._bucket(upto, np.maximum(one + k1 - 1, 0))
        most = np.maximum(np.maximum(high2 - 2 * edges.low[near], 2 * edges.high[far] - low2), 0)
        least = np.minimum(low2 - 2 * edges.high[inner], 2 * edges.low[outer] - high2) - 1
        least = np.minimum(np.maximum(least, -1), most - 1)

        def some(r: np.ndarray) -> np.ndarray:
            """Counts of buckets that reach into the radius for some median of the range."""
            a, b = edges.of(-((r - low2) // 2)), edges.of((high2 + r) // 2)
            return np.where(r < 0, 0, upto[q, b + 1] - upto[q, a])

        def sure(r: np.ndarray) -> np.ndarray:
            """Counts of buckets that lie within the radius for every median of the range."""
            a, b = edges.of(-((r - high2) // 2)) + 1, edges.of((low2 + r) // 2)
            return np.where(b > a, upto[q, b] - upto[q, np.minimum(a, b)], 0)

        # ``least``: no deviation of rank k1 is that small.  Where the first guess does not hold, none is made.
        least = np.where(some(least) <= k1, least, -1)
        self.low = self._bisect(lambda r: some(r) > k1, least, most) - 1
        self.high = self._bisect(lambda r: sure(r) > k2, self.low, most)
        self.left = edges.of(-((self.high - low2) // 2)), edges.of((high2 - np.maximum(self.low, 0)) // 2)
        self.right = edges.of(-((-low2 - np.maximum(self.low, 0)) // 2)), edges.of((high2 + self.high) // 2)

    @staticmethod
    def _bucket(upto: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (upto[:, 1:] <= k[:, None]).sum(axis=1)

    @staticmethod
    def _bisect(holds, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest r in (low, high] from which ``holds``; ``high`` where it never does."""
        while (high - low > 1).any():
            middle = (low + high) // 2
            yes = holds(middle)
            high, low = np.where(yes & (high - low > 1), middle, high), np.where(yes | (high - low <= 1), low, middle)
        return high


def answers(rows: Rows, lo: np.ndarray, hi: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, doubled median and doubled median of doubled deviations for each window; the last two are 0 where n < 2."""
    n, median2, mad4 = (np.zeros(len(lo), np.int64) for _ in range(3))
    for at in range(0, len(lo), STEP):
        part = slice(at, at + STEP)
        upto = rows.coarse(lo[part], hi[part], fixed[part])
        n[part] = upto[:, -1]
        use = np.flatnonzero(upto[:, -1] >= 2)
        if not len(use):
            continue
        upto, l, h, f = upto[use], lo[part][use], hi[part][use], fixed[part][use]
        size, q = upto[:, -1], np.arange(len(use))
        k1, k2 = (size - 1) // 2, size // 2
        j1, j2 = Bracket._bucket(upto, k1), Bracket._bucket(upto, k2)
        two = np.flatnonzero(j1 != j2)
        found = rows.elements(l, h, f, np.concatenate([q, two]), np.concatenate([j1, j2[two]]))
        inside = upto[q, j1]
        middle = sum(_chosen(*found, [k1 - inside, k2 - inside]))  # nothing lies between the two buckets
        reach = Bracket(rows.edges, upto, middle, middle, k1, k2)
        (a0, a1), (b0, b1) = reach.left, reach.right
        joined = a1 >= b0
        a1 = np.where(joined, np.maximum(a1, b1), a1)
        left, right = _ragged(a0, a1 - a0 + 1), _ragged(b0[~joined], (b1 - b0 + 1)[~joined])
        query = np.concatenate([left[0], np.flatnonzero(~joined)[right[0]]])
        owner, value, weight = rows.elements(l, h, f, query, np.concatenate([left[1], right[1]]))
        certain = np.where(joined, 0, upto[q, b0] - upto[q, np.minimum(a1 + 1, b0)])
        ends = _chosen(owner, np.abs(2 * value - middle[owner]), weight, [k1 - certain, k2 - certain])
        median2[part.start + use], mad4[part.start + use] = middle, ends[0] + ends[1]
    return n, median2, mad4


def wanted(rows: Rows, lo: np.ndarray, hi: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Buckets that :func:`answers` can scan for the queries that see the fixed counts."""
    edges, marks = rows.edges, np.zeros(rows.edges.n + 1, np.int64)
    lo, hi = lo[fixed], hi[fixed]
    for at in range(0, len(lo), STEP):
        upto = rows.coarse(lo[at : at + STEP], hi[at : at + STEP], np.ones(len(lo[at : at + STEP]), bool))
        upto = upto[upto[:, -1] >= 2]
        k1, k2 = (upto[:, -1] - 1) // 2, upto[:, -1] // 2
        j1, j2 = Bracket._bucket(upto, k1), Bracket._bucket(upto, k2)
        reach = Bracket(edges, upto, edges.low[j1] + edges.low[j2], edges.high[j1] + edges.high[j2], k1, k2)
        for a, b in ((j1, j1), (j2, j2), reach.left, reach.right):
            np.add.at(marks, a, 1)
            np.add.at(marks, np.maximum(b, a) + 1, -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def _flat(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False) if column[i].is_valid else np.empty(0, np.int64)


def _pack(window: int):
    """Rows come sorted by series, time, value and id: runs of each series, and once more those that later blocks may reach."""

    def runs(p: int, series: str, tail: bool, us: np.ndarray, cents: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(us), RUN):
            t = us[k : k + RUN]
            lists = [pa.array([x[k : k + RUN]], pa.list_(pa.int64())) for x in (us, cents, ids)]
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([series]), pa.array([tail]), pa.array([int(t[0])]), pa.array([int(t[-1])]), *lists], names=[f.split()[0] for f in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, series = None, [], None

        def ended() -> Iterator[pa.RecordBatch]:
            us, cents, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from runs(p, series, False, us, cents, ids)
            late = (us > us[-1] - window) & (cents != NONE)
            yield from runs(p, series, True, us[late], cents[late], ids[late])

        for batch in batches:
            name = batch["series"]
            cuts = np.flatnonzero(np.concatenate([[True], name[1:].to_numpy(zero_copy_only=False) != name[:-1].to_numpy(zero_copy_only=False)])) if batch.num_rows else []
            for i, j in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                one = name[int(i)].as_py()
                if held and one != series:
                    yield from ended()
                    held = []
                p, series = batch["p"][0].as_py(), one
                held.append([batch[c][int(i) : int(j)].to_numpy(zero_copy_only=False) for c in ("us", "cents", "ids")])
        if held:
            yield from ended()

    return run


class Block:
    """What has met for one block id: the rows of its series in time order, and its own rows as queries."""

    def __init__(self, rows: list[tuple], edges: Edges, window: int) -> None:
        own, ahead, self.next, fixed_series, counts, values = {}, {}, {}, None, None, None
        for tag, series, us, cents, ids in rows:
            if tag == 0:
                self.next[series] = int(us[0])
            elif tag == 1:
                fixed_series, counts = series, np.bincount(cents, weights=us, minlength=edges.n).astype(np.int64)
            elif tag == 2:
                values = (cents, us)
            else:
                (own if tag == 4 else ahead).setdefault(series, []).append((us, cents, ids))
        x, lo, hi, self.own, start = [], [], [], [], 0
        for series in sorted(own):
            us, cents, ids = (np.concatenate(c) for c in zip(*own[series], strict=True))
            before = ahead.get(series, [])
            at = np.concatenate([*(b[0] for b in before), us[cents != NONE]])
            v = np.concatenate([*(b[1] for b in before), cents[cents != NONE]])
            order = np.argsort(at, kind="stable")
            at = at[order]
            x.append(v[order])
            # Rows of one moment have one window: only its last row asks
            last = np.append(us[1:] != us[:-1], True)
            t = us[last]
            lo.append(start + np.searchsorted(at, t - window, "right"))
            hi.append(start + np.searchsorted(at, t, "right"))
            self.own.append((series, us, cents, ids, np.cumsum(last) - last))
            start += len(at)
        self.lo, self.hi = np.concatenate(lo), np.concatenate(hi)
        self.fixed = np.concatenate([np.full(len(t), series == fixed_series) for t, (series, *_) in zip(lo, self.own, strict=True)])
        self.first_series = fixed_series
        self.rows = Rows(np.concatenate(x), edges, counts, *(values or (None, None)))


def _blocks(batches: Iterator[pa.RecordBatch], edges: Edges, window: int) -> Iterator[tuple[int, Block]]:
    """Rows come sorted by block id and tag."""

    def each() -> Iterator[tuple]:
        for b in batches:
            for i in range(b.num_rows):
                yield b["p"][i].as_py(), b["tag"][i].as_py(), b["series"][i].as_py(), *(_flat(b[c], i) for c in ("us", "cents", "ids"))

    for p, rows in itertools.groupby(each(), key=lambda r: r[0]):
        found = [r[1:] for r in rows]
        if any(r[0] == 4 for r in found):
            yield p, Block(found, edges, window)


def _wanted(edges: Edges, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, block in _blocks(batches, edges, window):
            need = wanted(block.rows, block.lo, block.hi, block.fixed)
            yield pa.record_batch([pa.array([p] * len(need), pa.int32()), pa.array([block.first_series] * len(need), pa.string()), pa.array(need, pa.int64())], names=["p", "series", "bucket"])

    return run


def _answered(edges: Edges, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, edges, window):
            n, median2, mad4 = answers(block.rows, block.lo, block.hi, block.fixed)
            start = 0
            for series, us, cents, ids, ask in block.own:
                at, start = start + ask, start + int(ask[-1]) + 1
                few = n[at] < 2
                columns = [
                    pa.array(ids, mask=ids == NONE), pa.array([series] * len(ids)), pa.array(us), pa.array(cents, mask=cents == NONE),
                    pa.array(n[at]), pa.array(median2[at], mask=few), pa.array(mad4[at], mask=few), pa.array(us == block.next.get(series)),
                ]
                yield pa.record_batch(columns, names=[f.split()[0] for f in ANSWER.split(", ")])

    return run


def _by_bucket(edges: Edges, window: int, whole: bool):
    """Own runs as counts: by block and bucket, all buckets of each run; or by block, bucket, time cell and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                us, cents = _flat(b["us"], i), _flat(b["cents"], i)
                us, cents = us[cents != NONE], cents[cents != NONE]
                if whole:
                    n = np.bincount(edges.of(cents), minlength=edges.n)
                    columns = {"bucket": np.arange(edges.n), "n": n}
                else:
                    cell, value = us // window, cents
                    order = np.lexsort((value, cell))
                    cell, value = cell[order], value[order]
                    head = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (value[1:] != value[:-1])])) if len(cell) else np.empty(0, np.int64)
                    columns = {"bucket": edges.of(value[head]), "cell": cell[head], "cents": value[head], "n": np.diff(np.append(head, len(cell)))}
                m = len(columns["n"])
                yield pa.record_batch([pa.array([b["p"][i].as_py()] * m, pa.int32()), pa.array([b["series"][i].as_py()] * m, pa.string()), *(pa.array(np.asarray(v, np.int64)) for v in columns.values())], names=["p", "series", *columns])

    return run


def rolling_medians(rows: DataFrame, id_col: str = "click_id", ts_col: str = "ts", series_col: str = "kind", value_col: str = "value", window_us: int = WINDOW_US, block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """click_id, kind, n, median2, mad4, far for each id of ``rows`` that has a time.

    * Of rows that share an id one is taken, the smallest by time, series and value, nulls last
      (repeated rows are equal); null is an id.  Without a time, the id goes.
    * A null series is a series.  A null value, one that is no number, and one of 10**15 or
      more have no cents: the row gets its window's figures, and ``far`` is null.
    * Rows at the same time are in one another's windows.  With ``n`` under 2 the figures are null.
    * A hot series or moment is many blocks.  An empty table gives an empty result; other
      columns are not read.
    """
    spark = rows.sparkSession
    value = F.col(value_col).cast("double")
    cents = F.when(~F.isnan(value) & (F.abs(value) < MOST_VALUE), F.floor(100 * value + F.lit(0.5)).cast("long"))
    series = F.coalesce(F.concat(F.lit("="), F.col(series_col).cast("string")), F.lit(""))
    plain = rows.select(F.col(id_col).cast("long").alias("ids"), micros(F.col(ts_col), rows.schema[ts_col].dataType).alias("us"), series.alias("series"), cents.alias("cents"))
    least = F.min(F.struct(F.col("us").isNull().alias("a"), "us", F.col("series").eqNullSafe("").alias("b"), "series", F.col("cents").isNull().alias("c"), "cents"))
    once = plain.groupBy("ids").agg(least.alias("row")).select("ids", "row.us", "row.series", "row.cents").filter("us is not null")
    once = once.select("series", "us", F.coalesce("cents", F.lit(NONE)).alias("cents"), F.coalesce("ids", F.lit(NONE)).alias("ids"))

    blocks_wanted = max(partitions(spark), -(-rows.count() // block_rows))
    order = ["series", "us", "cents", "ids"]
    placed = once.repartitionByRange(blocks_wanted, *order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())
    packed = written(placed.mapInArrow(_pack(window_us), PACKED), "packed")
    own, tails = packed.filter(~F.col("tail")), packed.filter("tail")

    # Edges: some buckets' worth of the runs' values by approximate rank; any edges give the same results.
    shares = [k / buckets for k in range(1, buckets)]
    found = own.select(F.explode("cents").alias("cents")).filter(F.col("cents") != NONE).agg(F.percentile_approx("cents", shares, 4 * buckets).alias("cut"), F.min("cents").alias("low"), F.max("cents").alias("high")).first()
    edges = Edges(found["cut"] or [], found["low"] or 0, found["high"] or 0)

    cell = lambda c: F.expr(f"({c} - pmod({c}, {window_us}L)) div {window_us}L")
    apart = lambda df: df.hint("shuffle_hash")  # noqa: E731  what has a row for each block is never broadcast
    blocks = written(own.groupBy("p", "series").agg(F.min("first").alias("first"), F.max("last").alias("last")), "blocks")
    reach = blocks.select("p", "series", "first", "last", F.explode(F.array(cell("first"), cell("first") - 1)).alias("cell"))
    earlier = blocks.select(F.col("p").alias("q"), "series", F.col("first").alias("q_first"), cell("first").alias("cell"))
    inside = reach.join(apart(earlier), ["series", "cell"]).filter((F.col("q") < F.col("p")) & (F.col("q_first") > F.col("last") - window_us))
    full = written(inside.groupBy("p", "series", "first").agg(F.min("q").alias("from")), "full")  # blocks from .. p - 1 lie in all windows of p
    start = reach.join(apart(full.select("p", "series", "from")), ["p", "series"], "left").withColumn("from", F.coalesce("from", "p"))
    runs = tails.select(F.col("p").alias("q"), "series", F.col("last").alias("q_last"), cell("last").alias("cell"), "us", "cents")
    ahead = runs.join(apart(start.drop("last")), ["series", "cell"]).filter((F.col("q") < F.col("from")) & (F.col("q_last") > F.col("first") - window_us))
    no_ids = F.array().cast("array<long>").alias("ids")
    meet = own.select("p", F.lit(4).alias("tag"), "series", "us", "cents", "ids").unionByName(ahead.select("p", F.lit(3).alias("tag"), "series", "us", "cents", no_ids))
    after = blocks.select((F.col("p") - 1).alias("p"), "series", F.col("first").alias("next"))
    going_on = blocks.join(apart(after), ["p", "series"]).filter("last = next").select("p", F.lit(0).alias("tag"), "series", F.array("next").alias("us"), F.array("next").alias("cents"), no_ids)
    dealt = lambda df: df.repartition(partitions(spark), "p").sortWithinPartitions("p", "tag", "series", F.array_min("us"), F.array_max("us"))

    if not full.isEmpty():
        dense = blocks.join(apart(full.select("series").distinct()), "series", "left_semi").withColumn("cell", cell("first"))
        counts = own.join(apart(dense.select("p", "series")), ["p", "series"], "left_semi").mapInArrow(_by_bucket(edges, window_us, True), "p int, series string, bucket long, n long")
        counts = counts.groupBy("p", "series", "bucket").agg(F.sum("n").alias("n")).join(apart(dense.select("p", "series", "cell")), ["p", "series"])
        # The table: counts of all blocks before each block's boundary, from the start of its time cell
        by_cell = Window.partitionBy("series", "bucket", "cell")
        table = written(counts.select("p", "series", "bucket", "cell", (F.sum("n").over(by_cell.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(by_cell).alias("whole")), "boundary-table")
        lower = table.select(F.col("p").alias("from"), "series", "bucket", F.col("cell").alias("from_cell"), F.col("before").alias("from_before"), F.col("whole").alias("from_whole"))
        fixed = table.join(apart(full), ["p", "series"]).join(apart(lower), ["from", "series", "bucket"])
        rest = F.when(F.col("cell") == F.col("from_cell"), F.lit(0)).otherwise(F.col("from_whole"))
        fixed = fixed.select("p", "series", "bucket", (rest + F.col("before") - F.col("from_before")).alias("n"))
        lists = fixed.groupBy("p", "series").agg(F.collect_list(F.struct("bucket", "n")).alias("all"))  # as many as there are buckets
        meet = written(meet.unionByName(lists.select("p", F.lit(1).alias("tag"), "series", F.col("all.n").alias("us"), F.col("all.bucket").alias("cents"), no_ids)), "first-pass")
        need = written(dealt(meet.join(apart(full.select("p").distinct()), "p", "left_semi")).mapInArrow(_wanted(edges, window_us), "p int, series string, bucket long"), "needed")
        need = need.join(apart(full), ["p", "series"]).select("p", "series", "bucket", "from", F.explode(F.array(cell("first"), cell("first") - 1)).alias("cell"))
        values = own.join(apart(dense.select("p", "series")), ["p", "series"], "left_semi").mapInArrow(_by_bucket(edges, window_us, False), "p int, series string, bucket long, cell long, cents long, n long")
        values = values.withColumnRenamed("p", "q").join(apart(need), ["series", "bucket", "cell"]).filter((F.col("q") >= F.col("from")) & (F.col("q") < F.col("p")))
        values = values.groupBy("p", "series", "cents").agg(F.sum("n").alias("n"))
        lists = values.groupBy("p", "series").agg(F.collect_list(F.struct("cents", "n")).alias("all"))  # in the order of a block's rows and one bucket
        meet = meet.unionByName(lists.select("p", F.lit(2).alias("tag"), "series", F.col("all.n").alias("us"), F.col("all.cents").alias("cents"), no_ids))
    answer = written(dealt(meet.unionByName(going_on)).mapInArrow(_answered(edges, window_us), ANSWER), "answers")
    # A moment that the next block goes on with is answered by the last block that has it.
    moments = answer.filter("pending").select("series", "us").distinct()
    told = answer.filter(~F.col("pending")).join(apart(moments), ["series", "us"], "left_semi").groupBy("series", "us").agg(*(F.max(c).alias(c) for c in ("n", "median2", "mad4")))
    late = answer.filter("pending").select("click_id", "series", "us", "cents").join(apart(told), ["series", "us"])
    columns = ["click_id", "series", "cents", "n", "median2", "mad4"]
    out = answer.filter(~F.col("pending")).select(*columns).unionByName(late.select(*columns))
    kind = F.when(F.col("series") != "", F.expr("substring(series, 2)"))
    return out.select("click_id", kind.alias("kind"), "n", "median2", "mad4", (2 * F.abs(2 * F.col("cents") - F.col("median2")) > 3 * F.col("mad4")).alias("far"))
