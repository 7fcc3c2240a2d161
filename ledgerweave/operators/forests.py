"""Components and spanning forests of edge tables at any size.

Each partition first keeps a spanning forest of its own edges, which loses no
connection (nor, by edge order, any edge of the least forest) and leaves fewer
rows than the partition has nodes.  While more than ``one_task`` edges are left,
they are contracted in rounds over all partitions; a bounded rest ends in one task.
Tables between the steps are kept as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.kept import kept

#: Edges that one task may finish.
ONE_TASK = 1_000_000
#: Edges that a partition holds before it keeps only their forest.
HELD = 500_000


def _joined(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges x - y join two parts of n nodes when taken in their order, and each node's part.

    Boruvka's rule over whole arrays: every part takes its first edge that leaves it, which
    is what taking edges one by one keeps, and the number of parts at least halves a round.
    """
    part, keep = np.arange(n), np.zeros(len(x), bool)
    at = np.flatnonzero(x != y)
    while len(at):
        a, b = part[x[at]], part[y[at]]
        out = a != b
        at, a, b = at[out], a[out], b[out]
        if not len(at):
            break
        first = np.full(n, -1)
        for end in (a, b):  # the first edge is written last, so it stays
            mine = np.full(n, -1)
            mine[end[::-1]] = np.arange(len(at))[::-1]
            first = np.where(first < 0, mine, np.where(mine < 0, first, np.minimum(first, mine)))
        own = np.flatnonzero(first >= 0)
        edge = first[own]
        keep[at[edge]] = True
        to = np.arange(n)
        to[own] = np.where(a[edge] == own, b[edge], a[edge])
        back = own[(to[to[own]] == own) & (own < to[own])]  # two parts that took one edge
        to[back] = back
        while not np.array_equal(further := to[to], to):
            to = further
        part = to[part]
    return keep, part


def kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    """The rows, in their order, that join two parts: a spanning forest, the least one by that order."""
    codes, names = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
    return edges[_joined(codes[: len(edges)], codes[len(edges) :], len(names))[0]]


def _local(order: list[str]):
    """Each partition's edges as a spanning forest: with an ``order`` the least one, where the ends break ties alike everywhere.

    Edges are held until there are twice as many as the last forest had, so that one of many nodes is not made anew a batch.
    """

    def forest(held: list[pd.DataFrame]) -> pd.DataFrame:
        edges = pd.concat(held, ignore_index=True)
        return kruskal(edges.sort_values([*order, "a", "b"]) if order else edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, most = 0, HELD
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > most:
                held = [forest(held)]
                size = len(held[0])
                most = max(HELD, 2 * size)
        if held:
            yield forest(held)

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def local_forest(edges: DataFrame, order: list[str]) -> DataFrame:
    """At most one edge fewer than it has nodes of each partition's edges (columns a, b and those of ``order``, ascending)."""
    edges = edges.select("a", "b", *order)
    return edges.mapInPandas(_local(order), _schema(edges))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(batches)
    if sum(map(len, held)):
        edges = pd.concat(held, ignore_index=True)
        codes, nodes = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True), sort=True)
        part = _joined(codes[: len(edges)], codes[len(edges) :], len(nodes))[1]
        least = np.full(len(nodes), len(nodes))
        np.minimum.at(least, part, np.arange(len(nodes)))
        yield pd.DataFrame({"node": nodes, "component": nodes[least[part]]})


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b); both null-free and of one type.

    A self-loop names a component of its own.  While more than ``one_task`` edges are
    left they are contracted: every node becomes the one of its neighbours and itself
    whose hash is least, under a new hash each round, so nodes of many edges become few
    and only what still joins two is kept.  The rest ends in one task, and names are
    handed back through the rounds.
    """
    kind = dict(edges.dtypes)["a"]
    loops = edges.filter("a = b").select("a", "b").distinct()
    rest = kept(local_forest(edges.filter("a <> b"), []).unionByName(loops))
    if rest.count() <= one_task:
        return rest.coalesce(1).mapInPandas(_stars, f"node {kind}, component {kind}")
    maps = []
    while rest.count() > one_task:
        if len(maps) == rounds:
            raise RuntimeError(f"edges are still left after {rounds} rounds")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("h"), F.col(c).alias("to"))
        ends = rest.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(rest.select(F.col("b").alias("node"), rank("a").alias("r")))
        label = ends.groupBy("node").agg(F.min("r").alias("r"))
        label = kept(label.select("node", F.least(rank("node"), F.col("r"))["to"].alias("to")))
        maps.append(label)
        for end in ("a", "b"):
            rest = rest.join(label.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        rest = kept(local_forest(rest.filter("a <> b"), []))
    named = rest.coalesce(1).mapInPandas(_stars, f"node {kind}, component {kind}")
    for label in reversed(maps):  # a contracted node without edges keeps its name
        named = label.join(named.select(F.col("node").alias("to"), "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    named = kept(named)
    least = named.groupBy("component").agg(F.min("node").alias("least"))
    return named.join(least, "component").select("node", F.col("least").alias("component"))


def spanning_forest(edges: DataFrame, order: list[str], one_task: int = ONE_TASK) -> DataFrame:
    """The least spanning forest of ``edges`` (a, b and the columns of ``order``, compared ascending, then the ends).

    A round of Boruvka's rule picks the least edge of every node, contracts what
    they connect, and of parallel edges keeps the least; at least half of the nodes
    go each time.  An edge keeps its own ends (a, b) beside the contracted ones.
    """
    rest = kept(local_forest(edges.filter("a <> b"), order))
    rank = lambda df: F.struct(*(df[c] for c in (*order, "a", "b")))
    chosen = None
    rest = rest.withColumns({"x": F.col("a"), "y": F.col("b")})
    while rest.count() > one_task:
        ends = rest.select(F.explode(F.array("x", "y")).alias("node"), rank(rest).alias("e"))
        picked = kept(ends.groupBy("node").agg(F.min("e").alias("e")).select("e.*").distinct())
        chosen = picked if chosen is None else chosen.unionByName(picked)
        linked = rest.join(picked.select("a", "b"), ["a", "b"], "left_semi").select(F.col("x").alias("a"), F.col("y").alias("b"))
        label = components(linked, one_task=one_task)
        for end in ("x", "y"):
            rest = rest.join(label.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        rest = rest.filter("x <> y").withColumns({"low": F.least("x", "y"), "high": F.greatest("x", "y")})
        rest = kept(rest.groupBy("low", "high").agg(F.min(rank(rest)).alias("e")).select("e.*", F.col("low").alias("x"), F.col("high").alias("y")))
    last = rest.coalesce(1).mapInPandas(_last(order), _schema(rest.select("a", "b", *order)))
    columns = ["a", "b", *order]
    return last.select(*columns) if chosen is None else chosen.select(*columns).unionByName(last.select(*columns))


def _last(order: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            rest = pd.concat(held).sort_values([*order, "a", "b"]).reset_index(drop=True)
            kept = kruskal(rest[["x", "y"]].rename(columns={"x": "a", "y": "b"}))
            yield rest.loc[kept.index, ["a", "b", *order]]

    return run


def tagged(tag: Column, node: str) -> Column:
    """A node's name within one of several graphs that share a table."""
    return F.concat_ws("|", tag.cast("string"), F.col(node))


def threshold_components(edges: DataFrame, weight: str, thresholds: tuple[int, ...], one_task: int = ONE_TASK) -> DataFrame:
    """threshold, node, component: components of the edges with at least that weight, for all thresholds in one search."""
    each = edges.select("a", "b", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda k: k <= F.col(weight))).alias("k"))
    found = components(each.select(tagged(F.col("k"), "a").alias("a"), tagged(F.col("k"), "b").alias("b")), one_task=one_task)
    rest = lambda c: F.expr(f"substring({c}, instr({c}, '|') + 1)")
    return found.select(F.substring_index("node", "|", 1).cast("int").alias("threshold"), rest("node").alias("node"), rest("component").alias("component"))


def components_before(edges: DataFrame, asks: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """For each (k, address, time_step) of ``asks``, which are distinct: its component, and the component's size, by edges of strictly earlier steps.

    ``edges``: k, a, b, active_from (k: which graph).  Steps are halved instead of
    walked: edges before the middle are contracted for all that lies behind it, and
    both halves go on at once, so S steps take log2 S searches over all graphs and
    halves together.  Every component is made once, with its size; an ask ends at
    the one that holds at its step.  Without an earlier edge it is the address itself, size 1,
    and takes no part in the searches.
    """
    span = edges.agg(F.min("active_from").alias("low"), F.max("active_from").alias("high")).first()
    asks = asks.select("k", "address", "time_step")
    ends = edges.select("k", F.explode(F.array("a", "b")).alias("address"), "active_from")
    asks = kept(asks.join(ends.groupBy("k", "address").agg(F.min("active_from").alias("first")), ["k", "address"], "left"))
    alone = F.coalesce(F.col("time_step") <= F.col("first"), F.lit(True))
    alones = asks.filter(alone).select("k", "address", "time_step", F.col("address").alias("component"), F.lit(1).cast("long").alias("component_size"))
    asks = asks.filter(~alone).drop("first")
    if asks.isEmpty():
        return alones
    width = 1 << max(0, (span.high - span.low).bit_length())
    node = edges.select(tagged(F.col("k"), "a").alias("a"), tagged(F.col("k"), "b").alias("b"), F.col("active_from").alias("s"))
    rest = kept(local_forest(node, ["s"]).withColumn("lo", F.lit(span.low)))
    asking = kept(asks.select("*", tagged(F.col("k"), "address").alias("x"), F.least(F.greatest(F.col("time_step"), F.lit(span.low)), F.lit(span.low + width)).alias("t"), F.lit(span.low).alias("lo")))
    sizes = None
    while width >= 1:
        half = max(1, width // 2)
        middle = F.col("lo") + half
        within = lambda c: F.concat_ws("#", F.col("lo").cast("string"), F.col(c))
        early = rest.filter(F.col("s") < middle)
        found = components(early.select(within("a").alias("a"), within("b").alias("b")), one_task=one_task)
        label = kept(found.select(
            F.substring_index("node", "#", 1).cast("int").alias("lo"), F.expr("substring(node, instr(node, '#') + 1)").alias("x"),
            F.concat(F.lit(f"@{width}@"), F.col("component")).alias("to"),
        ))
        counted = label if sizes is None else label.join(sizes.withColumnRenamed("name", "x"), "x", "left")
        size = F.sum(F.coalesce("size", F.lit(1)) if sizes is not None else F.lit(1))
        made = counted.groupBy("to").agg(size.alias("size")).select(F.col("to").alias("name"), "size")
        sizes = kept((made if sizes is None else sizes.unionByName(made)))
        # What an ask or edge behind the middle sees of a node is the node's component
        asking = asking.join(label, ["lo", "x"], "left").withColumn("behind", F.col("t") >= middle)
        asking = kept(asking.select("k", "address", "time_step", "t", F.when(F.col("behind"), F.coalesce("to", "x")).otherwise(F.col("x")).alias("x"), F.when(F.col("behind"), middle).otherwise(F.col("lo")).alias("lo")))
        if width == 1:
            break
        late = rest.filter(F.col("s") >= middle)
        for end in ("a", "b"):
            late = late.join(label.withColumnRenamed("x", end), ["lo", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        late = late.filter("a <> b").select("a", "b", "s", middle.alias("lo"))
        rest = kept(early.select("a", "b", "s", "lo").unionByName(late))
        width = half
    named = asking.join(sizes.withColumnRenamed("name", "x"), "x", "left")
    plain = F.col("size").isNull()
    return alones.unionByName(named.select("k", "address", "time_step", F.when(plain, F.col("address")).otherwise(F.col("x")).alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("component_size")))
