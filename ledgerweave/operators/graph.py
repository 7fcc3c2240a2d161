"""The heterogeneous investigation graph and its neighbourhood, path and profile queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.kept import kept


def edge_id(source: Column, target: Column, relation: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, target, relation), 256), 1, 24)


def tx_node(c: str) -> Column:
    return F.concat(F.lit("tx:"), F.col(c).cast("string"))


def continuity(steps: DataFrame, inputs: DataFrame) -> DataFrame:
    """txid, next_txid, address: consecutive spenders of an address, by step (null last) and id."""
    order = Window.partitionBy("address").orderBy(F.asc_nulls_last("time_step"), "txid")
    used = inputs.join(steps, "txid").withColumn("next_txid", F.lead("txid").over(order)).filter("next_txid is not null")
    return used.groupBy("txid", "next_txid").agg(F.min("address").alias("shared_address"))


def edges(steps: DataFrame, inputs: DataFrame, outputs: DataFrame, observations: DataFrame) -> DataFrame:
    """edge_id, source, target, relation, shared_address for the five relations, one row a (source, target, relation)."""
    none = F.lit(None).cast("string")
    wallet, ip = F.concat(F.lit("wallet:"), F.col("address")), lambda c: F.concat(F.lit("ip:"), F.col(c))
    seen = observations.join(steps.select("txid"), "txid", "left_semi")
    parts = [
        inputs.select(wallet.alias("source"), tx_node("txid").alias("target"), F.lit("INPUT_TO").alias("relation"), none.alias("shared_address")),
        outputs.select(tx_node("txid"), wallet, F.lit("OUTPUT_TO"), none),
        seen.select(ip("src_ip"), tx_node("txid"), F.lit("OBSERVED_SOURCE"), none).distinct(),
        seen.select(tx_node("txid"), ip("dst_ip"), F.lit("OBSERVED_DESTINATION"), none).distinct(),
        continuity(steps, inputs).select(tx_node("txid"), tx_node("next_txid"), F.lit("ADDRESS_REUSE_CONTINUITY"), "shared_address"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(edge_id(F.col("source"), F.col("target"), F.col("relation")).alias("edge_id"), "*")


def nodes(steps: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """node_id, node_type, time_step of every transaction and every endpoint."""
    ends = graph_edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    all_tx = steps.select(tx_node("txid").alias("node_id"), "time_step")
    kind = F.when(F.col("node_id").startswith("tx:"), "transaction").when(F.col("node_id").startswith("wallet:"), "wallet").otherwise("ip")
    return ends.unionByName(all_tx.select("node_id")).distinct().join(all_tx, "node_id", "left").select("node_id", kind.alias("node_type"), "time_step")


def neighbourhood(graph_edges: DataFrame, node: str) -> DataFrame:
    """Edges in and out of a node, with the other end."""
    here = (F.col("source") == node) | (F.col("target") == node)
    return graph_edges.filter(here).select("edge_id", "relation", F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("neighbour"), F.when(F.col("source") == node, "out").otherwise("in").alias("direction"))


def context(graph_nodes: DataFrame, graph_edges: DataFrame, node: str) -> DataFrame:
    """The neighbours' attributes beside their edges; neighbours without a node row go."""
    near = neighbourhood(graph_edges, node)
    return near.join(graph_nodes, near["neighbour"] == graph_nodes["node_id"]).select("edge_id", "relation", "direction", "neighbour", "node_type", "time_step")


#: Frontier nodes that may be sent to every task.
SENT = 200_000


def _beyond(links: DataFrame, front: DataFrame, nodes: int, seen: list[DataFrame], ahead: bool, sent: int) -> DataFrame:
    """The nodes next to ``front`` that the two levels before do not have, each with its smallest path; ``ahead``: from the source."""
    near = F.broadcast(front) if nodes <= sent else front  # a stated number of rows
    ends = [links.join(near, links[x] == near["node"]).select(F.col(y).alias("node"), "path") for x, y in (("a", "b"), ("b", "a"))]
    step = ends[0].unionByName(ends[1]).groupBy("node").agg(F.min("path").alias("path"))
    for level in seen[-2:]:  # neighbours of a level lie on it, one before or one behind it
        step = step.join(level.select("node"), "node", "left_anti")
    return kept(step.select("node", (F.concat("path", F.array("node")) if ahead else F.concat(F.array("node"), "path")).alias("path")))


def shortest_path(graph_edges: DataFrame, source: str, target: str, max_depth: int = 6, sent: int = SENT) -> DataFrame:
    """hop, node along the shortest undirected path (ties: the smallest path); no row when there is none.

    A search from both ends over edges that are written once: each round takes
    the end with the smaller frontier one step on and keeps the smallest path to each
    new node, until the frontiers meet.  Up to ``sent`` frontier nodes go to the
    edges, which are then only read.
    """
    spark = graph_edges.sparkSession
    links = kept(graph_edges.select(F.col("source").alias("a"), F.col("target").alias("b")).filter("a <> b"))
    levels = [[spark.createDataFrame([(end, [end])], "node string, path array<string>")] for end in (source, target)]
    sizes = [1, 1]
    for depth in range(max_depth + 1):
        tail = levels[1][-1].select("node", F.col("path").alias("rest"))
        met = levels[0][-1].join(tail, "node").agg(F.min(F.concat("path", F.slice("rest", 2, max_depth + 1))).alias("path")).filter("path is not null")
        if depth == max_depth or 0 in sizes or not met.isEmpty():
            break
        side = int(sizes[1] < sizes[0])
        levels[side].append(_beyond(links, levels[side][-1], sizes[side], levels[side], side == 0, sent))
        sizes[side] = levels[side][-1].count()
    return met.select(F.posexplode("path").alias("hop", "node"))


def path_edges(graph_edges: DataFrame, path: DataFrame) -> DataFrame:
    """All parallel edges of each hop."""
    order = Window.orderBy("hop")  # a path has few rows
    hops = path.select("hop", "node", F.lead("node").over(order).alias("next")).filter("next is not null")
    same = ((F.col("source") == F.col("node")) & (F.col("target") == F.col("next"))) | ((F.col("source") == F.col("next")) & (F.col("target") == F.col("node")))
    return F.broadcast(hops).join(graph_edges, same).select("hop", "edge_id", "relation")


def dangling(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    ends = graph_edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return ends.join(graph_nodes, "node_id", "left_anti")


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
