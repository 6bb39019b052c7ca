"""Invariants of a graph's tables, as rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.planner import MAX_LEVEL, IndexConfig
from .graph import entry_point


def violations(nodes: DataFrame, edges: DataFrame, codes: DataFrame, config: IndexConfig, tombstones: DataFrame | None = None, capacity: int | None = None) -> DataFrame:
    """(rule, id) of everything wrong; no rows for a valid graph.

    Every stored code has one node and every node a code; levels and layers are in range; a node
    has no more links on a layer than fit; links lead to other nodes of the same shard whose level
    reaches the layer; each shard has an entry; tombstones name inserted ids. Symmetry, repeats and
    reachability are not among the rules: links may well lead one way.
    """
    say = lambda df, rule, col="id": df.select(F.lit(rule).alias("rule"), F.col(col).cast("bigint").alias("id"))
    target = nodes.select(F.col("id").alias("dst"), F.col("shard").alias("t_shard"), F.col("level").alias("t_level"))
    source = nodes.select(F.col("id").alias("src"), F.col("level").alias("s_level"))
    linked = edges.join(target, "dst", "left").join(source, "src", "left")
    most = F.when(F.col("layer") == 0, 2 * config.m).otherwise(config.m)
    crowded = edges.groupBy("src", "layer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    entries = nodes.select("shard").distinct().join(entry_point(nodes), "shard", "left").where(F.col("id").isNull())
    found = [
        say(codes.select("id").join(nodes.select("id"), "id", "left_anti"), "code without node"),
        say(nodes.select("id").join(codes.select("id"), "id", "left_anti"), "node without code"),
        say(nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "node twice"),
        say(nodes.where((F.col("level") < 0) | (F.col("level") > MAX_LEVEL)), "level out of range"),
        say(crowded, "too many links", "src"),
        say(linked.where(F.col("src") == F.col("dst")), "link to itself", "src"),
        say(linked.where(F.col("t_level").isNull()), "link to no node", "src"),
        say(linked.where(F.col("t_shard") != F.col("shard")), "link to another shard", "src"),
        say(linked.where(F.col("t_level") < F.col("layer")), "link above the target's level", "src"),
        say(linked.where(F.col("s_level").isNull() | (F.col("s_level") < F.col("layer")) | (F.col("layer") < 0)), "link above its own level", "src"),
        say(entries, "shard without entry"),
    ]
    if capacity is not None:
        found.append(say(nodes.where((F.col("id") < 0) | (F.col("id") >= capacity)), "id out of range"))
    if tombstones is not None:
        found.append(say(tombstones.join(nodes.select("id"), "id", "left_anti"), "tombstone without node"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
