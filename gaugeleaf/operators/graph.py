"""Curriculum trees and prerequisite graphs."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import staged


def climbed(nodes: DataFrame, label: str) -> DataFrame:
    """node_id, top (the node without a parent above it), path of labels from there, and stray: its line ends at a parent that is not there.

    Every node holds an ancestor and the path to it, and takes over its ancestor's in each round: the rounds are
    the logarithm of the depth, which may be any.  Nodes that still have an ancestor when more steps are made than
    there are nodes are on a cycle, or below one: an error.
    """
    rows = nodes.select("node_id", F.col("parent_id").alias("up"), F.col("node_id").alias("top"), F.col(label).cast("string").alias("path"), F.lit(False).alias("stray"))
    rows, steps = staged(rows, "climbing"), 1
    while not rows.where("up is not null").isEmpty():
        if steps > 1 and steps > 2 * rows.count():
            raise ValueError("the parents have a cycle")
        above = rows.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("top").alias("above_top"), F.col("path").alias("above"), F.col("stray").alias("above_stray"), F.lit(True).alias("there"))
        joined = rows.join(above, "up", "left")
        stray = F.col("stray") | F.coalesce("above_stray", F.lit(False)) | (F.col("up").isNotNull() & F.col("there").isNull())
        rows = staged(joined.select("node_id", F.col("next").alias("up"), F.coalesce("above_top", "top").alias("top"), F.concat_ws("/", "above", "path").alias("path"), stray.alias("stray")), "climbing")
        steps *= 2
    return rows.drop("up")


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """node_id of root and its descendants, of any depth; a root among its own descendants is an error."""
    cut = nodes.select("node_id", F.when(F.col("node_id") != root, F.col("parent_id")).alias("parent_id"))
    found = climbed(cut, "node_id").where((F.col("top") == root) & ~F.col("stray")).select("node_id")
    own = nodes.where((F.col("node_id") == root) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("node_id"))
    if not own.join(found, "node_id", "left_semi").isEmpty():
        raise ValueError("the parents have a cycle")
    return found


def paths(nodes: DataFrame) -> DataFrame:
    """node_id, level and the path of labels from the top, of any depth; nodes below a parent that is not there have none."""
    return climbed(nodes, "label").where("not stray").select("node_id", "path").join(nodes.select("node_id", "level"), "node_id").select("node_id", "level", "path")


def layers(edges: DataFrame) -> DataFrame:
    """Longest-path layer of each node of an acyclic edge table (from_node, to_node); sources have 0.  A cycle is an error."""
    nodes = edges.select(F.col("from_node").alias("node")).union(edges.select("to_node")).distinct()
    out = nodes.withColumn("layer", F.lit(0))
    reached, depth = nodes, 0
    while True:
        reached = edges.join(reached.select(F.col("node").alias("from_node")), "from_node", "left_semi").select(F.col("to_node").alias("node")).distinct().persist()
        if reached.isEmpty():
            return out.groupBy("node").agg(F.max("layer").alias("layer"))
        depth += 1
        if depth % 32 == 0 and depth >= nodes.count():
            raise ValueError("the edges have a cycle")
        out = out.union(reached.withColumn("layer", F.lit(depth)))


def weakness_roots(accuracy: DataFrame, edges: DataFrame, key: str, weak_below: float = 50.0) -> DataFrame:
    """Where each student's weakness starts: from every weak node back through prerequisites that are weak or untested.

    A node reached, weak or untested, is a root when it has no such prerequisite.  Edges go from from_node
    (earlier) to to_node.  All students climb together, a level a round; the rounds are the curriculum's depth.
    """
    accuracy = staged(accuracy.select(key, "node", "accuracy"), "accuracy")
    known = accuracy.select(key, F.col("node").alias("from_node"), "accuracy")
    edges = staged(edges.select("from_node", "to_node"), "prerequisites")
    weak = accuracy.where(F.col("accuracy") < weak_below).select(key, "node").distinct()
    fresh, steps, most = weak, [], edges.count() + 1
    while True:
        climbed = fresh.withColumnRenamed("node", "to_node").join(edges, "to_node").join(known, [key, "from_node"], "left")
        taken = staged(climbed.where(F.coalesce("accuracy", F.lit(-1.0)) < weak_below).select(key, "to_node", "from_node"), "steps")
        if taken.isEmpty():
            break
        steps.append(taken)
        if len(steps) > most:
            raise ValueError("the prerequisites have a cycle")
        fresh = taken.select(key, F.col("from_node").alias("node")).distinct()
    if not steps:
        return weak.select(key, F.col("node").alias("root"))
    taken = functools.reduce(DataFrame.union, steps)
    reached = weak.union(taken.select(key, "from_node")).distinct()
    return reached.join(taken.select(key, F.col("to_node").alias("node")), [key, "node"], "left_anti").select(key, F.col("node").alias("root"))
