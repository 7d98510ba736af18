"""Nested component trees as rows: a node a row, with a path key whose order is the pre-order of the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

NODE = "struct<depth:int,name:string,node_type:string>"


def flatten(trees: DataFrame, key: str, tree: str, children: str = "children") -> DataFrame:
    """key, path, depth, name, node_type: every node of the JSON trees in column `tree`, to any depth.

    path holds the place of each ancestor among its siblings, the root's being empty; paths sort in pre-order. One round a level:
    a round explodes the children of the last one's nodes, so that a broad tree spreads over tasks, and is written to the shared
    folder. Text that is no JSON object gives no rows; children that aren't a list are none, and a child that is no object is
    a node without a name. A null key stays null; rows that repeat a key each have their nodes.
    """
    node = F.col("node")
    root = trees.select(F.col(key).alias("key"), F.expr("CAST(array() AS ARRAY<INT>)").alias("path"), F.try_parse_json(tree).alias("node"))
    level = stored(root.where(F.schema_of_variant(node).startswith("OBJECT")), "tree")
    found = level
    while True:
        below = level.select("key", "path", F.posexplode(F.try_variant_get(node, f"$.{children}", "array<variant>")).alias("place", "node"))
        level = stored(below.select("key", F.concat("path", F.array("place")).alias("path"), "node"), "tree")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    text = lambda name: F.try_variant_get(node, f"$.{name}", "string").alias(name)
    return found.select(F.col("key").alias(key), "path", F.size("path").alias("depth"), text("name"), text("node_type"))


def listed(nodes: DataFrame, key: str) -> DataFrame:
    """key, tree: each tree's nodes (depth, name, node_type) as one array in pre-order, as rules read them."""
    row = F.struct("path", F.struct("depth", "name", "node_type").alias("of"))
    return nodes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["of"]).alias("tree"))


def with_trees(governed: DataFrame, trees: DataFrame, key: str = "model_hash", tree: str = "tree") -> DataFrame:
    """Governance rows with the nodes of their nested trees in place of the column `tree`; without a tree it is empty."""
    nodes = listed(flatten(trees, key, tree), key).withColumnRenamed("tree", "__tree")
    return governed.drop("tree").join(nodes, key, "left").withColumn("tree", F.coalesce("__tree", F.expr(f"CAST(array() AS ARRAY<{NODE}>)"))).drop("__tree")
