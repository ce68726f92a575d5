"""Library of an item: the nearest library root above it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.model import LIBRARY_NODE_TYPES
from rimlight.session import checkpointed


def library_of_item(tree: DataFrame) -> DataFrame:
    """``(item_id, library_id)``: the root above each item, else its own parent id, else null.

    Only nodes that have children take part in the pointer jumping, so the many leaves are
    joined once. Chains halve in length with every round; a round's result is checkpointed.
    Chains that break or run in circles have no root.
    """
    is_root = F.col("node_type").isin(*LIBRARY_NODE_TYPES)
    parents = tree.select(F.col("parent_id").alias("item_id")).where("item_id is not null").distinct()
    nodes = checkpointed(
        tree.join(parents, "item_id", "left_semi").select(
            "item_id",
            F.when(is_root, F.col("item_id")).alias("root"),
            F.when(~is_root, F.col("parent_id")).alias("up")))
    rounds = math.ceil(math.log2(max(nodes.count(), 2))) + 1
    done = nodes.where("up is null")
    for _ in range(rounds):
        # only open nodes are joined; a node that has its root, or has lost its chain, rests in ``done``
        open_ = nodes.where("up is not null")
        if open_.isEmpty():
            break
        above = nodes.unionByName(done).select(
            F.col("item_id").alias("up"), F.col("root").alias("_root"), F.col("up").alias("_up")).dropDuplicates(["up"])
        nodes = checkpointed(open_.join(above, "up", "left").select(
            "item_id", F.col("_root").alias("root"), F.when(F.col("_root").isNull(), F.col("_up")).alias("up")))
        done = done.unionByName(nodes.where("up is null"))
    roots = done.where("root is not null").select(F.col("item_id").alias("parent_id"), "root")
    return tree.join(roots, "parent_id", "left").select(
        "item_id",
        F.when(is_root, F.col("item_id")).otherwise(F.coalesce("root", "parent_id")).alias("library_id"))
