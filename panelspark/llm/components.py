"""Connected components by alternating large-star and small-star steps, all in DataFrames.

A graph of at most ONE_TASK links goes to a single task, which takes them one after the other; beyond that bound, which
is checked, no task holds more than its share of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _settled(forward: DataFrame) -> bool:
    """Whether every node has one link at most to a smaller node, and no such smaller node has one itself."""
    row = forward.agg(F.count("*").alias("n"), F.count_distinct("b").alias("leaves")).first()
    return row["n"] == row["leaves"] and forward.select(F.col("a").alias("b")).join(forward, "b", "left_semi").isEmpty()


#: Links that one task may hold: some tens of megabytes.
ONE_TASK = 500_000


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)  # the roots, so that whole trees are moved
        np.minimum.at(label, label[y], least)
        label = label[label]
        if (label == before).all() and (label[x] == label[y]).all():
            return nodes, nodes[label]


def _in_one_task(forward: DataFrame) -> DataFrame:
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, roots = rooted(every["a"].to_numpy(), every["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])

    return forward.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).repartition(1).mapInArrow(taken, "node long, component long")


def connected_components(edges: DataFrame, most_rounds: int = 40, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of edges (a, b), which are whole numbers; component is the smallest node reachable.

    Edges are counted first, so they should be a stored table. Rounds grow with the logarithm of their number; each is a
    table in the shared folder.
    """
    forward = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    if forward.count() <= one_task:
        return _in_one_task(forward)
    forward = stored(forward.distinct(), "edges")
    for step in range(most_rounds):
        if _settled(forward):
            break
        # Large star: each node links its larger neighbours to the smallest node around it.
        both = forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stored(least, f"least{step}")
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b")
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        large = stored(large.distinct(), f"large{step}")
        low = stored(large.groupBy("b").agg(F.min("a").alias("m")), f"low{step}")
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x < y")
        before, forward = forward, stored(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"small{step}")
        discard(before, least, large, low)
    else:
        raise RuntimeError("components did not settle")
    return forward.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(forward.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
