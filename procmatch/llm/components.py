"""Connected components by alternating large-star and small-star steps; every step is a join and a partial aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import join_spread, stored

MAX_STEPS = 60


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of edges: every node with the smallest one that the batch's edges join it to. Saves steps, as a partial aggregation saves rows."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:
            was = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            low = low[low]
            if (low == was).all():
                break
        own = np.flatnonzero(low != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[low[own]])], names=["a", "b"])


def _settled(now: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself."""
    sides = now.select(F.col("a").alias("u"), F.lit(1).alias("down")).unionByName(now.select(F.col("b").alias("u"), F.lit(0).alias("down")))
    return not sides.groupBy("u").agg(F.sum("down").alias("d"), F.min("down").alias("top")).where("d > 1 or d = 1 and top = 0").take(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of the edges ``(a, b)`` of longs; the component is its smallest node.

    Each step links every node to the smallest one nearby, first over larger and then over smaller neighbours, until
    only stars are left, after a number of steps about the logarithm of the longest path. No task holds a node's neighbours:
    their smallest is an aggregate, joined back; where a node has very many, their rows stay in the tasks where they are.
    """
    start = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    now = stored(start.mapInArrow(_contracted, "a long, b long").distinct(), "edges")
    for _ in range(MAX_STEPS):
        if _settled(now):
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        down, up = now.select(F.col("a").alias("u"), F.col("b").alias("v")), now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.unionByName(up).groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = stored(join_spread(up, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stored(small.mapInArrow(_contracted, "a long, b long").distinct(), "edges")
    raise RuntimeError("the components didn't settle")
