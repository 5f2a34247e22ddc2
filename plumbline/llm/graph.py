"""Connected components of an edge table by alternating stars; nothing of the graph reaches the driver.

Each round links every node's larger neighbours to its smallest one (large star), then every node and its smaller
neighbours to the smallest (small star). A star forest is the fixed point. Rounds are written to the shared folder, so a
lost executor costs one round at most. Minima are pre-aggregated, and the joins on a node have no bound operator above
them, so Spark may split a hot node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that a task contracts at once before they are shuffled.
CHUNK = 1 << 17


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the given edges, each with the smallest end that it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), CHUNK):
            part = pdf.iloc[i : i + CHUNK]
            node, root = roots(part["a"].to_numpy(), part["b"].to_numpy())
            other = node != root
            yield pd.DataFrame({"a": node[other], "b": root[other]})


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every end of an edge (a, b); ids are longs.

    Loops, repeated edges and either direction are fine; an empty table gives an empty one. Nodes without an edge to
    another node are left out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = written(e.mapInPandas(contracted, "a long, b long").distinct(), "components")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(low, "a")
        small = stars.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = written(small, "components")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
