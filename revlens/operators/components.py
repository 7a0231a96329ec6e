"""Connected components by alternating star contraction (large star, small star) on an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.plans.durable import written

#: Edges between longs up to which the driver links the rest in one pass: at most 2 MB, where rounds cost a dozen jobs.
FEW = 1 << 17


def _minima(pairs: DataFrame) -> DataFrame:
    """m: the least of each node's neighbours and itself; a partial aggregation, so a hub is no hot task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("of", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return both.join(_minima(both), F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low.withColumnRenamed("u", "of"), F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _linked(edges: DataFrame) -> DataFrame:
    """`components` of few edges between longs."""
    table = edges.toArrow()
    names, at = np.unique(np.concatenate([np.asarray(table.column(c)).astype(np.int64) for c in ("u", "v")]), return_inverse=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in at.reshape(2, -1).T.tolist():
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)  # names are sorted: a root is its tree's least node
    roots = names[[root(i) for i in range(len(names))]]
    return written(edges.sparkSession.createDataFrame(pa.table({"node": names, "root": roots})))


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of `edges` (columns u, v; any order, repeats and loops allowed) with its component's least node.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the number of nodes.
    Once FEW edges are left, they are linked at once.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # the same edges twice in a row: only stars around the least nodes are left
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not seen[0] or seen == state:
            break
        if seen[0] <= FEW and dict(now.dtypes) == {"u": "bigint", "v": "bigint"}:
            return _linked(now)
        state = seen
        now = written(_small_star(_large_star(now).where("u <> v").distinct()))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
