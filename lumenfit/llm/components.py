"""Connected components of an edge table, by alternating large and small stars.

No node's neighbours are gathered: minima are aggregated, then joined back, so
a hub is a skewed join key that adaptive execution splits.  Each round is a
written table.  An edge table that is small for one task, counted first, takes
no rounds: a task joins its nodes, with the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfit.llm import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).distinct()
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, and the least node of each one's component."""
    nodes, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = number[: len(u)], number[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        one, two = label[a], label[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _in_a_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if both:
            nodes, label = least_nodes(*(np.concatenate(x) for x in zip(*both, strict=True)))
            for at in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(label[at : at + (1 << 16)])], ["node", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, label long")


def components(edges: DataFrame, rounds: int = 60, task_edges: int = 1 << 19) -> DataFrame:
    """node, label (the least node of its component) of all nodes of edges (u, v long); loops and repeats do no harm.

    Rounds are at most of the order of the logarithm of the nodes' number; not
    to have ended after ``rounds`` of them is an error.  At most ``task_edges``
    edges, counted first, are joined in one task instead (about 100 bytes each).
    """
    now = common.stash(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.count() <= task_edges:
        out = common.stash(_in_a_task(now), "labels")
        common.discard(now)
        return out
    before = None
    for _ in range(rounds):
        was, now = now, common.stash(_small(_large(now)), "edges")
        common.discard(was)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return labels.union(now.select("v", "v").distinct())
        before = mark
    raise RuntimeError(f"components haven't settled after {rounds} rounds")
