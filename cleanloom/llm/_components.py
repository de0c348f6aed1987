"""Connected components of a link table: by one task where the links are few, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm._common import cut, shipped

shipped(__name__)

#: Distinct links that one task holds at most, some 100 bytes each; more of them go through the steps.
HELD = 1 << 19


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all links (u, v): roots go below the least root that they link with, until no link joins two trees."""
    ends = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    ids, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(u for u, _ in ends), *(v for _, v in ends)]), return_inverse=True)
    a, b = place[: len(place) // 2], place[len(place) // 2 :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    yield pa.record_batch({"id": pa.array(ids, pa.int64()), "component": pa.array(ids[root], pa.int64())})


def _steps(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; an edge (u, v) has u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    large = large.where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_steps: int = 64) -> DataFrame:
    """(id, component) for every id that occurs in links (a, b); the component is its smallest id.

    Up to HELD distinct links are settled by one task. Of more, every step is a bounded number of shuffles over the links;
    each key's minimum is combined before the shuffle. Steps go on until the links stay the same, a logarithmic number of them
    as a rule. Null ends and loops are left out; an empty table gives an empty one.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    edges = cut(edges.distinct())
    seen = None
    for _ in range(max_steps):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        if seen is None and now[0] <= HELD:
            return cut(edges.coalesce(1).mapInArrow(_held, "id long, component long"))
        seen, edges = now, cut(_steps(edges))
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
