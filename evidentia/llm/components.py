"""Connected components over a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _shared


#: Up to so many links, 16 MB, one task joins them; more take steps over the whole cluster. The results are the same.
LOCAL_LINKS = 1_000_000


def _join_locally(batches):
    """Union-find over all links of one task, the root being the least node."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    src, dst = (np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    above = list(range(len(nodes)))

    def top(k):
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    for a, b in zip(at[: len(src)].tolist(), at[len(src) :].tolist(), strict=True):
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    roots = np.array([top(k) for k in range(len(nodes))], np.int64)
    moved = roots != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], ["node", "root"])


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


def components(links: DataFrame, *, local_links: int = LOCAL_LINKS) -> DataFrame:
    """node, root for every node of links (src long, dst long) other than the roots themselves; root is the least node that it reaches.

    Beyond local_links, alternating large-star and small-star steps move every
    node's links to the least neighbour, until nothing changes; their number
    grows with the logarithm of the longest chain. Tables of links are written
    to the shared folder after each step, so lineage stays short. Self links and repeated links count for nothing; no link gives
    an empty table; rows with a null end are ignored.
    """
    edges = links.select("src", "dst").where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    edges = _shared.materialize(edges, "links")
    if edges.count() <= local_links:
        return _shared.map_arrow(edges.coalesce(1), _join_locally, "node long, root long")
    edges = _shared.materialize(edges.distinct(), "links")
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large = _shared.materialize(large, "links-large")
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst"))).distinct()
        edges = _shared.materialize(small, "links-small")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
