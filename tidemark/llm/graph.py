"""Connected components of an edge table: forests within partitions, then one task or star rounds.

Each task leaves a forest of its edges, so at most an edge for each of its nodes is left.  Up to
``ONE_TASK`` edges one task joins them, in a few numpy arrays.  Beyond, alternating large-star and
small-star rounds do: every round is two aggregations and two joins over the edges that are left, and a
checkpoint after each keeps lost executors cheap.  No node list, component or edge set ever goes
to the driver (which sees one count and one checksum a round): each round's jobs and plans stay in its
memory, so that few rounds matter there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .lookup import skew_join
from .scratch import cut

#: Edges that one task joins (some hundred bytes each there).
ONE_TASK = 2_000_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, ascending; least node of each one's component) of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, further := root[root]):
            root = further


def _forests(edges: DataFrame, roots: bool, most: int = ONE_TASK // 2) -> DataFrame:
    """(u, v) of edges (u, v): each partition's nodes u and the least node v that its edges lead to; with ``roots`` those of themselves too."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []

        def join() -> None:
            nodes, root = labelled(np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)]))
            a[:], b[:] = [nodes], [root]

        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            if len(a) > 1 and sum(map(len, a[1:])) > most:
                join()
        join()
        kept = slice(None) if roots else a[0] != b[0]
        u, v = a[0][kept], b[0][kept]
        for i in range(0, len(u), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 65_536]), pa.array(v[i : i + 65_536])], names=["u", "v"])

    return edges.mapInArrow(within, T._parse_datatype_string("u long, v long"))


def forest(edges: DataFrame) -> DataFrame:
    """(u, v): edges, written once, whose components are those of ``edges`` (two columns of longs); rows with a null end and loops are left out."""
    a, b = edges.columns
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    return cut(_forests(edges.filter(known).select(F.col(a).alias("u"), F.col(b).alias("v")), False))


def _hub(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the least v of each u."""
    return skew_join(edges, edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hub(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    hub = _hub(edges)
    moved = hub.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return edges.groupBy("u").agg(F.min("v").alias("v")).unionByName(moved).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    ``edges`` has two columns of longs; direction, repeats and loops don't
    matter, rows with a null end are left out.  No edges: an empty table.
    """
    links, seen = forest(edges), None
    if links.count() <= ONE_TASK:
        return cut(_forests(links.coalesce(1), True)).toDF("node", "root")
    links = cut(links.distinct())
    for _ in range(most_rounds):
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        links = cut(_small(_large(links)))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
