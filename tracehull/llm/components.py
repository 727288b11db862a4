"""Connected components of a distributed edge list: in one task what fits a task's chunk, else by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, map_arrow, materialize

#: Edges that a task contracts at a time, so that its memory is bounded.
CHUNK = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = down.join(least, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """Edges to the least node of each component of the edges ``u``, ``v``: a forest that connects the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(u, v, strict=True):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    lower = [(x, r) for x in parent if (r := root(x)) != x]
    return [x for x, _ in lower], [r for _, r in lower]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task as stars, at most ``CHUNK`` and a batch at a time."""
    u: list[int] = []
    v: list[int] = []
    for batch in batches:
        u += batch.column(0).to_pylist()
        v += batch.column(1).to_pylist()
        if len(u) >= CHUNK:
            u, v = _stars(u, v)
            if 2 * len(u) > CHUNK:  # else there is room for more edges
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
    u, v = _stars(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _contract(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same nodes; no node's least neighbour grows, so settled edges stay as they are."""
    return map_arrow(edges.select("u", "v"), _contracted, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for nodes of ``edges`` (u, v: long); the component is its least node.

    Each round is written to the shared folder, so no lineage grows and a lost executor
    costs one round; it is deleted when the next one is written. Each task contracts the
    edges it holds; as soon as no more than ``CHUNK`` are left, one task contracts them
    all, which settles them. While there are more, stars shrink the longest path by a
    constant factor a round; edges are settled when a round leaves them all as they are.
    ``discard`` deletes the result's table.
    """
    edges = materialize(_contract(edges.where("u <> v")), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds if mark[0] else 0):
        before, fits = edges, mark[0] <= CHUNK
        edges = materialize(_contract(edges.coalesce(1) if fits else _small_star(_large_star(edges))), "edges")
        discard(before)
        if fits:
            break
        last, mark = mark, _mark(edges)
        if last == mark:
            break
    else:
        if mark[0]:
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out.written_at = edges.written_at
    return out


def _mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
