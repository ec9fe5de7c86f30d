"""Connected components of a distributed edge list, each named by its smallest vertex."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds at most; each halves the longest path at least, so this covers any graph that fits on disk.
MAX_ROUNDS = 64
#: Edges that a task joins up at a time, and for which a graph gets a partition: a small one is no work for a task of each of many.
CHUNK = 50_000


def forest(left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    """The same connections as one edge from every vertex to the smallest that it reaches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in zip(left, right, strict=True):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = [(x, find(x)) for x in root]
    return [x for x, top in found if x != top], [top for x, top in found if x != top]


def _forests(edges: DataFrame) -> DataFrame:
    """The same connections as edges (u, v), u > v: each task's edges as a forest, CHUNK of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, pa.int64()) for x in (left, right)], names=["u", "v"])

        for batch in batches:
            left += batch.column(0).to_pylist()
            right += batch.column(1).to_pylist()
            if len(left) >= CHUNK:
                left, right = forest(left, right)
                if len(left) > CHUNK // 2:
                    yield made()
                    left, right = [], []
        left, right = forest(left, right)
        yield made()

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges (u, v), u > v: link each neighbour to the smallest of the neighbourhood.

    small: only a vertex's smaller neighbours move, and the vertex itself; else only its larger ones.
    Neighbourhoods are never gathered: the minimum is a partial aggregate, and edges join it by vertex.
    """
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    # u > v in every edge, so the larger neighbours of a vertex are the u of the edges in which it is v.
    larger = edges.select(F.col("v").alias("w"), F.col("u").alias("n")).join(least.withColumnRenamed("u", "w"), "w")
    return larger.select(F.col("n").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (u, v) there are, and whether they are stars: each u has one edge, and no u is a v."""
    ends = edges.selectExpr("inline(array(struct(u AS x, 1 AS up), struct(v AS x, 0 AS up)))")
    each = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    made = each.agg(F.sum("ups"), F.max((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0))).first()
    return made[0] or 0, not made[1]


def components(edges: DataFrame) -> DataFrame:
    """Return (vertex, root) for every vertex of edges (u, v) but the roots themselves.

    Every task first joins up the edges that it has; then large and small star rounds alternate until the edges are stars.
    Loops, repeats, null ends and either direction are allowed. Every round is written to the checkpoint folder, in as many
    partitions as its edges ask for.
    """
    now = cut(_forests(edges.where("u <> v")))
    size = now.count()
    for k in range(MAX_ROUNDS + 1):
        # The first time, the tasks' own edges in fewer tasks.
        moved = _star(_star(now, small=False), small=True) if k else now
        now = cut(_forests(moved.coalesce(max(1, -(-size // CHUNK)))))
        size, stars = _state(now)
        if stars:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
