"""Graphs over the pixels of pages, as tables: a page's pixels may lie in any number of tasks.

Pixels are first gathered into runs, maximal stretches of a row, which are few; runs that touch are edges, found through tiles of
columns so that no row's runs all meet. Components and minimum spanning forests contract those edges in rounds, each of which
is written to the checkpoint folder. A vertex is known by `at`, its first pixel in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.operators.rounds import cut

#: Columns of a tile, and rounds at most; each round at least halves what is left.
TILE, ROUNDS = 32, 64


def at(x: Column | str, y: Column | str) -> Column:
    """A pixel's place in reading order, whatever the page's width."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.shiftleft(y.cast("long"), 32) + x.cast("long")


def index(place: str) -> Column:
    """The index in an image of the given width of a pixel known by its place."""
    return F.shiftright(place, 32) * F.col("width") + F.col(place).bitwiseAND(F.lit((1 << 32) - 1))


def pixels(rasters: DataFrame, *more: str) -> DataFrame:
    """(page_id, x, y, g) and more columns of rasters (page_id, width, height, g)."""
    flat = rasters.select("page_id", F.col("width").alias("_w"), *more, F.posexplode("g").alias("i", "g"))
    return flat.select("page_id", *more, (F.col("i") % F.col("_w")).cast("long").alias("x"), F.expr("i div _w").alias("y"), "g")


def runs(found: DataFrame, *by: str, **sums: Column) -> DataFrame:
    """(page_id, *by, y, x0, x1, at) of pixels (page_id, x, y, *by): neighbours in a row with equal `by`; sums are aggregates."""
    place = W.partitionBy("page_id", "y", *by).orderBy("x")
    islands = found.withColumn("_k", F.col("x") - F.row_number().over(place)).groupBy("page_id", "y", *by, "_k")
    return islands.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), *[c.alias(n) for n, c in sums.items()]).drop("_k").withColumn("at", at("x0", "y"))


def gaps(found: DataFrame, pages: DataFrame) -> DataFrame:
    """The runs between runs (page_id, y, x0, x1), and of rows without any. pages: (page_id, width, height)."""
    rows = pages.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("y"), F.col("width").cast("long").alias("x0"), F.col("width").cast("long").alias("x1"))
    before = F.coalesce(F.lag("x1").over(W.partitionBy("page_id", "y").orderBy("x0")), F.lit(-1)) + 1
    between = found.select("page_id", "y", "x0", "x1").unionByName(rows).select("page_id", "y", before.alias("x0"), (F.col("x0") - 1).alias("x1"))
    return between.where("x0 <= x1").withColumn("at", at("x0", "y"))


def joined(found: DataFrame) -> DataFrame:
    """Runs (page_id, y, x0, x1) that follow each other without a gap become one."""
    row = W.partitionBy("page_id", "y").orderBy("x0")
    starts = found.withColumn("_new", F.coalesce(F.col("x0") > F.lag("x1").over(row) + 1, F.lit(True)).cast("int")).withColumn("_k", F.sum("_new").over(row))
    return starts.groupBy("page_id", "y", "_k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_k").withColumn("at", at("x0", "y"))


def touching(found: DataFrame, *by: str, diagonal: bool = False) -> DataFrame:
    """Pairs (page_id, *by, a, b) of runs in neighbouring rows that touch, a above b; both as structs (x0, x1, at)."""
    reach = int(diagonal)
    run = F.struct("x0", "x1", "at")
    tile = lambda lo, hi: F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE))).alias("tile")
    upper = found.select("page_id", *by, "y", run.alias("a"), tile(F.col("x0") - reach, F.col("x1") + reach))
    lower = found.select("page_id", *by, (F.col("y") - 1).alias("y"), run.alias("b"), tile(F.col("x0"), F.col("x1")))
    met = upper.join(lower, ["page_id", *by, "y", "tile"]).where((F.col("a.x0") <= F.col("b.x1") + reach) & (F.col("b.x0") <= F.col("a.x1") + reach))
    return met.select("page_id", *by, "a", "b").distinct()


def _shortened(pointers: DataFrame, by: list[str], times: int | None = None) -> DataFrame:
    """Pointers (u, to) that go twice as far each time; where nothing follows they stay. Without times: until all go to the end."""
    for _ in range(ROUNDS if times is None else times):
        on = pointers.select(*by, F.col("u").alias("to"), F.col("to").alias("_on"))
        pointers = pointers.join(on, [*by, "to"], "left").select(*by, "u", F.coalesce("_on", "to").alias("to"), (F.col("_on") != F.col("to")).alias("_far"))
        if times is None:
            pointers = cut(pointers)
            if pointers.where("_far").isEmpty():
                break
    return pointers.drop("_far")


def _onward(pointers: DataFrame, later: DataFrame, by: list[str]) -> DataFrame:
    """Pointers (u, to), led on by later ones where there are any."""
    on = later.select(*by, F.col("u").alias("to"), F.col("to").alias("_on"))
    return pointers.join(on, [*by, "to"], "left").select(*by, "u", F.coalesce("_on", "to").alias("to"))


def roots(edges: DataFrame, *by: str) -> DataFrame:
    """(*by, u, to): the smallest vertex that each vertex of edges (*by, u, v) is connected with. Loops and repeats are allowed.

    Each round every vertex points to the neighbour of the smallest hash (so that ways of pointers are short, however vertices are
    numbered), and edges are contracted to what their ends point to; what is connected never comes apart.
    """
    keys = list(by)
    left = cut(edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        both = left.union(left.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min(ranked("v")).alias("m")).select(*by, "u", F.least("m", ranked("u")).getField("v").alias("to"))
        to = cut(_shortened(cut(least), keys, 2))
        maps.append(to)
        ends = left.join(to, [*keys, "u"]).select(*by, "v", F.col("to").alias("_u")).join(to.withColumnRenamed("u", "v"), [*keys, "v"]).select(*by, "_u", F.col("to").alias("_v"))
        left = cut(ends.where("_u <> _v").select(*by, F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return left.select(*by, "u", F.col("v").alias("to"))
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        whole = _onward(earlier, whole, keys)
    return whole.join(whole.groupBy(*by, "to").agg(F.min("u").alias("_least")), [*keys, "to"]).select(*by, "u", F.col("_least").alias("to"))


def labelled(found: DataFrame, *by: str, diagonal: bool = False) -> DataFrame:
    """Runs with `root`, the first pixel of their component; only runs of equal `by` are connected."""
    found = cut(found)
    met = touching(found, *by, diagonal=diagonal).select("page_id", *by, F.col("a.at").alias("u"), F.col("b.at").alias("v"))
    known = roots(met, "page_id", *by).select("page_id", *by, F.col("u").alias("at"), F.col("to").alias("root"))
    return cut(found.join(known, ["page_id", *by, "at"], "left").withColumn("root", F.coalesce("root", "at")))


def grid_edges(found: DataFrame, weight: str) -> DataFrame:
    """(page_id, p, q, w) between pixels and those to their right and below: the larger weight of both."""
    here = found.select("page_id", "x", "y", F.col(weight).alias("a"))
    sides = [found.select("page_id", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col(weight).alias("b")).join(here, ["page_id", "x", "y"]).select("page_id", at("x", "y").alias("p"), at(F.col("x") + dx, F.col("y") + dy).alias("q"), F.greatest("a", "b").alias("w")) for dx, dy in ((1, 0), (0, 1))]
    return sides[0].union(sides[1])


def forest(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(page_id, at, seed): the seed that each vertex of edges (page_id, p, q, w) joins in the minimum spanning forest rooted in seeds
    (page_id, at, seed), those included: each tree has one seed. A vertex that no seed reaches has none.

    Boruvka's rounds: each tree without a seed takes its least edge, in the order of (w, p, q), so that no two are equal and the
    forest is one whatever the rounds. A tree with a seed takes none; it is named by -1 - seed.
    """
    by = ["page_id"]
    named = seeds.select("page_id", F.col("at").alias("u"), (-1 - F.col("seed")).alias("to"))
    first = lambda c: F.coalesce(F.col("to"), F.col(c)).alias(f"_{c}")
    start = edges.join(named.withColumnRenamed("u", "p"), ["page_id", "p"], "left").select("page_id", "p", "q", "w", first("p")).join(named.withColumnRenamed("u", "q"), ["page_id", "q"], "left")
    left = cut(start.select("page_id", "p", "q", "w", F.col("_p").alias("u"), F.coalesce("to", "q").alias("v")).where("u <> v"))
    maps = [cut(named)]
    for _ in range(ROUNDS):
        ways = left.select("page_id", "u", "v", "w", "p", "q").union(left.select("page_id", F.col("v").alias("u"), F.col("u").alias("v"), "w", "p", "q")).where("u >= 0")
        least = cut(ways.groupBy("page_id", "u").agg(F.min(F.struct("w", "p", "q", "v")).getField("v").alias("to")))
        if least.isEmpty():
            break
        # Two trees that take the same edge point at each other: the smaller one stays.
        back = least.select("page_id", F.col("u").alias("to"), F.col("to").alias("_back"))
        least = cut(least.join(back, ["page_id", "to"], "left").where("_back IS NULL OR _back <> u OR u > to").select("page_id", "u", "to"))
        maps.append(_shortened(least, by))
        to = maps[-1]
        ends = left.join(to, ["page_id", "u"], "left").select("page_id", "p", "q", "w", "v", first("u")).join(to.withColumnRenamed("u", "v"), ["page_id", "v"], "left").select("page_id", "p", "q", "w", "_u", first("v"))
        left = cut(ends.where("_u <> _v").select("page_id", "p", "q", "w", F.col("_u").alias("u"), F.col("_v").alias("v")))
    else:
        raise RuntimeError("the forest did not settle")
    # A tree takes an edge once, in any round; what it became part of may take one later.
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        whole = _onward(earlier, whole, by).union(whole)
    return whole.select("page_id", F.col("u").alias("at"), F.when(F.col("to") < 0, -1 - F.col("to")).alias("seed"))
