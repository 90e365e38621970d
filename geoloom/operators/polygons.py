"""Polygons as tables of ring edges: containment, intersection, union and simplification, met through grid cells.

Edges are (ring, x0, y0, x1, y1) in whole numbers; a ring's interior is where a ray crosses its edges an odd number of times.
A cell that no edge passes through lies inside or outside as a whole, which its centre decides once for all its points;
only points in cells on a ring's border meet the ring's edges, and of these only those in their own band of cells.
Rings meet rings as wholes, block by block within tiles of 16 x 16 cells: pairs of edges are never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.operators import rings
from geoloom.sources.written import removed, written

BLOCK = 1 << 18  # weight of a block of rings that are compared with another: their edges, and RING for each
RING = 48  # what a ring weighs besides its edges: the cells that are drawn of it
TASKS = 4096  # tasks that the groups of blocks are dealt to, at most


def _cell(x: Column, size: int) -> Column:
    return F.floor(x / size).cast("int")


def edges_of(vertices: DataFrame) -> DataFrame:
    """Edges of closed rings from vertices (ring, k, x, y), in the order of k; the last leads to the first."""
    own = W.partitionBy("ring").orderBy("k")
    first = W.partitionBy("ring").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = lambda c: F.coalesce(F.lead(c).over(own), F.first(c).over(first)).alias(f"{c}1")
    return vertices.select("ring", F.col("x").alias("x0"), F.col("y").alias("y0"), after("x"), after("y"))


def _banded(edges: DataFrame, size: int) -> DataFrame:
    """Edges with each band gy that they touch."""
    low, high = _cell(F.least("y0", "y1"), size), _cell(F.greatest("y0", "y1"), size)
    return edges.select("*", F.explode(F.sequence(low, high)).alias("gy"))


def edge_cells(edges: DataFrame, size: int) -> DataFrame:
    """Edges with each cell (gx, gy) that they may touch: those of the part of the edge that is in the band, and a unit more."""
    bottom, top = F.col("gy") * size, (F.col("gy") + 1) * size
    along = lambda y: F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    held = lambda y: F.least(F.greatest(along(F.least(F.greatest(y, F.least("y0", "y1")), F.greatest("y0", "y1"))), low), high)
    flat = F.col("y0") == F.col("y1")
    left = F.when(flat, low).otherwise(F.least(held(bottom), held(top))) - 1
    right = F.when(flat, high).otherwise(F.greatest(held(bottom), held(top))) + 1
    return _banded(edges, size).select("*", F.explode(F.sequence(_cell(left, size), _cell(right, size))).alias("gx"))


def crosses(x: Column, y: Column) -> Column:
    """Whether the ray from (x, y) to the right crosses the edge; exact in whole numbers, an end counts for the lower edge only."""
    across = (F.col("y0") > y) != (F.col("y1") > y)
    side = (x - F.col("x0")) * (F.col("y1") - F.col("y0")) - (y - F.col("y0")) * (F.col("x1") - F.col("x0"))
    return across & F.when(F.col("y1") > F.col("y0"), side < 0).otherwise(side > 0)


def inside(points: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """id, ring: points (id, x, y) with each ring that holds them, a row for each row of points. size: the side of a cell, an even number."""
    bands = written(_banded(edges, size), "ring-bands")
    border = written(edge_cells(edges, size).select("ring", "gx", "gy").distinct(), "ring-cells")
    span = border.groupBy("ring", "gy").agg(F.min("gx").alias("low"), F.max("gx").alias("high"))
    clear = span.select("ring", "gy", F.explode(F.sequence("low", "high")).alias("gx")).join(border.hint("merge"), ["ring", "gx", "gy"], "left_anti")
    centre = lambda g: F.col(g) * size + size // 2
    odd = lambda x, y: (F.sum(crosses(x, y).cast("int")) % 2 == 1).alias("held")
    full = written(clear.join(bands.hint("merge"), ["ring", "gy"]).groupBy("ring", "gx", "gy").agg(odd(centre("gx"), centre("gy"))).where("held").select("ring", "gx", "gy"), "full-cells")
    # Places are judged, not points: equal places are one. Files of cells are far smaller than their rows, hence no broadcasts.
    placed = points.select("x", "y").distinct().select("x", "y", _cell(F.col("x"), size).alias("gx"), _cell(F.col("y"), size).alias("gy"))
    near = placed.join(border.hint("merge"), ["gx", "gy"]).select("x", "y", "ring", "gy").join(bands.hint("merge"), ["ring", "gy"])
    met = near.groupBy("x", "y", "ring").agg(odd(F.col("x"), F.col("y"))).where("held").select("x", "y", "ring")
    held = placed.join(full.hint("merge"), ["gx", "gy"]).select("x", "y", "ring").unionByName(met)
    return points.select("id", "x", "y").join(held.hint("merge"), ["x", "y"]).select("id", "ring")


def _shapes(edges: DataFrame) -> DataFrame:
    """A row for each ring: lists x0, y0, x1, y1 of its own edges, and its box."""
    ends = ("x0", "y0", "x1", "y1")
    whole = edges.dropna(subset=["ring", *ends]).select("ring", *[F.col(c).cast("long").alias(c) for c in ends])
    least = lambda c: F.min(F.least(f"{c}0", f"{c}1")).alias(f"{c}a")
    most = lambda c: F.max(F.greatest(f"{c}0", f"{c}1")).alias(f"{c}b")
    rows = whole.groupBy("ring").agg(F.collect_list(F.struct(*ends)).alias("e"), least("x"), least("y"), most("x"), most("y"))
    return written(rows.select("ring", *[F.col(f"e.{c}").alias(c) for c in ends], "xa", "ya", "xb", "yb"), "rings")


def _meeting(shapes: DataFrame, others: DataFrame | None, size: int) -> DataFrame:
    """ring, other: pairs that meet, each once; without others, pairs of two rings of one table, in either order.

    Rings lie in all tiles that their boxes touch, and a pair is judged in the tile where the boxes' common part begins, so no
    pair is found twice and none is shuffled. A tile's rings are dealt to blocks of bounded size; each two blocks are a group.
    """
    tile, once = rings.CELLS // 2 * size, others is None
    number = lambda c: F.explode(F.sequence(_cell(F.col(f"{c}a"), tile), _cell(F.col(f"{c}b"), tile))).alias(f"t{c}")
    tiled = lambda df: df.select("*", number("x")).select("*", number("y"))
    parts = lambda df, name: tiled(df).groupBy("tx", "ty").agg(F.ceil(F.sum(F.size("x0") + RING) / BLOCK).cast("int").alias(name))
    tiles = parts(shapes, "m").withColumn("n", F.col("m")) if once else parts(shapes, "m").join(parts(others, "n").hint("merge"), ["tx", "ty"])
    tiles = written(tiles, "ring-tiles")
    groups = tiles.agg(F.sum(F.col("m") * (F.col("m") + 1) / 2 if once else F.col("m") * F.col("n"))).first()[0] or 1
    own = lambda n: F.pmod(F.xxhash64("ring"), F.col(n)).cast("int")
    each = lambda low, high: F.explode(F.sequence(low, high))
    dealt = lambda df, n: tiled(df).join(tiles.hint("merge"), ["tx", "ty"]).withColumn("own", own(n)).drop("xa", "ya", "xb", "yb")
    left = dealt(shapes, "m").withColumnRenamed("own", "i").withColumn("j", each(F.col("i") if once else F.lit(0), F.col("n") - 1))
    right = dealt(shapes if once else others, "n").withColumnRenamed("own", "j").withColumn("i", each(F.lit(0), F.col("j") if once else F.col("m") - 1))
    right = right.withColumnsRenamed({"ring": "other", "x0": "u0", "y0": "v0", "x1": "u1", "y1": "v1"})
    by = ["tx", "ty", "i", "j"]
    grouped = lambda df, *names: df.select(*by, *names).repartition(int(min(2 * groups, TASKS)), *by).groupBy(*by)
    met = rings.meeting(tile, once)
    kinds = f"ring {left.schema['ring'].dataType.simpleString()}, other {right.schema['other'].dataType.simpleString()}"
    return grouped(left, "ring", "x0", "y0", "x1", "y1").cogroup(grouped(right, "other", "u0", "v0", "u1", "v1")).applyInArrow(met, kinds)


def intersecting(edges: DataFrame, others: DataFrame, size: int) -> DataFrame:
    """ring, other: pairs whose edges touch or of which one holds the other; both sides are edges (ring, x0, y0, x1, y1)."""
    return _meeting(_shapes(edges), _shapes(others), size)


def intersecting_pairs(edges: DataFrame, size: int) -> DataFrame:
    """ring, other: the pairs of two rings of one table that `intersecting` finds, each once, in either order."""
    return _meeting(_shapes(edges), None, size)


def union_edges(edges: DataFrame, group: str) -> DataFrame:
    """The edges of the union of each group's rings that share whole edges: an edge and its reverse cancel."""
    turned = (F.col("x0") > F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") > F.col("y1")))
    low = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    each = edges.select(group, low("x0", "x1").alias("x0"), low("y0", "y1").alias("y0"), low("x1", "x0").alias("x1"), low("y1", "y0").alias("y1"), F.when(turned, -1).otherwise(1).alias("n"))
    left = each.groupBy(group, "x0", "y0", "x1", "y1").agg(F.sum("n").alias("n")).where("n <> 0")
    back = F.col("n") < 0
    end = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    return left.select(group, end("x0", "x1").alias("x0"), end("y0", "y1").alias("y0"), end("x1", "x0").alias("x1"), end("y1", "y0").alias("y1"))


def area(edges: DataFrame, group: str) -> DataFrame:
    """group, area (counter-clockwise positive), perimeter of closed sets of edges."""
    twice = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0"))
    length = F.sum(F.hypot((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")))
    return edges.groupBy(group).agg((twice / 2).alias("area"), length.alias("perimeter"))


def off_segment(x: Column, y: Column) -> Column:
    """The squared distance of (x, y) to the segment from (ax, ay) to (bx, by)."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    long = dx * dx + dy * dy
    t = F.when(long == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((x - F.col("ax")) * dx + (y - F.col("ay")) * dy) / long, F.lit(0.0)), F.lit(1.0)))
    ex, ey = F.col("ax") + t * dx - x, F.col("ay") + t * dy - y
    return ex * ex + ey * ey


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """The vertices (ring, k, x, y; k from 1) that Douglas and Peucker's method keeps within the tolerance; the first always stays.

    A round splits every open stretch of every ring at its farthest vertex (ties: the first), so there are as many
    rounds as the deepest chain of splits; what is decided leaves, and each round is written.
    """
    spark = vertices.sparkSession
    first = vertices.where("k = 1").select("ring", F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"))
    size = vertices.groupBy("ring").agg((F.max("k") + 1).alias("hi"))
    open_ = vertices.where("k > 1").select("ring", "k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    open_ = open_.join(first, "ring").join(size, "ring").select("*", F.lit(1).alias("lo"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    now, kept = written(open_, "simplify"), [vertices.where("k = 1").select("ring", "k")]
    while not now.isEmpty():
        far = now.withColumn("d", off_segment(F.col("x"), F.col("y"))).groupBy("ring", "lo", "hi").agg(F.max(F.struct("d", (-F.col("k")).alias("k"), "x", "y")).alias("f")).where(F.col("f.d") > tolerance * tolerance)
        far = written(far.select("ring", "lo", "hi", (-F.col("f.k")).alias("at"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy")), "simplify-splits")
        kept.append(far.select("ring", F.col("at").alias("k")))
        below = F.col("k") < F.col("at")
        side = lambda a, b: F.when(below, F.col(a)).otherwise(F.col(b))
        split = now.join(far, ["ring", "lo", "hi"]).where("k <> at")
        after = split.select("ring", "k", "x", "y", side("ax", "fx").alias("ax"), side("ay", "fy").alias("ay"), side("at", "hi").alias("hi"), side("lo", "at").alias("lo"), side("fx", "bx").alias("bx"), side("fy", "by").alias("by"))
        after = written(after, "simplify")
        removed(spark, now)
        now = after
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return vertices.join(out, ["ring", "k"], "left_semi")
