"""Neighbourhood operators on sparse rasters (obs, r, c, v): neighbours by equi-joins on computed places, never by range."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.written import removed, written


def around(df: DataFrame, offsets: list[tuple[int, int, float]], size: int | None = None) -> DataFrame:
    """One row for each cell and neighbour that exists: the cell's obs, r, c, v, the neighbour's nv and the offset's weight w.

    With a size, places beyond the edges are those at the edge.
    """
    places = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(float(w)).alias("w")) for a, b, w in offsets])).alias("o")
    edge = (lambda x: F.greatest(F.lit(0), F.least(F.lit(size - 1), x))) if size else (lambda x: x)
    asked = df.select("obs", "r", "c", "v", places).select("obs", "r", "c", "v", edge(F.col("r") + F.col("o.dr")).alias("nr"), edge(F.col("c") + F.col("o.dc")).alias("nc"), "o.w", "o.dr", "o.dc")
    values = df.select("obs", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("v").alias("nv"))
    return asked.join(values, ["obs", "nr", "nc"])


def square(radius: int) -> list[tuple[int, int, float]]:
    span = range(-radius, radius + 1)
    return [(a, b, 1.0) for a in span for b in span]


CROSS = [(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]


def dilate(cells: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """The set of cells (r, c) at any of the offsets from a cell."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b, _ in offsets])).alias("o")
    return cells.select("r", "c", at).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()


def spread(cells: DataFrame, offsets: list[tuple[int, int, float]], by: list[str]) -> DataFrame:
    """`dilate` for cells (by, r, c) of several rasters."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b, _ in offsets])).alias("o")
    return cells.select(*by, "r", "c", at).select(*by, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()


def erode(cells: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """The cells all of whose offsets are in the set: those that are reached from every offset."""
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b, _ in offsets])).alias("o")
    moved = cells.distinct().select("r", "c", at).select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"))
    return moved.groupBy("r", "c").agg(F.count("*").alias("n")).where(F.col("n") == len(offsets)).select("r", "c")


BLOCK = 256  # the side of a block of cells


def _labelled(f: pd.DataFrame) -> pd.DataFrame:
    """The cells of a block with the least number of a cell in their component inside the block."""
    f = f.sort_values("a")
    a = f.a.to_numpy()
    r, c = f.r.to_numpy() % BLOCK, f.c.to_numpy() % BLOCK
    at = np.full((BLOCK + 1, BLOCK + 1), -1)
    at[r, c] = np.arange(len(a))
    label = np.arange(len(a))
    pairs = np.concatenate([np.stack([at[r, c], at[r + dr, c + dc]], axis=1) for dr, dc in ((0, 1), (1, 0))])
    one, two = pairs[pairs[:, 1] >= 0].T
    while (label[one] != label[two]).any():
        low = np.minimum(label[one], label[two])
        np.minimum.at(label, label[one], low)
        np.minimum.at(label, label[two], low)
        while (label[label] != label).any():
            label = label[label]
    return pd.DataFrame({"r": f.r.to_numpy(), "c": f.c.to_numpy(), "a": a, "own": a[label]})


def components(cells: DataFrame) -> DataFrame:
    """cells (r, c) with `label`, the least number of a cell in their 4-connected component.

    Blocks of cells are labelled each in its own task; only labels that meet across a border of blocks go on, as the
    nodes of a graph, whose least labels travel to neighbours and along what they point to until none changes. So the
    rounds follow the number of blocks that an object spans, not its cells. Each round is written and replaces the last.
    """
    size = 1 << 20
    node = F.col("r").cast("long") * size + F.col("c")
    block = [F.floor(F.col(x) / BLOCK) for x in ("r", "c")]
    nodes = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().withColumn("a", node)
    own = written(nodes.groupBy(*block).applyInPandas(_labelled, "r long, c long, a long, own long"), "block-labels")
    edge = [own.where(F.pmod(F.col(x), F.lit(BLOCK)) == BLOCK - 1).select((F.col("a") + step).alias("a"), F.col("own").alias("one")) for x, step in (("r", size), ("c", 1))]
    first = own.where((F.pmod("r", F.lit(BLOCK)) == 0) | (F.pmod("c", F.lit(BLOCK)) == 0)).select("a", F.col("own").alias("two"))
    pairs = edge[0].unionByName(edge[1]).join(first, "a").select("one", "two").distinct()
    edges = written(pairs.unionByName(pairs.select(F.col("two").alias("one"), F.col("one").alias("two"))).distinct(), "label-edges")
    labels = written(edges.select(F.col("one").alias("a"), F.col("one").alias("label")).distinct(), "labels")
    changed = not edges.isEmpty()
    while changed:
        near = edges.join(labels.select(F.col("a").alias("two"), F.col("label").alias("l")), "two").groupBy(F.col("one").alias("a")).agg(F.min("l").alias("l"))
        low = labels.join(near, "a").select("a", "label", F.least("label", "l").alias("new"))
        jump = labels.select(F.col("a").alias("new"), F.col("label").alias("far"))
        after = written(low.join(jump, "new").select("a", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("moved")), "labels")
        changed = not after.where("moved").isEmpty()
        removed(cells.sparkSession, labels)
        labels = after.select("a", "label")
    roots = labels.select(F.col("a").alias("own"), F.col("label").alias("root"))
    out = own.join(roots, "own", "left")
    return out.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.coalesce("root", "own").alias("label"))


def weighted(df: DataFrame, offsets: list[tuple[int, int, float]], size: int | None, value: Column) -> DataFrame:
    return around(df, offsets, size).groupBy("obs", "r", "c").agg(value)
