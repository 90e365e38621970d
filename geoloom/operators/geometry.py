"""Outlines of cell sets, grids of other resolutions, tile names, boxes, and texts of geometries and vectors."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.grid import lonlat44


def warp(df: DataFrame, step: float, rows: int, columns: int, bilinear: bool = False) -> DataFrame:
    """A raster (obs, r, c, v) on a grid of rows x columns whose cells are `step` source cells wide, from the same corner.

    Places are computed for each target cell and met by equality. Nearest: the source cell that the target's centre is
    in. Bilinear: the four source centres around it; those that do not exist give their weight to the others.
    """
    target = df.select("obs").distinct().select("obs", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).select("obs", "r", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))
    source = df.select("obs", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    centre = lambda x: (F.col(x) + 0.5) * step
    if not bilinear:
        asked = target.select("obs", "r", "c", F.floor(centre("r")).cast("int").alias("sr"), F.floor(centre("c")).cast("int").alias("sc"))
        return asked.join(source, ["obs", "sr", "sc"]).select("obs", "r", "c", "v")
    y, x = centre("r") - 0.5, centre("c") - 0.5
    part = lambda a, k: F.when(F.lit(k) == 0, 1 - (a - F.floor(a))).otherwise(a - F.floor(a))
    corners = F.explode(F.array(*[F.struct((F.floor(y) + i).cast("int").alias("sr"), (F.floor(x) + j).cast("int").alias("sc"), (part(y, i) * part(x, j)).alias("w")) for i in (0, 1) for j in (0, 1)])).alias("o")
    asked = target.select("obs", "r", "c", corners).select("obs", "r", "c", "o.*").where("w > 0")
    out = asked.join(source, ["obs", "sr", "sc"]).groupBy("obs", "r", "c").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("w"))
    return out.select("obs", "r", "c", (F.col("s") / F.col("w")).alias("v"))


@dataclass(frozen=True)
class Grid:
    """A raster's grid: its upper left corner, the side of a cell, and how many rows and columns it has."""

    x0: float
    y0: float
    step: float
    rows: int
    columns: int


def reproject(df: DataFrame, source: Grid, target: Grid, bilinear: bool = False, fill: float = 0.0) -> DataFrame:
    """A raster (obs, r, c, v) in degrees on a grid in metres of zone 44 north.

    Each target cell's centre is projected back, and meets its source cell, or the four around it, by equality; what comes
    from outside the source is `fill`. Bilinear: source centres that do not exist give their weight to the others.
    """
    cells = df.select("obs").distinct().select("obs", F.explode(F.sequence(F.lit(0), F.lit(target.rows - 1))).alias("r")).select("obs", "r", F.explode(F.sequence(F.lit(0), F.lit(target.columns - 1))).alias("c"))
    lon, lat = lonlat44(target.x0 + (F.col("c") + 0.5) * target.step, target.y0 - (F.col("r") + 0.5) * target.step)
    places = cells.select("obs", "r", "c", ((F.lit(source.y0) - lat) / source.step).alias("y"), ((lon - source.x0) / source.step).alias("x"))
    values = df.select("obs", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    if not bilinear:
        asked = places.select("obs", "r", "c", F.floor("y").cast("int").alias("sr"), F.floor("x").cast("int").alias("sc"))
        return asked.join(values, ["obs", "sr", "sc"], "left").select("obs", "r", "c", F.coalesce("v", F.lit(fill)).alias("v"))
    y, x = F.col("y") - 0.5, F.col("x") - 0.5
    part = lambda a, k: (a - F.floor(a)) if k else 1 - (a - F.floor(a))
    corners = F.explode(F.array(*[F.struct((F.floor(y) + i).cast("int").alias("sr"), (F.floor(x) + j).cast("int").alias("sc"), (part(y, i) * part(x, j)).alias("w")) for i in (0, 1) for j in (0, 1)])).alias("o")
    met = places.select("obs", "r", "c", corners).select("obs", "r", "c", "o.*").join(values, ["obs", "sr", "sc"], "left")
    there = F.when(F.col("v").isNotNull(), F.col("w"))
    out = met.groupBy("obs", "r", "c").agg(F.sum(there * F.col("v")).alias("s"), F.sum(there).alias("w"))
    return out.select("obs", "r", "c", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(fill).alias("v"))


def averaged(df: DataFrame, step: float) -> DataFrame:
    """A raster (obs, r, c, v) on cells `step` source cells wide (1 or more), from the same corner, by area: each source cell counts with the share of it that a target cell covers."""

    def shares(x: str) -> Column:
        first = F.floor(F.col(x) / step)
        cut = F.least((first + 1) * step - F.col(x), F.lit(1.0))
        both = F.array(F.struct(first.cast("int").alias("at"), cut.alias("w")), F.struct((first + 1).cast("int").alias("at"), (1 - cut).alias("w")))
        return F.explode(F.filter(both, lambda o: o["w"] > 1e-12))

    spread = df.select("obs", "c", "v", shares("r").alias("a")).select("obs", "v", "a", shares("c").alias("b"))
    w = F.col("a.w") * F.col("b.w")
    out = spread.groupBy("obs", F.col("a.at").alias("r"), F.col("b.at").alias("c")).agg(F.sum(w * F.col("v")).alias("s"), F.sum(w).alias("w"))
    return out.select("obs", "r", "c", (F.col("s") / F.col("w")).alias("v"))


def window(df: DataFrame, top: int, left: int, rows: int, columns: int) -> DataFrame:
    """The cells of a whole-number window of a raster, counted from its corner; the filter reaches the scan."""
    inside = F.col("r").between(top, top + rows - 1) & F.col("c").between(left, left + columns - 1)
    return df.where(inside).withColumns({"r": F.col("r") - top, "c": F.col("c") - left})


def boundary(cells: DataFrame) -> DataFrame:
    """label, r0, c0, r1, c1: the directed edges between a cell of a label and what is not of it, with the cells on the right."""
    corner = lambda a, b, c, d: F.struct((F.col("r") + a).alias("r0"), (F.col("c") + b).alias("c0"), (F.col("r") + c).alias("r1"), (F.col("c") + d).alias("c1"))
    sides = F.explode(F.array(corner(0, 0, 0, 1), corner(0, 1, 1, 1), corner(1, 1, 1, 0), corner(1, 0, 0, 0))).alias("e")
    edges = cells.select("label", sides).select("label", "e.*")
    back = edges.select("label", F.col("r1").alias("r0"), F.col("c1").alias("c0"), F.col("r0").alias("r1"), F.col("c0").alias("c1"))
    return edges.join(back, ["label", "r0", "c0", "r1", "c1"], "left_anti")


def rings(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """The closed rings (r, c) of directed edges, without points on straight lines; at a crossing a ring turns right."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, c, d in sorted(edges):
        after.setdefault((a, b), []).append((c, d))
    out = []
    while after:
        start = min(after)
        ring, at, step = [start], start, None
        while True:
            nexts = after[at]
            if step is not None and len(nexts) > 1:
                right = (at[0] + step[1], at[1] - step[0])
                to = right if right in nexts else nexts[0]
            else:
                to = nexts[0]
            nexts.remove(to)
            if not nexts:
                del after[at]
            step, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
            ring.append(at)
        n = len(ring)
        turn = lambda p, q, s: (q[0] - p[0]) * (s[1] - q[1]) != (q[1] - p[1]) * (s[0] - q[0])
        out.append([q for i, q in enumerate(ring) if turn(ring[i - 1], q, ring[(i + 1) % n])])
    return out


def area(ring: list[tuple[int, int]]) -> float:
    """The signed area of a ring: positive for an outer one, negative for a hole."""
    return sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def wkt(found: list[list[tuple[int, int]]], size: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> str:
    """A multipolygon's text: outer rings with the holes in them; x grows with c, y falls with r."""
    def inside(p: tuple[int, int], ring: list[tuple[int, int]]) -> bool:
        r, c = p[0] + 0.5, p[1] + 0.5
        return sum((a[0] > r) != (b[0] > r) and c < a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    text = lambda ring: "(" + ", ".join(f"{x0 + c * size:g} {y0 - r * size:g}" for r, c in [*ring, ring[0]]) + ")"
    outer = [r for r in found if area(r) > 0]
    holes = [r for r in found if area(r) < 0]
    parts = []
    for o in outer:
        own = [h for h in holes if inside(min(h), o) and not any(inside(min(h), other) and area(other) < area(o) for other in outer if other is not o and inside(min(other), o))]
        parts.append("(" + ", ".join(text(r) for r in [o, *own]) + ")")
    return "MULTIPOLYGON (" + ", ".join(parts) + ")"


def outlines(cells: DataFrame, size: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """label, area, perimeter, vertices and wkt of the cells (label, r, c) of each label; a group is one object's outline."""

    def trace(f: pd.DataFrame) -> pd.DataFrame:
        found = rings(list(f[["r0", "c0", "r1", "c1"]].itertuples(index=False, name=None)))
        length = sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for ring in found for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        return pd.DataFrame({"label": [f.label.iloc[0]], "area": [sum(map(area, found)) * size * size], "perimeter": [length * size], "vertices": [sum(map(len, found))], "wkt": [wkt(found, size, x0, y0)]})

    kind = cells.schema["label"].dataType.simpleString()
    return boundary(cells).groupBy("label").applyInPandas(trace, f"label {kind}, area double, perimeter double, vertices int, wkt string")


def in_box(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells (r, c) joined to the boxes (box, r0, c0, r1, c1; ends excluded) that hold them, by the boxes' own cells."""
    spread = boxes.select("*", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1)).alias("r")).select("*", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("c"))
    return cells.join(spread.drop("r0", "c0", "r1", "c1"), ["r", "c"])


def tile_name(prefix: str, lat: Column, lon: Column, step: int) -> Column:
    """The name of the tile of `step` degrees that holds a place, by its south-west corner (north and east)."""
    la, lo = F.floor(lat / step) * step, F.floor(lon / step) * step
    return F.concat(F.lit(prefix), F.lit("N"), F.lpad(la.cast("string"), 2, "0"), F.lit("E"), F.lpad(lo.cast("string"), 3, "0"))


def vector_text(v: Column) -> Column:
    """A vector as text with six significant digits: [a,b,...]; small numbers with an exponent."""

    def number(x: Column) -> Column:
        x = x.cast("double")
        scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(x))))
        plain = F.regexp_replace(F.regexp_replace((F.rint(x * scale) / scale).cast("decimal(30,12)").cast("string"), "0+$", ""), "[.]$", "")
        small = F.regexp_replace(F.format_string("%.5e", x), r"[.]?0*e", "e")
        return F.when(x == 0, "0").when(F.abs(x) < 1e-4, small).otherwise(plain)

    return F.concat(F.lit("["), F.array_join(F.transform(v, number), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))
