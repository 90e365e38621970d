"""Gates on candidate objects: measures of their cells, the rules of each gate, and the funnel through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.config import T

GATES = ("G1", "G2", "G3", "G4", "G5", "G6")
WATER = ("water_expansion", "water_contraction")


def inner_distance(cells: DataFrame, most: int) -> DataFrame:
    """cells (label, r, c) with `d`, how many steps (diagonal ones too) lead out of the object, up to `most`.

    Along a row it is the nearer end of a run of cells, found by two passes of a window; across rows each cell looks at
    the `most` - 1 cells above and below it: it can leave as many rows away as it takes, or from there along the row.
    """
    row = W.partitionBy("label", "r")
    run = cells.distinct().withColumn("run", F.col("c") - F.row_number().over(row.orderBy("c")))
    own = W.partitionBy("label", "r", "run")
    near = run.select("label", "r", "c", F.least(F.col("c") - F.min("c").over(own) + 1, F.max("c").over(own) - F.col("c") + 1, F.lit(most)).cast("int").alias("g"))
    step = F.explode(F.array(*[F.lit(k) for k in range(1 - most, most)])).alias("k")
    asked = near.select("label", "r", "c", step).select("label", F.col("r").alias("own"), "c", "k", (F.col("r") + F.col("k")).alias("r"))
    met = asked.join(near, ["label", "r", "c"], "left")
    return met.groupBy("label", F.col("own").alias("r"), "c").agg(F.min(F.greatest(F.abs("k"), F.coalesce("g", F.lit(0)))).alias("d"))


def elongation() -> Column:
    """The square root of the ratio of an object's second moments along its axes, from sums of its cells (r, c); a cell spreads over its own square."""
    n = F.count("*")
    rr, cc = F.avg(F.col("r") * F.col("r")) - F.avg("r") * F.avg("r") + 1 / 12, F.avg(F.col("c") * F.col("c")) - F.avg("c") * F.avg("c") + 1 / 12
    rc = F.avg(F.col("r") * F.col("c")) - F.avg("r") * F.avg("c")
    half, root = (rr + cc) / 2, F.sqrt((rr - cc) * (rr - cc) / 4 + rc * rc)
    return F.when(n > 0, F.sqrt((half + root) / (half - root)))


def measures(cells: DataFrame) -> DataFrame:
    """label, n, width, elongation and shares of objects' cells (label, r, c, usable, edge, seasonal, post: booleans).

    Width is the side of the greatest square of cells inside the object, as far as the sliver rule asks.
    """
    most = int((T.sliver_max_width_px + 1) // 2) + 1
    wide = inner_distance(cells.select("label", "r", "c"), most).groupBy("label").agg((2 * F.max("d") - 1).alias("width"))
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_share")
    each = cells.groupBy("label").agg(F.count("*").alias("n"), elongation().alias("elongation"), F.min("r").alias("top"), F.min("c").alias("left"), *[share(c) for c in ("usable", "edge", "seasonal", "post")])
    return each.join(wide, "label")


def passes() -> dict[str, Column]:
    """What each gate asks of an object (`measures`, with its type and its observation's gain and rmse)."""
    water, road = F.col("type").isin(*WATER), F.col("type") == "road_development"
    sliver = (F.col("width") <= T.sliver_max_width_px) & (F.col("edge_share") >= T.sliver_edge_share)
    return {
        "G1": F.col("usable_share") >= T.object_min_usable,
        "G2": ~sliver,
        "G3": (F.col("rmse") <= T.max_norm_rmse) & F.col("gain").between(*T.gain_range),
        "G4": ~water | (1 - F.col("seasonal_share") >= T.water_departure_min_fraction),
        "G5": (F.col("n") >= F.when(water, T.mmu_water_px).otherwise(T.mmu_px)) & (~road | (F.col("elongation") >= T.road_elongation)),
        "G6": F.col("post_share") >= T.object_post_share,
    }


def judged(objects: DataFrame) -> DataFrame:
    """Objects with a boolean for each gate (one that cannot be told is not passed) and `reason`, the first gate that stops them."""
    rules = passes()
    out = objects.withColumns({g: F.coalesce(c, F.lit(False)) for g, c in rules.items()})
    return out.withColumn("reason", F.coalesce(*[F.when(~F.col(g), g) for g in GATES]))


def funnel(objects: DataFrame) -> DataFrame:
    """gate, n_in, n_out in order, and `without`: how many more objects would come through if the gate were left out; one pass."""

    def every(names: list[str]) -> Column:
        held = F.lit(True)
        for g in names:
            held = held & F.col(g)
        return F.sum(F.when(held, 1).otherwise(0)).cast("long")

    gates = list(GATES)
    row = objects.agg(*[every(gates[:i]).alias(f"in{i}") for i in range(len(gates) + 1)], *[every(gates[:i] + gates[i + 1 :]).alias(f"out{i}") for i in range(len(gates))])
    last = F.col(f"in{len(gates)}")
    parts = [F.struct(F.lit(g).alias("gate"), F.col(f"in{i}").alias("n_in"), F.col(f"in{i + 1}").alias("n_out"), (F.col(f"out{i}") - last).alias("without")) for i, g in enumerate(gates)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
