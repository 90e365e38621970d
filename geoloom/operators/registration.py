"""Sub-pixel registration: phase correlation of windows, the median of their shifts and its spread, whole and part shifts.

Windows are bounded groups of a raster (`win` x `win` cells); each gives one row, and an observation's rows are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST_VALID, FINE = 256, 0.8, 20  # cells, share, parts of a cell


def shift_of(a: np.ndarray, b: np.ndarray, fine: int = FINE) -> tuple[float, float]:
    """The shift (rows, columns) that brings b onto a, to a fine-th of a cell.

    The whole shift is at the peak of the cross-correlation; around it the correlation is evaluated on a fine grid, as
    two products with the waves at the fine places.
    """
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    at = np.unravel_index(np.abs(np.fft.ifft2(cross)).argmax(), a.shape)
    whole = [x - n if x > n // 2 else x for x, n in zip(at, a.shape, strict=True)]
    reach = (int(np.ceil(fine * 1.5)) - 1) // 2
    places = [w + np.arange(-reach, reach + 1) / fine for w in whole]
    waves = [np.exp(2j * np.pi * np.outer(p, np.fft.fftfreq(n))) for p, n in zip(places, a.shape, strict=True)]
    y, x = np.unravel_index(np.abs(waves[0] @ cross @ waves[1].T).argmax(), (2 * reach + 1,) * 2)
    return float(places[0][y]), float(places[1][x])


def peak_ratio(a: np.ndarray, b: np.ndarray) -> float:
    """The peak of the phase correlation against the mean and three deviations of all else."""
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    surface = np.abs(np.fft.ifft2(cross / (np.abs(cross) + 1e-12)))
    rest = surface[surface < surface.max()]
    return float(surface.max() / (rest.mean() + 3 * rest.std() + 1e-12)) if len(rest) else 0.0


def window_shifts(df: DataFrame, rows: int, columns: int, win: int = WINDOW) -> DataFrame:
    """obs, dy, dx, peak of every whole window of rasters (obs, r, c, ref, v, ok) with enough valid cells in both."""

    def estimate(f: pd.DataFrame) -> pd.DataFrame:
        a, b = np.full((win, win), np.nan), np.full((win, win), np.nan)
        r, c = f.r.to_numpy() % win, f.c.to_numpy() % win
        a[r, c], b[r, c] = np.where(f.ok, f.ref, np.nan), np.where(f.ok, f.v, np.nan)
        ok = ~np.isnan(a) & ~np.isnan(b)
        if ok.mean() < LEAST_VALID:
            return pd.DataFrame({"obs": [], "dy": [], "dx": [], "peak": []})
        taper = np.outer(np.hanning(win), np.hanning(win))
        a, b = (np.where(ok, x - x[ok].mean(), 0.0) for x in (a, b))
        a, b = ((x - x.mean()) * taper for x in (a, b))
        dy, dx = shift_of(a, b)
        return pd.DataFrame({"obs": [f.obs.iloc[0]], "dy": [dy], "dx": [dx], "peak": [peak_ratio(a, b)]})

    inside = (F.col("r") < rows // win * win) & (F.col("c") < columns // win * win)
    placed = df.where(inside).select("obs", "r", "c", F.col("ref").cast("double").alias("ref"), F.col("v").cast("double").alias("v"), "ok", F.floor(F.col("r") / win).alias("wr"), F.floor(F.col("c") / win).alias("wc"))
    kind = df.schema["obs"].dataType.simpleString()
    return placed.groupBy("obs", "wr", "wc").applyInPandas(estimate, f"obs {kind}, dy double, dx double, peak double")


def registration(windows: DataFrame) -> DataFrame:
    """obs, n_windows, dy, dx, residual, peak: medians over an observation's windows, and the spread around them."""
    med = windows.groupBy("obs").agg(F.count("*").alias("n_windows"), F.median("dy").alias("my"), F.median("dx").alias("mx"), F.median("peak").alias("peak"))
    far = F.pow(F.col("dy") - F.col("my"), 2) + F.pow(F.col("dx") - F.col("mx"), 2)
    spread = windows.drop("peak").join(med, "obs").groupBy("obs").agg(F.sqrt(F.median(far)).alias("residual"))
    return med.join(spread, "obs").select("obs", "n_windows", F.col("my").alias("dy"), F.col("mx").alias("dx"), "residual", "peak")


def shifted(df: DataFrame, dy: float, dx: float, size: int, nearest: bool = False, fill: float | None = None) -> DataFrame:
    """Rasters (obs, r, c, v) of size x size moved by (dy, dx): linear between four neighbours that must all exist, or the nearest cell.

    With a fill, places without a value take it.
    """
    if nearest:
        sy, sx = int(np.floor(dy + 0.5)), int(np.floor(dx + 0.5))
        out = df.select("obs", (F.col("r") + sy).alias("r"), (F.col("c") + sx).alias("c"), "v").where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1))
    else:
        fy, fx = -dy - np.floor(-dy), -dx - np.floor(-dx)
        oy, ox = int(np.floor(-dy)), int(np.floor(-dx))
        corners = [(oy + i, ox + j, (fy if i else 1 - fy) * (fx if j else 1 - fx)) for i in (0, 1) for j in (0, 1)]
        corners = [x for x in corners if x[2] > 0]
        # The cell at (r, c) is the mean of the source cells around (r - dy, c - dx): each source cell gives to those.
        place = F.explode(F.array(*[F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b"), F.lit(float(w)).alias("w")) for a, b, w in corners])).alias("o")
        given = df.select("obs", "r", "c", "v", place).select("obs", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), (F.col("v") * F.col("o.w")).alias("v"))
        given = given.where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)).groupBy("obs", "r", "c")
        out = given.agg(F.count("*").alias("n"), F.sum("v").alias("v")).where(F.col("n") == len(corners)).select("obs", "r", "c", "v")
    if fill is None:
        return out
    every = df.select("obs").distinct().select("obs", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("r")).select("obs", "r", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("c"))
    return every.join(out, ["obs", "r", "c"], "left").select("obs", "r", "c", F.coalesce("v", F.lit(fill)).alias("v"))

