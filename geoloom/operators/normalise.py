"""Relative normalisation on invariant pixels: a robust line for each band that maps an observation to its area's reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.config import T
from geoloom.functions import columns as C
from geoloom.operators.timeline import first_ranked

BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
STABLE = 0.05


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The median of (xj - xi) / (yj - yi) over all pairs of different y; not a number where there is none."""
    order = np.argsort(y, kind="stable")
    x, y = x[order], y[order]
    i, j = np.triu_indices(len(x), 1)
    gap = y[j] - y[i]
    able = gap > 0
    return float(np.median((x[j] - x[i])[able] / gap[able])) if able.any() else float("nan")


def _fit(f: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for b in BANDS:
        x, y = f[f"ref_{b}"].to_numpy(), f[b].to_numpy()
        gain = median_slope(x, y)
        offset = np.median(x) - gain * np.median(y)
        rows.append((int(f.aoi.iloc[0]), int(f.obs.iloc[0]), b, int(f.n_pif.iloc[0]), gain, offset, float(np.sqrt(np.mean((gain * y + offset - x) ** 2)))))
    return pd.DataFrame(rows, columns=["aoi", "obs", "band", "n_pif", "gain", "offset", "rmse"])


def invariant(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """Pixels (aoi, obs, r, c, bands, ref_ bands) of both whose three index differences stay below STABLE.

    reference: aoi, r, c, bands; observed: aoi, obs, r, c, bands, usable. They meet by area, row and column.
    """
    index = {"ndvi": C.ndvi(), "ndbi": C.ndbi(), "mndwi": C.mndwi()}
    ref = reference.select("aoi", "r", "c", *[F.col(b).alias(f"ref_{b}") for b in BANDS], *[v.alias(f"ref_{n}") for n, v in index.items()])
    own = observed.where("usable").select("aoi", "obs", "r", "c", *BANDS, *[v.alias(n) for n, v in index.items()])
    near = [F.abs(F.col(n) - F.col(f"ref_{n}")) < STABLE for n in index]
    return own.join(ref, ["aoi", "r", "c"]).where(near[0] & near[1] & near[2]).drop(*index, *(f"ref_{n}" for n in index))


def fits(stable: DataFrame) -> DataFrame:
    """aoi, obs, band, n_pif, gain, offset, rmse of each observation with `invariant_least` invariant pixels or more.

    At most `invariant_cap` pixels of an observation, those of least hashes, are compared pair by pair in one task.
    """
    counts = stable.groupBy("aoi", "obs").agg(F.count("*").alias("n_pif")).where(F.col("n_pif") >= T.invariant_least)
    key = F.sha2(F.concat_ws("-", "aoi", "obs", "r", "c"), 256)
    some = first_ranked(stable.withColumn("k", key), ["aoi", "obs"], [F.col("k"), F.col("r"), F.col("c")], T.invariant_cap)
    schema = "aoi int, obs int, band string, n_pif long, gain double, offset double, rmse double"
    return some.join(counts, ["aoi", "obs"]).groupBy("aoi", "obs").applyInPandas(_fit, schema)
