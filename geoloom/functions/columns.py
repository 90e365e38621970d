"""Column expressions of the archive: indices, radiometry, decisions and identity keys. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.config import T


def nd(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); 0 where the sum is 0 or a value is missing or not a number."""
    ratio = F.try_divide(a.cast("double") - b, a.cast("double") + b)
    return F.coalesce(F.nanvl(ratio, F.lit(None).cast("double")), F.lit(0.0))


def ndvi() -> Column:
    return nd(F.col("b08"), F.col("b04"))


def mndwi() -> Column:
    return nd(F.col("b03"), F.col("b11"))


def ndbi() -> Column:
    return nd(F.col("b11"), F.col("b08"))


def bsi() -> Column:
    return nd(F.col("b11") + F.col("b04"), F.col("b08") + F.col("b02"))


def hot() -> Column:
    """Haze-optimised transform of reflectances."""
    return F.col("b02") - F.col("b04") * 0.5 - 0.08


def to_uint16(refl: Column) -> Column:
    """Reflectance as a stored number: half-even rounding, clipped to 1..65534, 0 for no data."""
    clipped = F.greatest(F.lit(1), F.least(F.lit(65534), F.rint(refl * 10000))).cast("int")
    return F.when(refl.isNull() | F.isnan(refl), 0).otherwise(clipped)


def from_uint16(dn: Column) -> Column:
    return F.nullif(dn, F.lit(0)).cast("double") / 10000


def stretch(refl: Column, high: float = 0.3) -> Column:
    """Display value 0..255 of a reflectance, truncated."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(refl, F.lit(0.0)) / high))
    return F.floor(scaled * 255).cast("int")


def baseline(text: Column) -> tuple[Column, Column]:
    """(major, minor) of a processing baseline 'NN.NN', else nulls."""
    part = lambda k: F.expr("null").cast("int") if k is None else F.regexp_extract(text, r"^\s*(\d+)\.(\d+)\s*$", k)
    return tuple(F.when(part(k) != "", part(k).try_cast("int")) for k in (1, 2))


def offset_decision(major: Column, applied: Column, product: Column) -> Column:
    """What to add to the digital numbers: 0, the product's offset, or a rejection.

    product: null without product metadata, else its offset. With metadata its value decides whether there is an
    offset at all; without, baselines from 4 on have -1000.
    """
    size = F.coalesce(product, F.when(major >= 4, -1000).otherwise(0))
    return (
        F.when(major.isNull(), "radiometry_ambiguous")
        .when(size == 0, "apply:0")
        .when(applied.isNull(), "radiometry_ambiguous")
        .when(applied, "apply:0")
        .otherwise(F.concat(F.lit("apply:"), size.cast("string")))
    )


def refine_label(cover: Column, v: Column, w: Column) -> Column:
    """Class of a pixel from its land-cover code, NDVI and MNDWI; -1 unused. Later rules win."""
    return (
        F.when((cover == 60) & (v < 0.25) & (w < 0), 3)
        .when((cover == 50) & (v < 0.3) & (w < 0), 4)
        .when(cover.isin(20, 30, 40, 90) & (v <= 0.2) & (w < 0), 3)
        .when(cover.isin(20, 30, 40, 90) & (v >= 0.4), 2)
        .when(cover.isin(10, 95) & (v >= 0.35), 1)
        .when((cover == 80) & (w < -0.2) & (v < 0.2), 3)
        .when((cover == 80) & (w > 0) & (v < 0.2), 0)
        .otherwise(-1)
    )


def registration(windows: Column, shift: Column, peak: Column) -> Column:
    """Status of an estimated shift; the first rule that holds decides."""
    return (
        F.when(windows == 0, "suspect")
        .when((shift > T.max_correctable_px) | (peak < T.min_peak_ratio), "unusable")
        .when(shift >= T.min_correct_px, "corrected")
        .otherwise("ok")
    )


def usability(fraction: Column, status: Column) -> Column:
    """Why an observation is not usable, or 'usable'."""
    return F.when(fraction < T.obs_min_usable_fraction, "low_usable_fraction").when(status.isin("unusable", "suspect"), F.concat(F.lit("registration_"), status)).otherwise("usable")


def confidence_level(p: Column, confirmed: Column) -> Column:
    """LOW, MEDIUM or HIGH; HIGH only for confirmed events."""
    return F.when(p < T.level_low, "LOW").when((p < T.level_high) | ~confirmed, "MEDIUM").otherwise("HIGH")


def scene_uid(platform: Column, at: Column, tile: Column, base: Column, level: Column) -> Column:
    return F.concat_ws("|", platform, F.date_format(at, "yyyyMMdd'T'HHmmss"), F.coalesce(tile, F.lit("-")), F.coalesce(base, F.lit("-")), level)


def acquisition_key(platform: Column, at: Column) -> Column:
    return F.concat_ws("|", platform, F.date_format(at, "yyyyMMdd'T'HHmm"))


def unit_hash(*parts: Column) -> Column:
    """A number from 0 to 1 from the first 8 hex digits of the SHA-256 of the parts, joined by '-'."""
    digest = F.substring(F.sha2(F.concat_ws("-", *parts), 256), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / 4294967295.0


def tile_id(col: Column, row: Column, epsg: int = 32644) -> Column:
    return F.format_string(f"{epsg}_g10m_s128s64_c%d_r%d", col, row)


def safe_name(text: Column) -> Column:
    """A file name without unsafe signs, cut to 120."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, 120)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in doubles; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
