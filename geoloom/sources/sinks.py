"""Writers: atomic overwrites of partitions, keyed merges, appends of new keys, GeoJSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new by key, and those of old whose key is not in new; columns as in old."""
    kept = old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new with keys that old does not have, one for each key."""
    return new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def coalesce_update(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """old with `column` from new where new has a value for the key."""
    values = new.select(*keys, F.col(column).alias("__new"))
    return old.join(values, list(keys), "left").withColumn(column, F.coalesce("__new", column)).select(*old.columns)


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace just the partitions that df has rows of. df must not read from the path."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def geojson_lines(df: DataFrame, path: str, x: str, y: str, properties: Sequence[str]) -> None:
    """One GeoJSON point feature a line."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
