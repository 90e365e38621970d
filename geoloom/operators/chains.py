"""Verification of hash chains: every link and every content hash is checked in parallel, the first fault reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.config import GENESIS


def chain_state(df: DataFrame, chain: str, seq: str, prev_hash: str, record_hash: str, content: Column) -> DataFrame:
    """Per chain: total records, first bad place, its problem ('link' is reported before 'content'), and the head's hash."""
    w = W.partitionBy(chain).orderBy(seq)
    before = F.coalesce(F.lag(record_hash, 1).over(w), F.lit(GENESIS))
    problem = F.when(F.col(prev_hash) != before, "link").when(F.col(record_hash) != content, "content")
    rows = df.withColumn("__problem", problem)
    bad = F.min(F.when(F.col("__problem").isNotNull(), F.struct(F.col(seq).alias("at"), F.col("__problem").alias("what"))))
    out = rows.groupBy(chain).agg(F.count("*").alias("total"), bad.alias("bad"), F.max_by(record_hash, seq).alias("head"))
    return out.select(chain, "total", F.col("bad.at").alias("first_bad"), F.col("bad.what").alias("problem"), "head")
