"""Ordered operators: top ranks, as-of joins, runs, and the persistence state machine, as windows over one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spark's default of spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT = 1000


def first_ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows of a group before the shuffle (window group limit), up to GROUP_LIMIT.

    For more rows, each input partition's part of a group is ranked first, so that the last task of a group reads k rows
    of each partition, not the group.
    """
    if k > GROUP_LIMIT:
        parts = df.withColumn("__part", F.spark_partition_id())
        parts = parts.withColumn("__rank", F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)))
        df = parts.where(F.col("__rank") <= k).drop("__rank", "__part")
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """Each left row with the values of the latest right row of its group before it (or at its time, if not strict).

    One union and one sorted window in place of a range join; ties in time on the right take the greatest values.
    """
    kept = [c for c in left.columns if c not in by and c != at]
    side = F.lit(0 if strict else 1)
    a = left.select(*by, at, side.alias("__side"), F.struct(*kept).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__value"))
    latest = right.groupBy(*by, at).agg(F.max(F.struct(*values)).alias("__value"))
    b = latest.select(*by, at, F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__value")
    w = W.partitionBy(*by).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__row IS NOT NULL")
    return both.select(*by, at, "__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with `run`: equal for neighbours with one value, by the difference of two row numbers."""
    every, same = W.partitionBy(*by).orderBy(*order), W.partitionBy(*by, value).orderBy(*order)
    return df.withColumn("run", F.row_number().over(every) - F.row_number().over(same))


def ranked_in_buckets(df: DataFrame, by: Sequence[str], bucket: Sequence[Column], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with the row number of each row in its group, in an order whose first keys are those of the buckets.

    Rows are numbered within buckets, whose numbers of rows are counted first and added up; so a group of any size is
    spread over its buckets. The window over buckets is small: one row for each.
    """
    keys = [f"__b{i}" for i in range(len(bucket))]
    rows = df.withColumns(dict(zip(keys, bucket, strict=True)))
    counts = rows.groupBy(*by, *keys).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, *keys])], F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*by, *keys])]
    within = F.row_number().over(W.partitionBy(*by, *keys).orderBy(*order))
    return rows.withColumn("__within", within).join(counts, same).withColumn(name, F.col("__before") + F.col("__within")).select(*df.columns, name)
