"""What the corpus operators share: table readers and tables written to the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, **named: str) -> DataFrame:
    """`row`, a struct of all columns of df by place, and some of them under names of ours: whatever df's are called, none clashes."""
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return df.select(row.alias("row"), *[quoted(c).alias(name) for name, c in named.items()])


def restored(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that `carried` packed, under their own names; `changed`: what stands in place of some."""
    return df.select(*[changed.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)])


_own_folder: list[str] = []
_written: list[str] = []  # tables that `materialize` wrote and `sweep` has not removed


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on one machine, a folder of this process.

    Off one machine an unset folder is an error: executors would write where the driver cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="geoloom-shared-"))
    return f"file://{_own_folder[0]}"


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor, lets several branches read one computation, and gives
    the planner a measured size, so that it broadcasts only what is known to be small. options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoloom/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of written tables, for `sweep`."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Remove the tables written after the mark `since` but the last `keep`; only for when no result to come reads them."""
    gone = _written[since : len(_written) - keep]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    del _written[since : len(_written) - keep]


def bounded_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """All rows if there are at most `most`, else a repeatable sample by a hash of keys.

    The share is set so that more than `most` rows are very unlikely; rows alike in all keys come together, so a limit
    of twice as many guards what is collected. Each task passes on its share only, however many tasks there are.
    """
    total = df.count()
    if total <= most:
        return df
    share = max(most - 4 * most**0.5, 1.0) / total
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *keys), 11).cast("double") / float(1 << 53)
    return df.where(unit < share).limit(2 * most)
