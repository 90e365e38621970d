"""Tables written once to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset on one machine, a folder of this process; elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="geoloom-tables-"))
    return f"file://{_own[0]}"


def written(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """df as it is read back from files: its lineage is cut, what was made survives a lost executor, and its size is known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/geoloom/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    kept = [f for f in df.schema if f.name not in partition_by]
    schema = df.schema.__class__([*kept, *(f for f in df.schema if f.name in partition_by)])
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of tables that `written` made, for when nothing to come reads them."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        for folder in {f.rpartition("/geoloom/")[0] + "/geoloom/" + f.rpartition("/geoloom/")[2].split("/")[0] for f in t.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(hadoop).delete(where, True)
