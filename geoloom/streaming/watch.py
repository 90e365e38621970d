"""Structured Streaming forms of the intake: a watched folder, deduplicated enqueueing, tile statistics and event states.

Each function drains what the folder holds (availableNow) into a table and returns it, so that it can be compared with
the batch query, whatever the number of batches. Aggregations are by day and carry a watermark of `LATE`, behind which
their state is dropped; they run in update mode, and the table keeps the last row of each key. The state machine keeps a
few numbers for each tile. Scenes later than the watermark change history, so the back-fill recomputes the tiles that a
batch touches, from a history in buckets of which it reads only those.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from geoloom.sources.fixtures import read

LATE = "2 days"
BUCKETS = 64


def watch(spark: SparkSession, sf_dir: str, name: str = "events", per_trigger: int = 8) -> DataFrame:
    """A stream of the files of a table in a watched folder, with the table's explicit schema."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*")


def folder(spark: SparkSession) -> str:
    """Where state and results go: the shared checkpoint folder of the cluster; on one machine, else a folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="geoloom-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream until the folder is read, and return what it wrote: in append mode, or the last row of each key in update mode."""
    spark, at = df.sparkSession, folder(df.sparkSession)
    rows = f"{at}/rows"

    def write(batch: DataFrame, number: int) -> None:
        # One folder for each batch: a batch that is run again replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    query = df.writeStream.outputMode("update" if keys else "append").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).option("basePath", rows).parquet(rows)
    if not keys:
        return found.drop("batch")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("x")).select(*keys, "x.*")


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", LATE)


def stream_tile_stats(spark: SparkSession, sf_dir: str, per_trigger: int = 8) -> DataFrame:
    """Observations and summed value of each tile and day, kept up to date while the day is within the watermark."""
    e = _timed(watch(spark, sf_dir, per_trigger=per_trigger))
    rows = e.groupBy("user_id", F.window("at", "1 day")).agg(F.count("*").alias("n_obs"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("cents"))
    return drain(rows.select("user_id", F.col("window.start").cast("date").alias("day"), "n_obs", "cents"), ["user_id", "day"])


def stream_window_counts(spark: SparkSession, sf_dir: str, per_trigger: int = 8) -> DataFrame:
    """Observations in tumbling windows of a day by role."""
    rows = _timed(watch(spark, sf_dir, per_trigger=per_trigger)).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drain(rows.select(F.col("window.start").cast("date").alias("day"), "event_type", "n"), ["day", "event_type"])


def stream_dedupe(spark: SparkSession, sf_dir: str, per_trigger: int = 8) -> DataFrame:
    """The enqueueing of each key (tile and role): repeats within the watermark are dropped in the stream, later ones as they meet the table."""
    e = _timed(watch(spark, sf_dir, per_trigger=per_trigger)).withColumn("dedupe_key", F.concat_ws(":", "event_type", "user_id"))
    return drain(e.dropDuplicatesWithinWatermark(["dedupe_key"]).select("dedupe_key")).distinct()


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    confirmations, contradictions, best = state.get if state.exists else (0, 0, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for value in rows["value"]:
        if value >= 60:
            confirmations, contradictions = confirmations + 1, 0
        elif value < 10 and confirmations:
            contradictions += 1
            if contradictions == 2:
                best, confirmations, contradictions = max(best, 1), 0, 0
        else:
            contradictions = 0
    state.update((confirmations, contradictions, best))
    yield pd.DataFrame({"user_id": [key[0]], "confirmations": [confirmations], "ended": [best]})


def stream_state_machine(spark: SparkSession, sf_dir: str, per_trigger: int = 8) -> DataFrame:
    """Running state of each tile: confirmations since the last end, and whether two contradictions in a row ended it.

    Rows of a batch are taken in order of time, batches as they come.
    """
    e = watch(spark, sf_dir, per_trigger=per_trigger).where("event_type <> 'error'").select("user_id", "event_id", "ts", "value")
    rows = e.groupBy("user_id").applyInPandasWithState(_advance, "user_id long, confirmations int, ended int", "confirmations int, contradictions int, best int", "update", GroupStateTimeout.NoTimeout)
    return drain(rows, ["user_id"])


def backfill_recompute(spark: SparkSession, sf_dir: str, per_trigger: int = 8) -> DataFrame:
    """Each batch's tiles recomputed from all their rows: late rows change results instead of being dropped.

    The history lies in buckets of tiles; a batch reads only the buckets that it touches.
    """
    at = folder(spark)
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    kept = "user_id long, ts timestamp_ntz, batch int, bucket int"

    def recompute(batch: DataFrame, number: int) -> None:
        # Written first, by batch: a batch that is run again replaces its own rows.
        batch.select("user_id", "ts", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/history/batch={number}")
        own = spark.read.schema("user_id long, ts timestamp_ntz, bucket int").parquet(f"{at}/history/batch={number}")
        touched = own.select("user_id", "bucket").distinct()
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
        history = spark.read.schema(kept).option("basePath", f"{at}/history").parquet(f"{at}/history").where(F.col("bucket").isin(buckets))
        history = history.join(touched.select("user_id"), "user_id", "left_semi")
        history.groupBy("user_id").agg(F.count("*").alias("n_obs"), F.max("ts").alias("last_ts")).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    query = watch(spark, sf_dir, per_trigger=per_trigger).writeStream.foreachBatch(recompute).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("user_id long, n_obs long, last_ts timestamp_ntz, batch int").option("basePath", f"{at}/rows").parquet(f"{at}/rows")
    return found.groupBy("user_id").agg(F.max_by(F.struct("n_obs", "last_ts"), "batch").alias("x")).select("user_id", "x.n_obs", "x.last_ts")
