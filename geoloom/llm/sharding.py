"""Size-balanced sharding with sampled splitters, in DataFrame operations only.

1. Every row draws samples of its key in proportion to its size: a row of size s draws floor(s / step + u) times, u
   from a hash of the row, so that the draw is repeatable and its expected number is fixed (`SAMPLES`).
2. Quantiles of the sampled keys are the splitters; they cut the key order into fine ranges. A key that is drawn for
   several quantiles is hot and has ranges of its own.
3. Rows are put into ranges by a two-step search in the splitters; the exact bytes of each range are summed. Ranges
   that are overfull after all are subdivided: by a hash of the key or, for a hot key, by a hash of the row id.
4. The ranges, in key order, are dealt to shards by their cumulative bytes.
5. A row's slot is the number of rows in earlier ranges of its shard plus its rank in its range.

The key is a hash of the text, so copies of a text are neighbours and stay together, unless their group is so large
that it would unbalance the shards. Only ids, sizes and hashes are shuffled, never texts. The number of ranges is
fixed, so the splitters and range sums that one task or the driver sees do not grow with the data; a range is sorted
by Spark's spilling sort.

Defined cases: a null text has size 8 and takes part like an empty one, except that its key is null-safe and equal
for all null texts; null ids sort first; rows that are equal in all columns get neighbouring slots; an empty table
gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, table

SHARDS = 24
RANGES = 64  # fine ranges for each shard
DRAWS = 8  # samples for each fine range


def _unit(*columns: Column) -> Column:
    """A repeatable number from 0 to 1 for a row."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), *columns), 11)).cast("double") / F.lit(float(1 << 53))


def _draw(narrow: DataFrame, total: int, samples: int) -> DataFrame:
    """Keys drawn in proportion to size, with the number of times each is drawn."""
    times = F.floor(F.col("size") * F.lit(samples / max(total, 1)) + _unit(F.col("id"), F.col("key")))
    return narrow.select("key", times.cast("long").alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times"))


def _splitters(narrow: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """(key, number of quantiles that fall on it), in key order: at most `ranges` - 1 quantiles, so a bounded list."""
    order = W.orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    drawn = _draw(narrow, total, ranges * DRAWS).withColumn("upto", F.sum("times").over(order))
    cuts = F.floor(F.col("upto") / DRAWS) - F.floor((F.col("upto") - F.col("times")) / DRAWS)
    return [(r.key, r.cuts) for r in drawn.select("key", cuts.alias("cuts")).where("cuts > 0").orderBy("key").collect()]


def _position(value: Column, keys: list[int]) -> Column:
    """How many of the sorted keys are less than value: first among every n-th key, then within those n."""
    if not keys:
        return F.lit(0)
    n = max(1, int(len(keys) ** 0.5))
    rows = [keys[i : i + n] for i in range(0, len(keys), n)]
    heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])
    nested = F.array(*[F.array(*[F.lit(k).cast("long") for k in r]) for r in rows])
    row = F.size(F.filter(heads, lambda k: k < value))
    inner = F.size(F.filter(F.element_at(nested, F.greatest(row, F.lit(1))), lambda k: k < value))
    return F.when(row == 0, F.lit(0)).otherwise((row - 1) * n + inner).cast("int")


def shard_by_size(df: DataFrame, id_col: str, key: Column, size: Column, shards: int = SHARDS) -> DataFrame:
    """Columns id, key, size, shard, slot for each row of df: shards of near equal total size.

    key: a long column that orders the rows; size: a positive long column.
    """
    ranges = shards * RANGES
    # A row's place is written with it: rows that agree in all else are still told apart.
    narrow = materialize(df.select(F.col(id_col).alias("id"), key.alias("key"), size.cast("long").alias("size"), F.monotonically_increasing_id().alias("place")), "shard-rows")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    splitters = _splitters(narrow, total, ranges)
    keys = [k for k, _ in splitters]
    cuts = {k: n for k, n in splitters if n > 1}
    # Ranges lie between splitters; a hot key has a range of its own: 2 * position + 1 where the key equals it.
    position = _position(F.col("key"), keys)
    hot = F.col("key").isin(list(cuts)) if cuts else F.lit(False)
    placed = narrow.withColumn("range", position * 2 + F.when(hot, 1).otherwise(0))
    share = max(1.0, total / max(1, ranges))
    # Exact sums; an overfull range is subdivided into as many parts as it has shares.
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("bytes") / F.lit(share * 2)), F.lit(1))
    over = {r.range: r.parts for r in sums.withColumn("parts", parts).where("parts > 1").collect()}  # at most `ranges` rows
    part = F.lit(0)
    if over:
        number = F.create_map(*[F.lit(x) for pair in over.items() for x in pair])[F.col("range")]
        part = F.when(F.col("range").isin(list(over)), F.pmod(F.when(F.col("range") % 2 == 1, F.xxhash64(F.lit("part"), F.col("place"))).otherwise(F.xxhash64(F.lit("part"), F.col("key"))), number)).otherwise(0)
    placed = placed.withColumn("part", part.cast("int"))
    units = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    middle = F.sum("bytes").over(before) - F.col("bytes") / 2
    dealt = units.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
    within = W.partitionBy("shard").orderBy("range", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = dealt.select("range", "part", "shard", (F.sum("rows").over(within) - F.col("rows")).alias("first"))
    rank = F.row_number().over(W.partitionBy("range", "part").orderBy("key", "id", "place"))
    ranked = placed.withColumn("rank", rank - 1)
    # Ranges and their parts have a fixed bound (3 * ranges), so this side is safe to broadcast.
    return ranked.join(F.broadcast(dealt), ["range", "part"]).select("id", "key", "size", "shard", (F.col("first") + F.col("rank")).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; copies of a text are neighbours."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    # The sharding key carries the checksum of the text in its low bits, so that texts are read once.
    key = F.shiftleft(F.xxhash64("text"), 32).bitwiseOR(crc)
    out = shard_by_size(docs, "doc_id", key, size)
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_sharding": op2_sharding}
ORACLE: dict[str, str] = {}
