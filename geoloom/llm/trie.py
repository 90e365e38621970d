"""Prefix trie of conversations from mergeable partial tries.

Turns are packed into pieces, ordered by conversation; a node's key is a hash that is built turn by turn, so a piece needs
only the key at which it starts. Each task combines its conversations in a trie of its own and emits it as a node table;
tables are merged by key: members are summed, end lists strung together. The bottom-up rollup follows each conversation from
its deepest node upward: a node belongs to its least member, so a conversation's own nodes are the lower part of its
path, whose sums it passes to all nodes above; these sums are combined and merged as the members were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, table

PIECE = 1024  # turns of a piece
NODES = 50_000  # nodes of a partial trie, at which a task emits it and begins another
ENDS = 4096  # ids of an end list in one row
SPAN = 100  # conversations that share an opening
HEADS = 6  # the opening has fewer turns than this
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefix trie").digest()[:16], "big") % PRIME
SIZE = 16  # bytes of a key and of a turn's digest
POWERS = [pow(BASE, e, PRIME) for e in range(PIECE + 1)]
EMPTY = hashlib.sha256(b"").hexdigest()


def extended(key: int, turns: bytes) -> int:
    """The key of what follows `key` by some turns' digests."""
    for i in range(0, len(turns), SIZE):
        key = (key * BASE + int.from_bytes(turns[i : i + SIZE], "big")) % PRIME
    return key


def _bytes(key: int) -> bytes:
    return key.to_bytes(SIZE, "big")


def _pack(piece: int):
    """Pieces of each conversation's turns in their order; seq orders the pieces of a conversation, also across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        conv, digests, chars = None, [], []
        out: list[tuple] = []

        def close():
            nonlocal seq
            if digests:
                turns = b"".join(digests)
                out.append((conv, seq, len(digests), turns, np.array(chars, np.int32).tobytes(), _bytes(extended(0, turns))))
                seq += 1
                digests.clear()
                chars.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "seq", "n", "turns", "chars", "total"])

        for batch in batches:
            for c, d, n in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("chars").to_pylist(), strict=True):
                if c != conv or len(digests) == piece:
                    close()
                    conv = c
                digests.append(d)
                chars.append(n)
            if len(out) >= 1000:
                yield batch_of(out)
                out.clear()
        close()
        if out:
            yield batch_of(out)

    return run


_STATE = "conv_id long, seq long, key binary, depth long, skip int, base binary, base_chars binary, last boolean"


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the key and depth at which it starts and how many of its turns the opening replaces; pieces come in order."""
    key = 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            h, n = r["h"], r["n"]
            skip = max(0, min(h - r["first"], n))
            base = base_chars = None
            if r["first"] == 0:
                base, base_chars = (r["base"] or b"")[: h * SIZE], (r["base_chars"] or b"")[: h * 4]
                depth, key = len(base) // SIZE, extended(1, base)
                opening = depth
            else:
                opening = len((r["base"] or b"")[: h * SIZE]) // SIZE
                depth = opening + max(0, r["first"] - h)
            out.append((r["conv_id"], r["seq"], _bytes(key), depth, skip, base, base_chars, r["first"] + n == r["total_n"]))
            own = n - skip
            rest = int.from_bytes(r["total"], "big") - extended(0, r["head"][: skip * SIZE]) * POWERS[own]
            key = (key * POWERS[own] + rest) % PRIME
        if out:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
            names = [x.split()[0] for x in _STATE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _path(r: dict) -> Iterator[tuple[int, int, int | None, int]]:
    """(key, depth, parent's key, length of the last text) of the nodes that a piece reaches, those of the opening with the first."""
    key, depth = int.from_bytes(r["key"], "big"), r["depth"]
    if r["base"] is not None:
        at, up = 1, None
        yield at, 0, None, 0
        chars = np.frombuffer(r["base_chars"], np.int32).tolist()
        for d in range(depth):
            up, at = at, extended(at, r["base"][d * SIZE : (d + 1) * SIZE])
            yield at, d + 1, up, chars[d]
    chars = np.frombuffer(r["chars"], np.int32).tolist()
    turns = r["turns"]
    for i in range(r["skip"], r["n"]):
        up, key = key, (key * BASE + int.from_bytes(turns[i * SIZE : (i + 1) * SIZE], "big")) % PRIME
        depth += 1
        yield key, depth, up, chars[i]


_PARTIAL = "key binary, depth long, parent binary, chars int, n long, least long, ends array<long>"


def _partial(most: int, longest: int):
    """Partial tries. Conversations come in the order of their ids, so each end list ascends and follows those emitted before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: dict[int, list] = {}

        def table_of(items) -> pa.RecordBatch:
            columns = zip(*((_bytes(k), d, None if up is None else _bytes(up), c, n, least, ends) for k, (d, up, c, n, least, ends) in items), strict=True)
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PARTIAL.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                node = None
                conv = r["conv_id"]
                for key, depth, up, chars in _path(r):
                    node = trie.get(key)
                    if node is None:
                        node = trie[key] = [depth, up, chars, 0, conv, []]
                    node[3] += 1
                    node[4] = min(node[4], conv)
                if r["last"]:
                    if node is None:  # the piece is all opening: its node is that at which it starts
                        node = trie.setdefault(key := int.from_bytes(r["key"], "big"), [r["depth"], None, 0, 0, conv, []])
                    node[5].append(conv)
                    if len(node[5]) == longest:
                        yield table_of([(key, [node[0], node[1], node[2], 0, conv, node[5]])])
                        node[5] = []
                if len(trie) >= most:
                    yield table_of(trie.items())
                    trie = {}
        if trie:
            yield table_of(trie.items())

    return run


def _passed(most: int):
    """What conversations pass to the nodes above their own, combined by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}

        def table_of(items) -> pa.RecordBatch:
            columns = zip(*((_bytes(k), s, n) for k, (s, n) in items), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["key", "saved", "leaves"])

        for batch in batches:
            for r in batch.to_pylist():
                for key, depth, _, _ in _path(r):
                    if depth >= r["own"]:
                        break
                    if (at := sums.get(key)) is None:
                        at = sums[key] = [0, 0]
                    at[0] += r["chain_saved"]
                    at[1] += r["chain_leaves"]
                if len(sums) >= most:
                    yield table_of(sums.items())
                    sums = {}
        if sums:
            yield table_of(sums.items())

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's ids, whose lists come in order; the hash takes one list at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ends)).encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def pieces(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Pieces of at most PIECE turns with their turns' digests, written: conv_id, seq, n, turns, chars, total."""
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", F.unhex(F.substring(F.sha2(said, 256), 1, 2 * SIZE)).alias("digest"), F.length("text").alias("chars"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("place")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars")
    return materialize(dealt.mapInArrow(_pack(PIECE), "conv_id long, seq long, n int, turns binary, chars binary, total binary"), "turn-pieces")


def rebuilt(parts: DataFrame, span: int = SPAN) -> DataFrame:
    """Pieces with where they start once conversation c opens with the first crc32(c) % HEADS turns of c - c % span, written."""
    own = W.partitionBy("conv_id")
    slim = parts.select("conv_id", "seq", "n", "total", F.substring("turns", 1, HEADS * SIZE).alias("head"), F.substring("chars", 1, HEADS * 4).alias("head_chars"))
    slim = slim.withColumn("first", F.sum("n").over(own.orderBy("seq")) - F.col("n")).withColumn("total_n", F.sum("n").over(own))
    slim = materialize(slim, "piece-places")
    some = slim.where(F.col("first") < HEADS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "head", "head_chars"))).alias("heads"))  # at most HEADS
    strung = lambda c: F.aggregate("heads", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x[c]))
    heads = some.select(F.col("conv_id").alias("opening"), strung("head").alias("base"), strung("head_chars").alias("base_chars"))
    conv = F.col("conv_id")
    asked = slim.where("first = 0").select(conv, (conv - conv % span).alias("opening"), (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    openings = asked.join(heads, "opening", "left").select("conv_id", "h", "base", "base_chars")
    met = slim.select("conv_id", "seq", "n", "total", "head", "first", "total_n").join(openings, "conv_id")
    starts = met.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_starts, _STATE)
    whole = parts.select("conv_id", "seq", "n", "turns", "chars").join(starts, ["conv_id", "seq"])
    return materialize(whole, "rebuilt")


def trie(convs: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, one row for each node with its sums: the output columns of `prefix_trie`."""
    ordered = convs.repartitionByRange("conv_id", "seq").sortWithinPartitions("conv_id", "seq")
    partial = materialize(ordered.mapInArrow(_partial(NODES, ENDS), _PARTIAL), "partial-tries")
    # A list that was emitted alone has no members; a piece that is all opening names its node without its parent.
    merged = partial.groupBy("key").agg(F.min("depth").alias("depth"), F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
    merged = materialize(merged, "merged-trie")
    children = merged.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    upper = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = materialize(merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    nodes = materialize(nodes.join(upper, "parent", "left"), "trie-nodes")

    saved, leaf, block = (F.col("n_convs") - 1) * F.col("chars"), F.when(F.col("n_children") == 0, 1).otherwise(0), F.floor(F.col("depth") / PIECE)
    own = nodes.select("key", "conv_id", "depth", saved.alias("saved"), leaf.cast("long").alias("leaves"), block.alias("block"))
    blocks = own.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.min("depth").alias("own"))
    deeper = W.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = materialize(blocks.withColumns({c: F.coalesce(F.sum(x).over(deeper), F.lit(0)) for c, x in (("below_s", "s"), ("below_l", "l"))}), "chain-blocks")
    within = W.partitionBy("conv_id", "block").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    chain = own.withColumns({c: F.sum(c).over(within) for c in ("saved", "leaves")}).join(blocks, ["conv_id", "block"])
    chain = chain.select("key", (F.col("saved") + F.col("below_s")).alias("saved"), (F.col("leaves") + F.col("below_l")).alias("leaves"))

    chains = blocks.groupBy("conv_id").agg(F.sum("s").alias("chain_saved"), F.sum("l").alias("chain_leaves"), F.min("own").alias("own")).where("own > 0 AND (chain_saved <> 0 OR chain_leaves <> 0)")
    passed = convs.join(chains, "conv_id").where((F.col("depth") < F.col("own")) | F.col("base").isNotNull()).mapInArrow(_passed(NODES), "key binary, saved long, leaves long")
    sums = chain.unionByName(passed).groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    lists = partial.where(F.size("ends") > 0).select("key", "ends").withColumn("head", F.get("ends", F.lit(0)))
    ends = lists.repartition("key").sortWithinPartitions("key", "head").select("key", "ends").mapInArrow(_digests, "key binary, ends_sha256 string")
    out = nodes.join(sums, "key").join(ends, "key", "left")
    number: dict[str, Column] = {c: F.col(c).cast("long") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
    return out.select(*[v.alias(k) for k, v in number.items()], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    Turns stand in the order of their numbers, null first; those of the same number in the order of the digests of their role
    and text, so equal rows are turns like others. A null role or text is empty. Rows without a conversation have no part;
    without any other there are no nodes. A conversation of any length is cut into pieces, a text is read for its digest
    and length only, and only the four named columns are read, so others may have any name.

    No group is gathered: members and sums are combined in each task before they are merged, and the ids that end at a node
    are hashed one list at a time. The one task that hashes a node's list reads eight bytes for each conversation that ends there.
    """
    return trie(rebuilt(pieces(df, conv, turn, role, text)))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each opening with turns of the first of its hundred."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda z: 0::BIGINT)), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"""
OP12 = f"""WITH s AS (SELECT conv_id AS c, turn, coalesce(text, '') AS x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
 t AS (SELECT c, x, g, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS i FROM s),
 ids AS (SELECT c, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
 o AS (SELECT ids.c, h, count(b.i) AS m FROM ids LEFT JOIN t b ON b.c = ids.c - ids.c % {SPAN} AND b.i <= h GROUP BY 1, 2),
 p AS (SELECT ids.c, b.i AS d, b.x, b.g FROM ids JOIN t b ON b.c = ids.c - ids.c % {SPAN} AND b.i <= h UNION ALL SELECT t.c, t.i - h + m, x, g FROM t JOIN o ON o.c = t.c WHERE t.i > h),
 q AS (SELECT c, d, x, md5(list(g) OVER (PARTITION BY c ORDER BY d)::VARCHAR) AS k FROM p UNION ALL SELECT c, 0, '', 'root' FROM ids),
 u AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM q),
 n AS (SELECT k, d, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, length(min(x)) AS chars FROM u GROUP BY k, d),
 kids AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
 ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS e FROM (SELECT c, max_by(k, d) AS k FROM q GROUP BY c) GROUP BY k),
 below AS (SELECT q.k, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (kids.up IS NULL) AS leaves FROM n LEFT JOIN kids ON kids.up = n.k JOIN q ON q.c = n.conv_id AND q.d <= n.d GROUP BY q.k)
 SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
 FROM n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.up = n.k LEFT JOIN n a ON a.k = n.up LEFT JOIN ends ON ends.k = n.k"""

QUERIES = {"op12_trie": op12_trie}
ORACLE = {"op12_trie": OP12}
