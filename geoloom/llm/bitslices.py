"""Exact top-k search by inner product over a bit-sliced index.

The index holds, for each block of rows, every attribute in VALUE_BITS bit slices: bitmaps with one bit for each row. A
query's weights, quantised too, are added up from the slices with carry-save adders on whole bitmaps, which gives the
approximate scores of all rows as slices. Descending from the most significant slice, the k-th greatest is found by
counting bits; the rows within the error bound of it are the boundary, whose scores are computed exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, table
from geoloom.llm.vectors import ids_of, rows_of, scaled, usable

BLOCK = 16384  # rows of an index block
QUERIES_AT_ONCE = 64  # queries of a block
SHARE = 512  # query blocks that meet an index block in one group
VALUE_BITS, WEIGHT_BITS = 6, 7
SCALE, TOP, EVERY = 256, 5, 50

_INDEX = "dim int, n int, ids binary, there binary, rows binary, shifts binary, slices binary"
_QUERY = "dim int, n int, ids binary, rows binary"


def slices_of(values: np.ndarray, bits: int = VALUE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, slices) of (rows, attributes): slice b of an attribute holds bit b of (value >> shift) + half, a bit a row.

    The shift is the least with which all the attribute's values fit, so that one odd attribute leaves the others fine.
    """
    n, dim = values.shape
    half = 1 << (bits - 1)
    low, high = values.min(axis=0).astype(np.int64), values.max(axis=0).astype(np.int64)
    shifts = np.zeros(dim, np.int64)
    while (wide := ((low >> shifts) < -half) | ((high >> shifts) >= half)).any():
        shifts[wide] += 1
    codes = ((values >> shifts) + half).astype(np.uint8)
    width = -(-n // 64) * 8
    out = np.zeros((dim, bits, width), np.uint8)
    for b in range(bits):
        out[:, b, : -(-n // 8)] = np.packbits((codes >> b) & 1, axis=0, bitorder="little").T
    return shifts, out.view(np.uint64)


def _added(parts: dict[int, np.ndarray], width: int) -> list[np.ndarray]:
    """The slices of the sum of bitmaps, each counting 2 ** position: three of a position become one and a carry."""
    out, carried, position, last = [], [], 0, max(parts, default=0)
    while position <= last or carried:
        own = [parts[position]] if position in parts else []
        x = np.concatenate([*own, *carried]) if own or carried else np.zeros((1, width), np.uint64)
        carried = []
        while len(x) > 1:
            m = len(x) // 3
            if m:
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                both = a ^ b
                carried.append((a & b) | (both & c))
                x = np.concatenate([both ^ c, x[3 * m :]])
            else:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
        out.append(x[0])
        position += 1
    return out


def kth_greatest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th greatest value among the rows of a bitmap, which has k at least; from the most significant slice downward."""
    above, equal, value = np.zeros_like(rows), rows, 0
    for b in range(len(slices) - 1, -1, -1):
        ones = equal & slices[b]
        if int(np.bitwise_count(above | ones).sum()) >= k:
            equal, value = ones, value | (1 << b)
        else:
            above, equal = above | ones, equal & ~slices[b]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, least: int) -> np.ndarray:
    """The bitmap of the rows whose value is `least` or more."""
    if least <= 0:
        return rows
    if least >> len(slices):
        return np.zeros_like(rows)
    greater, equal = np.zeros_like(rows), rows
    for b in range(len(slices) - 1, -1, -1):
        if least >> b & 1:
            equal = equal & slices[b]
        else:
            greater, equal = greater | (equal & slices[b]), equal & ~slices[b]
    return greater | equal


class Block:
    """An index block as a task reads it."""

    def __init__(self, dim: int, n: int, ids: bytes, there: bytes, rows: bytes, shifts: bytes, slices: bytes):
        self.n, self.dim = n, dim
        self.ids, self.there = np.frombuffer(ids, np.int64), np.frombuffer(there, np.bool_)
        self.known = int(self.there.sum())  # ids ascend, nulls last
        self.rows = np.frombuffer(rows, np.int32).reshape(n, dim)
        self.shifts = np.frombuffer(shifts, np.int64)
        self.width = -(-n // 64)
        own = np.frombuffer(slices, np.uint64).reshape(dim * VALUE_BITS, self.width)
        self.slices = np.concatenate([own, ~own])  # the complements serve negative weights
        self.all = np.zeros(self.width * 8, np.uint8)
        self.all[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.all = self.all.view(np.uint64)
        self.largest = np.abs(self.rows.astype(np.int64)).max(axis=0, initial=0)
        self.codes = (self.largest >> self.shifts) + 1  # at least any |value >> shift|

    def others(self, query: int) -> np.ndarray:
        """All rows but those with the query's id."""
        first, last = np.searchsorted(self.ids[: self.known], [query, query + 1])
        if first == last:
            return self.all
        mask = np.unpackbits(self.all.view(np.uint8), bitorder="little")
        mask[first:last] = 0
        return np.packbits(mask, bitorder="little").view(np.uint64)

    def boundary(self, weights: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """The bitmap of rows that can be among the k best: the k-th approximate score less what both sides may err."""
        if int(np.bitwise_count(rows).sum()) <= k or not self.dim:
            return rows
        full = weights << self.shifts
        step = max(0, int(np.abs(full).max()).bit_length() - WEIGHT_BITS)
        coarse = (full + ((1 << step) >> 1)) >> step
        lost = int((np.abs(full - (coarse << step)) * self.codes).sum())  # by the weights
        lost += -(-int((np.abs(weights) * ((1 << self.shifts) - 1)).sum()) // 2)  # by the values, about the middle
        chosen: dict[int, list[int]] = defaultdict(list)
        for i in np.flatnonzero(coarse).tolist():
            size, base = abs(int(coarse[i])), i * VALUE_BITS + (len(self.slices) // 2 if coarse[i] < 0 else 0)
            for t in range(size.bit_length()):
                if size >> t & 1:
                    for b in range(VALUE_BITS):
                        chosen[t + b].append(base + b)
        score = _added({p: self.slices[at] for p, at in chosen.items()}, self.width)
        least = kth_greatest(score, rows, k) - (2 * lost >> step) - 1
        return at_least(score, rows, least)

    def best(self, query: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and exact scores of the k best rows, greater scores first, then smaller ids; and the boundary's size."""
        near = self.boundary(weights, self.others(query), k)
        at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        bound = int((np.abs(weights) * self.largest).astype(object).sum()) if self.dim else 0
        if bound < 1 << 53:
            score = (self.rows[at].astype(float) @ weights.astype(float)).astype(np.int64)
        elif bound < 1 << 63:
            score = self.rows[at].astype(np.int64) @ weights
        else:  # beyond a long: the score is the nearest long
            score = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in self.rows[at].astype(object) @ weights.astype(object)], np.int64)
        order = np.lexsort((at, np.invert(score)))[:k]  # places ascend with ids; ~x orders downward without an overflow
        return at[order], score[order], len(at)


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, ids, whether there, rows) of up to `most` rows of one number of components; rows wait until as many are there."""
    held: dict[int, list] = defaultdict(list)
    waiting: dict[int, int] = defaultdict(int)

    def joined(dim: int):
        ids, there, rows = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        waiting[dim] = 0
        order = np.lexsort((ids, ~there))
        return dim, ids[order], there[order], rows[order]

    for batch in batches:
        ids, there = ids_of(batch.column("id"))
        for at, rows in rows_of(batch.column("v")):
            dim = rows.shape[1]
            while len(at):
                m = most - waiting[dim]
                held[dim].append((ids[at[:m]], there[at[:m]], rows[:m].astype(np.int32)))
                waiting[dim] += len(at[:m])
                at, rows = at[m:], rows[m:]
                if waiting[dim] == most:
                    yield joined(dim)
    for dim in list(held):
        yield joined(dim)


def _binary(values: list, schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.binary() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def _index(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, there, rows in _packed(batches, block):
            shifts, slices = slices_of(rows)
            yield _binary([dim, len(ids), *(np.ascontiguousarray(x).tobytes() for x in (ids, there, rows, shifts, slices))], _INDEX)

    return run


def _queries(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, _, rows in _packed(batches, block):
            yield _binary([dim, len(ids), ids.tobytes(), np.ascontiguousarray(rows).tobytes()], _QUERY)

    return run


def _search(k: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    out = pa.schema(list(zip(["query_id", "q_block", "place", "vec_id", "score"], kinds, strict=True)))
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        for r in range(blocks.num_rows if asked.num_rows else 0):  # one block; it is read once for all its queries
            block = Block(*(blocks.column(c)[r].as_py() for c in names))
            for at in range(asked.num_rows):
                n, number, ids, rows = (asked.column(c)[at].as_py() for c in ("q_n", "q_block", "q_ids", "q_rows"))
                queries = np.frombuffer(ids, np.int64)
                weights = np.frombuffer(rows, np.int32).reshape(n, block.dim).astype(np.int64)
                best = [block.best(int(q), w, k) for q, w in zip(queries, weights, strict=True)]
                sizes = [len(x) for x, _, _ in best]
                rows = np.concatenate([x for x, _, _ in best])
                columns = [np.repeat(queries, sizes), np.full(len(rows), number, np.int64), np.repeat(np.arange(n), sizes).astype(np.int32)]
                columns = [*map(pa.array, columns), pa.array(block.ids[rows], mask=~block.there[rows]), pa.array(np.concatenate([x for _, x, _ in best]))]
                found.append(pa.RecordBatch.from_arrays(columns, schema=out))
        return pa.Table.from_batches(found, out)

    return run


def build_index(rows: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """The bit-sliced index of all usable vectors, written: one row for each block of at most BLOCK rows of one scan task."""
    v = rows.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), scaled(vector, scale).alias("v"))
    blocks = v.mapInArrow(_index(BLOCK), _INDEX)
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "bit-slices")


def top_k(index: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows of the index with the greatest integer inner product with each query.

    Rows with the query's own id are no candidates. Equal scores: the smaller id first, a null id last. Vectors that are
    null or hold null or non-finite components take no part, nor do queries without an id; a query meets vectors of
    its own number of components. Repeated query rows count once; an id with several vectors asks for each of
    them. Components are held within LIMIT; a score beyond a long is the nearest long. Only the named columns are read, so
    others may have any name.

    Each index block meets a share of at most SHARE query blocks in one group of a task, which holds that block once and
    these queries. Only the numbers of the index blocks are broadcast, one for each BLOCK rows.
    """
    spark = index.sparkSession
    asked = queries.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), scaled(vector, scale).alias("v")).where("id IS NOT NULL").distinct()
    asked = materialize(asked.mapInArrow(_queries(QUERIES_AT_ONCE), _QUERY).withColumn("q_block", F.monotonically_increasing_id()), "queries")
    blocks, tasks = max(1, index.count()), 4 * spark.sparkContext.defaultParallelism
    shares = max(1, -(-asked.count() // SHARE), -(-tasks // blocks))  # where there are few index blocks, several tasks share the queries of each
    left = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = asked.select("dim", "q_block", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.pmod(F.xxhash64("q_block"), F.lit(shares)).cast("int").alias("share"))
    right = right.join(F.broadcast(index.select("dim", F.col("block").alias("of"))), "dim")
    dealt = lambda df, block: df.repartition(2 * blocks * shares, block, "share").groupBy(block, "share")
    scored = dealt(left, "block").cogroup(dealt(right, "of")).applyInArrow(_search(k), "query_id long, q_block long, place int, vec_id long, score long")
    return _ranked(scored, k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "q_block", "place").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_bitslices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of greatest inner product for each embedding whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(build_index(rows, "vec_id", "embedding"), rows.where(F.col("vec_id") % EVERY == 0))


OP13 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % {EVERY} = 0),
 o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
 SELECT query_id, rank, vec_id, score FROM o WHERE rank <= {TOP}"""

QUERIES = {"op13_bitslices": op13_bitslices}
ORACLE = {"op13_bitslices": OP13}
