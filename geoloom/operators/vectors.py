"""Nearest neighbours by cosine: exhaustive, and over an inverted-file index.

Vectors travel in blocks. Groups of the row blocks of a list meet shares of the query blocks that ask for it, so that no list
and no query set is gathered in one place; a task holds one group and one share, and passes on the k best of each query.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.sources.written import written

BLOCK = 2048  # rows compared with a block of queries at a time
ASKED = 256  # queries of a block
GROUP = 16  # row blocks of a group
SHARE = 64  # query blocks that meet a group at a time
PIECE = 64  # queries scored at a time
SAMPLE = 64  # rows for each list that the index is fitted on, at most
LISTS = 4096  # lists of an index, at most

_BLOCKS = "list int, dim int, n int, ids binary, vectors binary"


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of a batch, by length; vectors with a null inside are left out."""
    column = batch.column("v")
    starts, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float32)
    whole = np.isfinite(values)
    sizes = np.diff(starts)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        places = starts[at][:, None] + np.arange(n)
        keep = whole[places].all(axis=1)
        if keep.any():
            yield at[keep], values[places[keep]]


def _pack(most: int, listed: bool):
    """Blocks of up to `most` rows (id, v) of one list and length; with lists, rows come in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = defaultdict(list)
        size: dict[tuple[int, int], int] = defaultdict(int)

        def flush(key: tuple[int, int]) -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            n = size.pop(key)
            values = [[key[0]], [key[1]], [n], [ids.tobytes()], [np.ascontiguousarray(rows).tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["list", "dim", "n", "ids", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("list").to_numpy(zero_copy_only=False) if listed else np.zeros(len(ids), np.int32)
            for at, rows in _matrices(batch):
                for number in np.unique(lists[at]).tolist():
                    own = lists[at] == number
                    a, r, key = at[own], rows[own], (int(number), rows.shape[1])
                    while len(a):
                        m = most - size[key]
                        held[key].append((ids[a[:m]], r[:m]))
                        size[key] += len(a[:m])
                        a, r = a[m:], r[m:]
                        if size[key] == most:
                            yield flush(key)
            if listed:
                last = int(lists.max())
                for key in [k for k in held if k[0] < last]:
                    yield flush(key)
        for key in list(held):
            yield flush(key)

    return run


def _score(k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def held(table: pa.Table, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
        column = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        own = column(ids, np.int64)
        return own, _unit(column(vectors, np.float32).reshape(len(own), -1).astype(float))

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if blocks.num_rows and asked.num_rows:
            ids, rows = held(blocks, "ids", "vectors")
            query_ids, queries = held(asked, "q_ids", "q_vectors")
            for at in range(0, len(query_ids), PIECE):
                some = query_ids[at : at + PIECE]
                scores = np.round(queries[at : at + PIECE] @ rows.T, 6) + 0.0
                scores[some[:, None] == ids[None, :]] = -2.0  # a query is not its own neighbour
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(some), -2.0)
                for q, s, bound in zip(some.tolist(), scores, least, strict=True):
                    near = np.flatnonzero((s >= bound) & (s > -2.0))
                    best = near[np.lexsort((ids[near], -s[near]))[:k]]
                    found.append((np.full(len(best), q), ids[best], s[best]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], []]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return run


def _best(blocks: DataFrame, asked: DataFrame, on: list[str], k: int) -> DataFrame:
    """The k best rows of each query among the blocks with which its block agrees in the columns `on`; both sides are written.

    A list's blocks are dealt to groups of about GROUP and meet shares of about SHARE query blocks, fewer where else some
    tasks had none: what a task holds does not grow, and a block is copied once for each share, not for each query block.
    """
    largest = lambda df: df.groupBy(on).count().agg(F.max("count")).first()[0] or 1
    keys, tasks = blocks.select(on).distinct().count() or 1, 2 * blocks.sparkSession.sparkContext.defaultParallelism
    groups = -(-largest(blocks) // GROUP)
    most = largest(asked)
    shares = max(-(-most // SHARE), min(most, -(-tasks // (groups * keys))))
    part = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.select(*on, "ids", "vectors", part("ids", groups).alias("group")).withColumn("share", each(shares))
    right = asked.select(*on, F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), part("ids", shares).alias("share")).withColumn("group", each(groups))
    by = [*on, "group", "share"]
    dealt = lambda df: df.repartition(2 * keys * groups * shares, *by).groupBy(*by)
    scored = dealt(left).cogroup(dealt(right)).applyInArrow(_score(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _named(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, vec_id, score (cosine, 6 places), rank of the k nearest rows of each query, itself excepted, by comparison with all."""
    blocks = written(_named(rows, id_col, vec).mapInArrow(_pack(BLOCK, False), _BLOCKS), "vector-blocks")
    asked = written(_named(queries, id_col, vec).mapInArrow(_pack(ASKED, False), _BLOCKS), "query-blocks")
    return _best(blocks, asked, ["dim"], k)


class VectorIndex:
    """An inverted-file index: coarse centroids, and the rows' blocks in one partition folder for each centroid's list.

    blocks: list, dim, n, ids, vectors, of which a search reads the probed lists' folders only.
    """

    def __init__(self, centroids: np.ndarray, blocks: DataFrame):
        self.centroids, self.blocks = centroids, blocks

    def search(self, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """query_id, vec_id, score, rank of the k nearest rows in the `probes` lists nearest to each query, exactly compared."""
        probed = written(_named(queries, id_col, vec).mapInArrow(_probes(self.centroids, probes), "list int, id long, v array<float>"), "probes")
        wanted = sorted(r.list for r in probed.select("list").distinct().collect())  # at most all lists
        blocks = self.blocks.where(F.col("list").isin(wanted)) if len(wanted) < len(self.centroids) else self.blocks
        dealt = probed.repartitionByRange("list", "id").sortWithinPartitions("list")
        return _best(blocks, written(dealt.mapInArrow(_pack(ASKED, True), _BLOCKS), "query-blocks"), ["list", "dim"], k)


def _probes(centroids: np.ndarray, probes: int):
    """Each row with its `probes` nearest lists, by cosine to nine places; ties: the list of the smaller number."""
    unit = _unit(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _matrices(batch):
                if rows.shape[1] != unit.shape[1]:
                    continue
                scores = np.round(_unit(rows.astype(float)) @ unit.T, 9)
                lists = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                many = lists.shape[1]
                again = np.repeat(at, many)
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column("id").take(pa.array(again)), batch.column("v").take(pa.array(again))], ["list", "id", "v"])

    return run


def _fitted(rows: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    centroids = _unit(start)
    for _ in range(rounds):
        own = np.round(rows @ centroids.T, 9).argmax(axis=1)
        means = np.stack([rows[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centroids)])
        centroids = _unit(means)
    return centroids


def build_index(rows: DataFrame, lists: int, rounds: int = 2, id_col: str = "vec_id", vec: str = "embedding") -> VectorIndex:
    """An index of all rows whose vectors have the commonest length and no null.

    The centroids are fitted by spherical k-means on a sample of at most SAMPLE rows for each list, the rows of least
    hash, starting from the first of them; every row is then put into its list. A list of any size lies in blocks.
    """
    named = _named(rows, id_col, vec)
    sizes = named.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    dim = sizes.dim if sizes else 1
    able = named.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    lists = max(1, min(lists, LISTS))
    least = able.select(F.sha2(F.col("id").cast("string"), 256).alias("h"), "id", "v").orderBy("h", "id").limit(SAMPLE * lists).select("v").collect()
    sample = _unit(np.array([r.v for r in least], float).reshape(len(least), dim))
    centroids = _fitted(sample, sample[:lists], rounds) if len(sample) else np.zeros((1, dim))
    listed = able.mapInArrow(_probes(centroids, 1), "list int, id long, v array<float>")
    dealt = listed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list")
    return VectorIndex(centroids, written(dealt.mapInArrow(_pack(BLOCK, True), _BLOCKS), "vector-index", "list"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (query_id, vec_id) that are among those found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
