"""Dual-tree Lloyd: k-means rounds that compare nodes of a cover tree over vectors with nodes of one over centroids.

The cover trees over vectors are built once, one for each block of a scan task, and written. In each round a tree over the
centroids is built, and pairs of nodes are pruned by bounds of their distance; a node of vectors that has one centroid left
takes it whole. Pairs of leaves are compared in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, table
from geoloom.llm.vectors import ids_of, rows_of, scaled, usable

BLOCK = 2048  # vectors of a tree
PAIRS = 1 << 16  # pairs of nodes whose distances are computed at a time
SCALE, DIM, CLUSTERS, ROUNDS = 64, 64, 16, 3

_TREES = "n int, ids binary, there binary, points binary, nodes int, center binary, radius binary, low binary, high binary, first binary, children binary"


def squared_distances(points: np.ndarray) -> np.ndarray:
    """Between all rows of a matrix of whole numbers."""
    p = (points - points[0]).astype(float)
    norms = (p * p).sum(axis=1)
    if norms.max() < 1 << 50:  # all terms are whole numbers that a double holds
        return norms[:, None] + norms[None, :] - 2 * (p @ p.T)
    return np.stack([((p - x) ** 2).sum(axis=1) for x in p])


class CoverTree:
    """A cover tree over the rows of a matrix of whole numbers.

    Points are entered farthest first; one at distance d from those before it belongs to all levels i with 2 ** i < d, and
    its parent is the nearest point of the level above its highest. So points of a level are farther apart than 2 ** i,
    and each is within 2 ** (i + 1) of its parent. Equal points share a leaf. order: the rows in the order of the tree, in
    which a node's rows are those from low to high; radius: the greatest distance of a node's centre to its rows.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        d = squared_distances(points)
        entered, gaps, near = [0], [np.inf], d[0].copy()
        owner = np.zeros(n, np.int64)
        distinct = ~(points == points[0]).all(axis=1)
        near[~distinct] = 0.0
        while distinct.any():
            j = int(np.where(distinct, near, -1.0).argmax())
            entered.append(j)
            gaps.append(float(np.sqrt(max(near[j], 1.0))))
            same = distinct & (points == points[j]).all(axis=1) if (d[j][distinct] < 0.5).sum() > 1 else np.arange(n) == j
            owner[same] = j
            distinct &= ~same
            near = np.minimum(near, d[j])
        order = np.array(entered)
        level = np.ceil(np.log2(np.array(gaps[1:]))).astype(int) - 1 if len(entered) > 1 else np.empty(0, int)
        level = np.minimum.accumulate(level) if len(level) else level
        below: dict[int, dict[int, list[int]]] = {}  # point -> level -> its children that enter there
        for i in np.unique(level).tolist():
            new = order[1:][level == i]
            upper = order[: 1 + int((level > i).sum())]
            parents = upper[d[np.ix_(new, upper)].argmin(axis=1)]
            for q, parent in zip(new.tolist(), parents.tolist(), strict=True):
                below.setdefault(parent, {}).setdefault(i, []).append(q)
        copies: dict[int, list[int]] = {}
        for row in range(n):
            copies.setdefault(int(owner[row]), []).append(row)
        self._lay(d, copies, {q: sorted(g.items(), reverse=True) for q, g in below.items()})

    def _lay(self, d: np.ndarray, copies: dict, below: dict) -> None:
        """Numbers the nodes by breadth, then their rows by depth. A node is a point from one of its levels downward."""
        nodes, first, children = [(0, 0)], [], []
        at = 0
        while at < len(nodes):
            q, g = nodes[at]
            groups = below.get(q, [])
            if g < len(groups):
                first.append(len(nodes))
                nodes.append((q, g + 1))
                nodes.extend((x, 0) for x in groups[g][1])
                children.append(len(nodes) - first[-1])
            else:
                first.append(0)
                children.append(0)
            at += 1
        low, high = [0] * len(nodes), [0] * len(nodes)
        order: list[int] = []
        todo = [(0, False)]
        while todo:
            v, closed = todo.pop()
            if closed:
                high[v] = len(order)
                continue
            low[v] = len(order)
            if not children[v]:
                order.extend(copies[nodes[v][0]])
                high[v] = len(order)
                continue
            todo.append((v, True))
            todo.extend((c, False) for c in range(first[v] + children[v] - 1, first[v] - 1, -1))
        self.order = np.array(order)
        self.center = np.array([q for q, _ in nodes])
        self.radius = np.array([np.sqrt(d[q, self.order[a:b]].max()) if c else 0.0 for (q, _), a, b, c in zip(nodes, low, high, children, strict=True)])
        self.low, self.high, self.first, self.children = (np.array(x) for x in (low, high, first, children))
        place = np.empty(len(order), np.int64)
        place[self.order] = np.arange(len(order))
        self.center = place[self.center]  # in the order of the tree


class Nodes:
    """A tree as it is searched: its points in the order of the tree, and its nodes."""

    def __init__(self, points: np.ndarray, center, radius, low, high, first, children):
        self.points, self.center, self.radius, self.low, self.high, self.first, self.children = points, center, radius, low, high, first, children

    @classmethod
    def over(cls, points: np.ndarray) -> tuple[Nodes, np.ndarray]:
        t = CoverTree(points)
        return cls(points[t.order], t.center, t.radius, t.low, t.high, t.first, t.children), t.order


def _descended(tree: Nodes, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of some nodes, and the place of each one's parent among them."""
    many = tree.children[nodes]
    parent = np.repeat(np.arange(len(nodes)), many)
    return tree.first[nodes][parent] + np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many), parent


def assign(tree: Nodes, centroids: Nodes, numbers: np.ndarray) -> tuple[np.ndarray, int]:
    """For each vector in the order of the tree the number of its nearest centroid (ties: the smaller), and the pairs compared.

    numbers: the number of each centroid in the order of its tree.
    """
    cluster = np.full(len(tree.points), -1, np.int64)
    points, centres = tree.points.astype(float), centroids.points.astype(float)
    leaf_c = centroids.children == 0
    number = np.array([numbers[a:b].min() if leaf else -1 for a, b, leaf in zip(centroids.low, centroids.high, leaf_c, strict=True)])
    bound = np.full(len(tree.low), np.inf)
    v, c, compared = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    while len(v):
        compared += len(v)
        gap = np.empty(len(v))
        for s in range(0, len(v), PAIRS):
            diff = points[tree.center[v[s : s + PAIRS]]] - centres[centroids.center[c[s : s + PAIRS]]]
            gap[s : s + PAIRS] = np.sqrt((diff * diff).sum(axis=1))
        # A node's centre is a centroid itself, so no vector of v is farther than this from some centroid.
        np.minimum.at(bound, v, gap + tree.radius[v])
        keep = gap - tree.radius[v] - centroids.radius[c] <= bound[v] * (1 + 1e-9) + 1e-6
        v, c = v[keep], c[keep]
        nodes, at = np.unique(v, return_inverse=True)
        many = np.bincount(at)
        only = (many == 1)[at] & leaf_c[c]
        for node, one in zip(v[only].tolist(), c[only].tolist(), strict=True):
            cluster[tree.low[node] : tree.high[node]] = number[one]
        v, c, at = v[~only], c[~only], at[~only]
        wide = np.zeros(len(nodes))
        np.maximum.at(wide, at, centroids.radius[c])
        open_c = np.zeros(len(nodes), bool)
        np.logical_or.at(open_c, at, ~leaf_c[c])
        leaf_v = tree.children[nodes] == 0
        final = (leaf_v & ~open_c)[at]
        if final.any():
            nv, nc = v[final], c[final]
            exact = np.empty(len(nv), np.int64)
            for s in range(0, len(nv), PAIRS):
                diff = tree.points[tree.center[nv[s : s + PAIRS]]].astype(np.int64) - centroids.points[centroids.center[nc[s : s + PAIRS]]]
                exact[s : s + PAIRS] = (diff * diff).sum(axis=1)
            order = np.lexsort((number[nc], exact, nv))
            head = order[np.r_[True, nv[order][1:] != nv[order][:-1]]]
            for node, one in zip(nv[head].tolist(), nc[head].tolist(), strict=True):
                cluster[tree.low[node] : tree.high[node]] = number[one]
        split_c = (open_c & (leaf_v | (wide >= tree.radius[nodes])))[at]
        rest = ~final
        go_c, stay = rest & split_c & ~leaf_c[c], rest & split_c & leaf_c[c]
        child, parent = _descended(centroids, c[go_c])
        next_v, next_c = [v[go_c][parent], v[stay]], [child, c[stay]]
        go_v = rest & ~split_c
        child, parent = _descended(tree, v[go_v])
        np.minimum.at(bound, child, bound[v[go_v]][parent])
        v, c = np.concatenate([*next_v, child]), np.concatenate([*next_c, c[go_v][parent]])
    return cluster, compared


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, waiting = [], 0
    for batch in batches:
        ids, there = ids_of(batch.column("id"))
        for at, rows in rows_of(batch.column("v")):
            while len(at):
                m = most - waiting
                held.append((ids[at[:m]], there[at[:m]], rows[:m].astype(np.int32)))
                waiting += len(at[:m])
                at, rows = at[m:], rows[m:]
                if waiting == most:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, waiting = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _plant(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _TREES.split(", ")]
        kinds = [pa.int32() if x.split()[1] == "int" else pa.binary() for x in _TREES.split(", ")]
        for ids, there, rows in _blocks(batches, block):
            t = CoverTree(rows.astype(np.int64))
            parts = [ids[t.order], there[t.order], rows[t.order], *(x.astype(np.int32) if x.dtype.kind == "i" else x for x in (t.center, t.radius, t.low, t.high, t.first, t.children))]
            raw = [np.ascontiguousarray(x).tobytes() for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([len(ids), *raw[:3], len(t.low), *raw[3:]], kinds, strict=True)], names)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, Nodes]]:
    for batch in batches:
        for r in range(batch.num_rows):
            one = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            numbers = {c: np.frombuffer(one[c], float if c == "radius" else np.int32) for c in ("center", "radius", "low", "high", "first", "children")}
            points = np.frombuffer(one["points"], np.int32).reshape(one["n"], dim)
            yield np.frombuffer(one["ids"], np.int64), np.frombuffer(one["there"], np.bool_), Nodes(points, **numbers)


def _sums(centroids: np.ndarray):
    """Number and sums of the vectors of each centroid, of all trees of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        tree_c, numbers = Nodes.over(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, _, tree in _trees(batches, dim):
            cluster, _ = assign(tree, tree_c, numbers)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, tree.points)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _labels(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_c, numbers = Nodes.over(centroids)
        for ids, there, tree in _trees(batches, centroids.shape[1]):
            cluster, _ = assign(tree, tree_c, numbers)
            diff = tree.points.astype(np.int64) - centroids[cluster]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~there), pa.array(cluster.astype(np.int32)), pa.array((diff * diff).sum(axis=1))], ["id", "cluster", "distance"])

    return run


def lloyd(df: DataFrame, id_col: str, vector: str, start: Column, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, and the centroids.

    Kept are vectors of exactly `dim` components, none null or non-finite; they become floor(scale * x), held within
    vectors.LIMIT. The first centroids are the k kept vectors with the least `start` (ties: the lesser vector; a null last),
    fewer if there are not as many. A null id, repeated rows and equal vectors are vectors like others; without any
    there are no rows. Only the named columns are read, so others may have any name.

    Each round's sums come to the driver: at most k rows of `dim` numbers, of tasks that each send as many.
    """
    kept = df.where(usable(vector) & (F.size(vector) == dim)).select(F.col(id_col).cast("long").alias("id"), start.alias("start"), scaled(vector, scale).alias("v"))
    first = kept.orderBy(F.col("start").asc_nulls_last(), "v").limit(k).select("v").collect()
    trees = materialize(kept.select("id", "v").mapInArrow(_plant(BLOCK), _TREES), "cover-trees")
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    if not first:
        return trees.selectExpr("CAST(NULL AS LONG) AS id", "0 AS cluster", "0L AS distance"), centroids
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
        each = sums.select("cluster", "n", F.posexplode("total").alias("i", "x"))
        found = each.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
        for r in found:
            centroids[r.cluster, r.i] = int(r.x) // r.n
    return materialize(trees.mapInArrow(_labels(centroids), "id long, cluster int, distance long"), "clusters"), centroids


def op11_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's cluster after three rounds from 16 hashed starts, its squared distance, and the inertias."""
    rows = table(spark, sf_dir, "embeddings")
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    labels, centroids = lloyd(rows, "vec_id", "embedding", start)
    inertia = {r.cluster: r.inertia for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    whole = lambda x: F.lit(min(int(x), (1 << 63) - 1)).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return labels.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of([whole(inertia.get(i, 0)) for i in range(len(centroids))] or [whole(0)]).alias("cluster_inertia"),
        whole(sum(inertia.values())).alias("inertia"),
        of([F.lit(d) for d in digests] or [F.lit("")]).alias("centroid_sha256"),
    )


_NEAREST = "SELECT vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT vec_id, c.j, list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c) AS d FROM v, c{} c) GROUP BY vec_id"


def _round(i: int) -> str:
    means = f"SELECT j, list(m ORDER BY i) AS c FROM (SELECT a.j, i, floor(sum(v[i]) / count(*)) AS m FROM a{i} a JOIN v USING (vec_id), range(1, {DIM + 1}) t(i) GROUP BY 1, 2) GROUP BY j"
    return f"a{i} AS ({_NEAREST.format(i)}), m{i} AS ({means}), c{i + 1} AS (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j)"


OP11 = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {CLUSTERS}), {", ".join(_round(i) for i in range(ROUNDS))}, a AS ({_NEAREST.format(ROUNDS)})
 SELECT vec_id, a.j::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(list_aggregate(list_transform(c.c, lambda x: x::BIGINT::VARCHAR), 'string_agg', ',')) AS centroid_sha256 FROM a JOIN c{ROUNDS} c ON c.j = a.j"""

QUERIES = {"op11_dualtree": op11_dualtree}
ORACLE = {"op11_dualtree": OP11}
