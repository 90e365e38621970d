"""Gradient-boosted trees for several classes, trained level by level on histograms that Spark sums.

Each round grows a tree for every class on the softmax's gradients. A level is one pass over the binned rows: a task adds up
gradients by class, node, feature and bin; the sums, and the best split of each node, are taken by grouping and windows. Only
splits come to the driver. Gradients are whole numbers (of 2 ** -SHIFT), so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.sources.written import removed, written

SHIFT = 24


@dataclass
class Tree:
    """Nodes by number: the children of i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of bins ends."""

        def ends(i: int) -> np.ndarray | int:
            f = self.feature[i]
            return i if f < 0 else np.where(bins[:, f] > self.bin[i], ends(2 * i + 2), ends(2 * i + 1))

        return np.broadcast_to(ends(0), len(bins))


@dataclass
class Model:
    """edges: of each feature, the greatest values of its bins but the last; trees: of each round, one for each class."""

    classes: int
    edges: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, side="left") for e, x in zip(self.edges, features.T, strict=True)], axis=1).astype(np.uint8)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out, bins = np.zeros((len(bins), self.classes)), np.asfortranarray(bins)  # a tree reads whole columns
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.nodes(bins)]
        return out


def softmax(raw: np.ndarray) -> np.ndarray:
    p = np.exp(raw - raw.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def gradients(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, classes) gradients and second derivatives of the weighted softmax loss, as whole numbers."""
    p, k = softmax(raw), raw.shape[1]
    g = (p - (np.arange(k) == label[:, None])) * weight[:, None]
    h = p * (1 - p) * weight[:, None] * (k / (k - 1))
    whole = lambda x: np.rint(x * (1 << SHIFT)).astype(np.int64)
    return whole(g), whole(h)


def added(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """The sums of whole numbers x by place, exactly: as doubles where these hold every sum."""
    if len(x) * max(int(np.abs(x).max(initial=0)), 1) < 1 << 53:
        return np.bincount(at, x, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, at, x)
    return out


def _features(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _states(batches: Iterator[pa.RecordBatch], dim: int, classes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """bins, raw scores, labels and weights of the rows, which lie packed: a row of the batch holds some thousands."""
    for batch in batches:
        for bins, raw, label, weight in zip(*(batch.column(c) for c in ("bins", "raw", "label", "weight")), strict=True):
            own = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
            yield np.asfortranarray(own(bins, np.uint8).reshape(-1, dim)), own(raw, float).reshape(-1, classes), own(label, np.int32), own(weight, float)


def _packed(bins: np.ndarray, raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    kinds = zip((bins, raw, label, weight), (np.uint8, float, np.int32, float), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for x, kind in kinds], ["bins", "raw", "label", "weight"])


def _histograms(model: Model, trees: list[Tree], level: int, bins_of: int):
    """g, h, n by class, node of the level, feature and bin, of all rows of a task."""
    first, many, dim, k = (1 << level) - 1, 1 << level, len(model.edges), model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = np.zeros((3, k, many, dim, bins_of), np.int64), many * bins_of
        for bins, raw, label, weight in _states(batches, dim, k):
            g, h = gradients(raw, label, weight)
            for c, tree in enumerate(trees):
                node = tree.nodes(bins) - first
                here = node >= 0
                every = bool(here.all())
                place = (node if every else node[here]) * bins_of
                gs, hs = (x[:, c] if every else x[here, c] for x in (g, h))
                doubles = [x.astype(float) if len(x) * max(int(np.abs(x).max(initial=0)), 1) < 1 << 53 else None for x in (gs, hs)]
                for f in range(dim):
                    at = place + (bins[:, f] if every else bins[here, f])
                    for i, (x, d) in enumerate(zip((gs, hs), doubles, strict=True)):
                        found = added(at, x, size) if d is None else np.bincount(at, d, size).astype(np.int64)
                        sums[i, c, :, f] += found.reshape(many, bins_of)
                    sums[2, c, :, f] += np.bincount(at, minlength=size).reshape(many, bins_of)
        some = np.flatnonzero(sums[2])
        place = np.unravel_index(some, (k, many, dim, bins_of))
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in place), *(pa.array(s.ravel()[some]) for s in sums)], ["class", "node", "feature", "bin", "g", "h", "n"])

    return run


def _splits(sums: DataFrame, l2: float, least: int) -> list:
    """For each class and node: its sums g and h, and its best split (feature, bin, sums gl and hl of its left), if any gains."""
    sums = sums.groupBy("class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
    order = W.partitionBy("class", "node", "feature")
    upto = order.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = sums.select("class", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(order).alias(c) for c in "ghn"])
    scale = float(1 << SHIFT)
    score = lambda g, h: (g / scale) * (g / scale) / (h / scale + l2)
    col = F.col
    gain = score(col("gl"), col("hl")) + score(col("g") - col("gl"), col("h") - col("hl")) - score(col("g"), col("h"))
    able = (col("nl") >= least) & (col("n") - col("nl") >= least)
    best = F.max(F.when(able & (gain > 0), F.struct(gain.alias("gain"), (-col("feature")).alias("feature"), (-col("bin")).alias("bin"), "gl", "hl"))).alias("best")
    return both.groupBy("class", "node").agg(F.max("g").alias("g"), F.max("h").alias("h"), best).collect()  # classes x nodes


def _moved(trees: list[Tree], dim: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, raw, label, weight in _states(batches, dim, classes):
            yield _packed(bins, raw + np.stack([t.value[t.nodes(bins)] for t in trees], axis=1), label, weight)

    return run


_ROWS = "bins binary, raw binary, label binary, weight binary"


def fit(rows: DataFrame, classes: int, rounds: int = 300, depth: int = 5, bins: int = 64, rate: float = 0.08, l2: float = 1.0, least: int = 40) -> Model:
    """A model from rows (features: array<double>, label: 0 to classes - 1, weight), all of them.

    Bins end at the features' quantiles. Rows without a label, or with a missing feature, do not teach. Trees grow level
    by level to `depth`; a split leaves `least` rows on either side.
    """
    able = rows.where(F.col("label").isNotNull() & ~F.exists("features", lambda x: x.isNull() | F.isnan(x)))
    dim = able.select(F.max(F.size("features"))).first()[0] or 0
    shares = [(i + 1) / bins for i in range(bins - 1)]
    if not dim:
        return Model(classes, [])
    cuts = able.select(*[F.percentile_approx(F.get("features", F.lit(i)), shares, 10000).alias(f"f{i}") for i in range(dim)]).first()
    model = Model(classes, [np.unique(np.array(c, float)) for c in cuts])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                yield _packed(model.bins(_features(batch.column("features"), dim)), np.zeros((n, classes)), batch.column("label").to_numpy(), batch.column("weight").to_numpy())

    plain = able.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"))
    state = written(plain.mapInArrow(start, _ROWS), "boost-rows")
    for _ in range(rounds):
        trees = [Tree.blank(depth) for _ in range(classes)]
        value = lambda g, h: -rate * (g / (1 << SHIFT)) / (h / (1 << SHIFT) + l2)
        for level in range(max(depth, 1)):  # a split's sums are its children's, so the last level needs no pass
            sums = state.mapInArrow(_histograms(model, trees, level, bins), "class int, node int, feature int, bin int, g long, h long, n long")
            grown = False
            for r in _splits(sums, l2, least):
                tree, node = trees[r["class"]], r.node + (1 << level) - 1
                tree.value[node] = value(r.g, r.h)
                if level < depth and r.best is not None:
                    tree.feature[node], tree.bin[node] = -r.best.feature, -r.best.bin
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = value(r.best.gl, r.best.hl), value(r.g - r.best.gl, r.h - r.best.hl)
                    grown = True
            if not grown:
                break
        model.trees.append(trees)
        after = written(state.mapInArrow(_moved(trees, dim, classes), _ROWS), "boost-rows")
        removed(rows.sparkSession, state)
        state = after
    removed(rows.sparkSession, state)
    return model


def predict(df: DataFrame, model: Model, features: str = "features") -> DataFrame:
    """df with `p`, the probability of each class, and `predicted`; both null where a feature is missing."""
    dim, names = len(model.edges), df.columns
    missing = F.col(features).isNull() | (F.size(features) != dim) | F.exists(features, lambda x: x.isNull() | F.isnan(x))
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.when(missing, F.lit(None)).otherwise(F.col(features)).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
            found = softmax(model.raw(model.bins(_features(batch.column("x").drop_null(), dim)))) if there.any() else np.zeros((0, model.classes))
            starts = np.concatenate([[0], np.cumsum(there * model.classes)]).astype(np.int32)
            p = pa.ListArray.from_arrays(pa.array(starts, mask=np.append(~there, False)), pa.array(found.ravel()))
            best = np.zeros(batch.num_rows, np.int32)
            best[there] = found.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), p, pa.array(best, mask=~there)], ["row", "p", "predicted"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("predicted", T.IntegerType())]))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "p", "predicted")


def evaluation(judged: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """label, predicted, n (the confusion matrix), with accuracy and macro-F1 of all rows that have both."""
    cells = judged.select(label.alias("label"), predicted.alias("predicted")).where("label IS NOT NULL AND predicted IS NOT NULL").groupBy("label", "predicted").agg(F.count("*").alias("n"))
    both = cells.select(F.explode(F.array(F.struct(F.col("label").alias("c"), F.col("n").alias("t"), F.lit(0).alias("s"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"), F.col("n").alias("s"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    each = both.groupBy("c").agg(*[F.sum(c).alias(c) for c in ("t", "s", "hit")]).select((2 * F.col("hit") / (F.col("t") + F.col("s"))).alias("f1"), "hit", "t")
    whole = each.agg((F.sum("hit") / F.sum("t")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return cells.crossJoin(F.broadcast(whole))  # one row
