"""SimHash near-duplicates: a grid over popcounts of fingerprint segments, then exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of their popcounts. The Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints. Written in unary (one bit for a count
of at least 1, one for 2), an embedding is a 64-bit word too, and the Manhattan distance of two is the number of bits
in which their words differ.

Grid: the 32 coordinates are cut into 6 blocks. Embeddings within Manhattan distance 3 agree on at least 3 whole
blocks, so each distinct fingerprint goes to the 20 grid cells named by the coordinates of 3 blocks, and any pair in
range meets in a cell. In a cell, neighbours are found breadth first: each fingerprint reached is compared with those
not yet reached, first by the Manhattan bound, then by the Hamming distance. So links of a dense group are not
enumerated; a cell yields one edge for each fingerprint that is linked in it, which is all that components need.

Documents similar enough to be copies of each other with changed words may differ in more bits (`similar_texts`): the grid
meets those within the bound first; for the rest, candidates share a band of least hashes of their shingles. All are
verified by the exact similarity of their sets.

Copies share a fingerprint and take part once. Fingerprints and edges stay in DataFrames.

Defined cases: a text without words (null, empty, only white space) has fingerprint zero and is linked like any other;
a text of fewer words than a shingle has one shingle; a null id is never a component's id unless all its ids are null;
repeated rows give repeated results; a text of any length is hashed whole, and a worker holds one such text at a time;
an empty table gives an empty table. Only the named columns are read, and `keep_one` carries all others, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import carried, materialize, restored, table
from geoloom.llm.graph import components

WORDS, SEED, BITS = 3, 42, 3
RUN = 1 << 16  # shingles counted at a time
EVEN = np.uint64(int("01" * 32, 2))
ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = WORDS, seeds: int = 1) -> list[int]:
    """The fingerprint of a text as unsigned numbers of 64 bits: the majority of each bit over its shingles' hashes.

    The first number is of the hashes themselves, further ones of the hashes scrambled with further constants.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return [0] * seeds
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    n = len(parts) - k + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64 * seeds, np.int64)
    for s in range(0, n, RUN):
        e = min(s + RUN, n)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[s:e].tolist(), ends[s + k - 1 : e + k - 1].tolist(), strict=True)], np.uint64)
        every = np.stack([hashes, *(scramble(hashes, i) for i in range(1, seeds))], axis=1)
        counts += np.unpackbits(every.view(np.uint8).reshape(-1, 8 * seeds), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8").tolist()


def scramble(hashes: np.ndarray, i: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprints(df: DataFrame, text: str, keep: list[str], words: int = WORDS, seeds: int = 1) -> DataFrame:
    """The columns `keep` of df and `fp` (and fp1, fp2 ... for more seeds), the fingerprint as signed longs."""
    names = ["fp", *(f"fp{i}" for i in range(1, seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words, seeds) for x in batch.column(1)], np.uint64).reshape(-1, seeds).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i].copy()) for i in range(seeds))], ["kept", *names])

    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))
    return out.select(*[F.col(f"kept.{c}").alias(c) for c in keep], *names)


def embed(fps: np.ndarray) -> np.ndarray:
    """The segments' popcounts in unary: of each two bits, the lower is set for a count of 1 or 2, the upper for 2."""
    low, high = fps & EVEN, (fps >> ONE) & EVEN
    return (low | high) | ((low & high) << ONE)


def cell_masks(agreeing: int) -> list[int]:
    """The bits of each choice of so many of 6 blocks of segments."""
    first, blocks = 0, []
    for n in (5, 5, 5, 5, 6, 6):
        blocks.append(((1 << 2 * n) - 1) << 2 * first)
        first += n
    return [sum(c) for c in combinations(blocks, agreeing)]


def _cells(seeds: int, agreeing: int):
    masks = cell_masks(agreeing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(seeds)]
            for i in range(seeds):
                points = embed(fps[i].view(np.uint64))
                for j, mask in enumerate(masks):
                    cells = (points & np.uint64(mask)).view(np.int64)
                    choice = np.full(len(cells), i * len(masks) + j, np.int8)
                    yield pa.RecordBatch.from_arrays([pa.array(choice), pa.array(cells), *map(pa.array, fps)], ["choice", "cell", *(f"f{k}" for k in range(seeds))])

    return run


def neighbours(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges (places in fps) that join all of a cell's fingerprints that links within `bits` connect, one for each joined.

    fps: (n, seeds). Whatever is reached is compared with what is not yet reached only.
    """
    points = embed(fps)
    edges, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            p = frontier.pop()
            near = np.bitwise_count(points[rest] ^ points[p]).sum(axis=1, dtype=np.int64) <= bits
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[p]).sum(axis=1, dtype=np.int64) <= bits
            if near.any():
                found = rest[near].tolist()
                frontier.extend(found)
                edges.extend((p, x) for x in found)
                rest = rest[~near]
    return edges


SMALL = 8  # fingerprints in a cell up to which its pairs are compared for all cells at once


def _pairs(fps: np.ndarray, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of all small cells: each fingerprint with the next one, then the one after it, and so on."""
    end = np.repeat(starts + sizes, sizes)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    left, right = [], []
    for d in range(1, int(sizes.max(initial=0))):
        inside = at + d < end
        at, end = at[inside], end[inside]
        near = at[np.bitwise_count(points[at] ^ points[at + d]).sum(axis=1, dtype=np.int64) <= bits]
        near = near[np.bitwise_count(fps[near] ^ fps[near + d]).sum(axis=1, dtype=np.int64) <= bits]
        left.append(near)
        right.append(near + d)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(seeds: int, bits: int):
    """Edges from cells that come one behind the other, and may go on in the next batch."""

    def solve(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(fps)]]))
        small = (sizes > 1) & (sizes <= SMALL)
        left, right = _pairs(fps, embed(fps), starts[small], sizes[small], bits)
        edges = [(s + a, s + b) for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True) for a, b in neighbours(fps[s : s + n], bits)]
        more = np.array(edges, np.int64).reshape(-1, 2)
        return np.concatenate([left, more[:, 0]]), np.concatenate([right, more[:, 1]])

    def out(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = solve(key, fps)
        sides = [pa.StructArray.from_arrays([pa.array(fps[x, i].view(np.int64)) for i in range(seeds)], [f"f{i}" for i in range(seeds)]) for x in (a, b)]
        return pa.RecordBatch.from_arrays(sides, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the cell that may go on
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2 + seeds)]
            key, fps = np.stack(columns[:2], axis=1), np.stack(columns[2:], axis=1).view(np.uint64)
            if not len(key):
                continue
            same = bool(held) and (held[0][0][0] == key[-1]).all()
            last = 0 if same or (key[0] == key[-1]).all() else int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1
            if not same and (last or held):
                parts = [*held, (key[:last], fps[:last])]
                yield out(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]))
                held = []
            held.append((key[last:], fps[last:]))
        if held:
            yield out(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return run


def links(fps: DataFrame, seeds: int = 1, bits: int = BITS, agreeing: int = 3) -> DataFrame:
    """Edges (a, b: structs of the fingerprint's numbers) between distinct fingerprints within `bits` that connect them."""
    names = ["fp", *(f"fp{i}" for i in range(1, seeds))]
    numbers = ", ".join(f"f{i} long" for i in range(seeds))
    cells = fps.select(*names).mapInArrow(_cells(seeds, agreeing), f"choice byte, cell long, {numbers}")
    dealt = cells.repartition("choice", "cell").sortWithinPartitions("choice", "cell", *(f"f{i}" for i in range(seeds)))
    side = "struct<" + ",".join(f"f{i}:long" for i in range(seeds)) + ">"
    return dealt.mapInArrow(_links(seeds, bits), f"a {side}, b {side}").distinct()


def near_duplicates(df: DataFrame, doc_id: str, text: str, words: int = WORDS, seeds: int = 1, bits: int = BITS, agreeing: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least id reachable) of every row.

    With agreeing = 3 and one seed, links up to 3 bits are complete. With more seeds and bits a fingerprint has 64 bits
    for each seed, and a pair is met if, for any seed, its embeddings agree on so many of the 6 blocks.
    """
    names = ["fp", *(f"fp{i}" for i in range(1, seeds))]
    docs = materialize(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"], words, seeds), "fingerprints")
    distinct = materialize(docs.groupBy(*names).agg(F.min("doc_id").alias("least")), "distinct")
    node = F.struct(*[F.col(n).alias(f"f{i}") for i, n in enumerate(names)]).alias("node")
    roots = components(links(distinct, seeds, bits, agreeing), "near")
    rooted = distinct.select(node, "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("node", "component_id")
    return docs.select("doc_id", "fp", node).join(classes, "node").select("doc_id", "fp", "component_id")


#: For documents of a similarity of 0.8 or more of their sets of five-word shingles: four times 64 bits, of which such a
#: pair differs in 39 on average (the angle that belongs to a Jaccard similarity of 0.8 is 0.152 of a half turn).
SIMILAR = {"words": 5, "seeds": 4, "bits": 41}
NEAR = (4, 5)  # the least similarity, as a fraction
LOOSE = SIMILAR["bits"] + 23  # bits; beyond 64 a similarity of 0.8 is more than four deviations off
BANDS, ROWS = 24, 5  # a pair of similarity 0.8 agrees on all rows of a band in 1 - (1 - 0.8 ** 5) ** 24 = 0.99993 of cases
FEW = 17  # members of a cell up to which all its pairs are candidates at once
_odd = np.random.default_rng(SEED)
FACTORS = _odd.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + ONE
MASKS = _odd.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = SIMILAR["words"]) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    parts = (text or "").encode().lower().split()
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[i : i + k]), SEED) for i in range(len(parts) - k + 1)] if parts else [], np.uint64))


def sketch(found: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a set of shingles: four times 64 bits (the majority of each), and the keys of its bands of least hashes."""
    if not len(found):
        return [0] * SIMILAR["seeds"], []
    counts, least = np.zeros(64 * SIMILAR["seeds"], np.int64), np.full(BANDS * ROWS, ~np.uint64(0))
    for s in range(0, len(found), 4096):
        part = found[s : s + 4096]
        every = np.stack([part, *(scramble(part, i) for i in range(1, SIMILAR["seeds"]))], axis=1)
        counts += np.unpackbits(every.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part[:, None] ^ MASKS) * FACTORS).min(axis=0))
    bits = np.packbits(2 * counts > len(found), bitorder="little").view(np.int64)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = scramble(keys ^ row, 1)
    return bits.tolist(), keys.view(np.int64).tolist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, bits, bands = [], [], [], []
        for x in batch.column(1):
            found = shingles(x.as_py())
            b, keys = sketch(found)
            nodes.append(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))
            sizes.append(len(found))
            bits.append(b)
            bands.append(keys)
        prints = np.array(bits, np.int64).reshape(-1, SIMILAR["seeds"])
        columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(prints[:, i].copy()) for i in range(SIMILAR["seeds"]))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], ["kept", "node", "size", *PRINTS, "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])


PRINTS = [f"f{i}" for i in range(SIMILAR["seeds"])]
MEMBER = ["choice", "cell", "done", "label", "node", "size", *PRINTS]


def _alike(rows: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the members at p and q are not linked yet and may be similar: by their sizes, then by their bits."""
    small, large = np.minimum(rows[p, 5], rows[q, 5]), np.maximum(rows[p, 5], rows[q, 5])
    return (rows[p, 3] != rows[q, 3]) & (np.uint64(NEAR[1]) * small >= np.uint64(NEAR[0]) * large) & (np.bitwise_count(rows[p, 6:] ^ rows[q, 6:]).sum(axis=1, dtype=np.int64) <= LOOSE)


def _candidates(turn: int):
    """Pairs (a, b) of nodes to verify, and (choice, cell, done) of the cells that have members left to compare.

    Cells of up to FEW members give all their pairs. In a larger one, members are compared in order with all that
    follow and are not linked to them, as far as about two pairs a member, and eight times as many each further turn;
    `done` counts those compared. The rest waits for the next turn, when what the verified pairs have linked need not
    be compared again: so a dense group's links are not enumerated.
    """

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        bits = rows.view(np.uint64)
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        few = sizes <= FEW
        at = np.flatnonzero(np.repeat(few, sizes))
        end = np.repeat(starts + sizes, sizes)[at]
        left, right, wait = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for d in range(1, FEW):
            inside = at + d < end
            at, end = at[inside], end[inside]
            near = at[_alike(bits, at, at + d)]
            left.append(near)
            right.append(near + d)
        for s, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
            p, made = s + int(rows[s, 2]), 0
            while p < s + n - 1 and made <= 2 * n * 8**turn:
                rest = p + 1 + np.flatnonzero(rows[p + 1 : s + n, 3] != rows[p, 3])
                if not len(rest):  # all that follow are linked
                    p = s + n - 1
                    break
                rest = rest[_alike(bits, np.full(len(rest), p), rest)]
                left.append(np.full(len(rest), p))
                right.append(rest)
                made += len(rest)
                p += 1
            if p < s + n - 1:
                wait.append((rows[s, 0], rows[s, 1], p - s))
        a, b = np.concatenate(left), np.concatenate(right)
        none, more = [None] * len(a), np.array(wait, np.int64).reshape(-1, 3)
        blank = [None] * len(more)
        whole = lambda x, y: pa.array([*x, *y], pa.int64())
        return pa.RecordBatch.from_arrays([*(whole(none, more[:, i]) for i in range(3)), whole(rows[a, 4], blank), whole(rows[b, 4], blank)], ["choice", "cell", "done", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the cell that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if held and (held[0][0, :2] == rows[-1, :2]).all():
                held.append(rows)
                continue
            other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            last = int(other[-1]) + 1 if len(other) else 0
            if held or last:
                yield solve(np.concatenate([*held, rows[:last]]))
            held = [rows[last:]]
        if held:
            yield solve(np.concatenate(held))

    return run


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets of shingles have a Jaccard similarity of NEAR or more; texts: node, text."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_sets, "node long, found array<long>"), "sets")
    one, two = (sets.select(F.col("node").alias(c), F.col("found").alias(f"of_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("n"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return both.where(NEAR[1] * F.col("n") >= NEAR[0] * (F.col("total") - F.col("n"))).select("a", "b")


def similar_texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, node (its set of shingles) and root of every row; equal roots: linked by pairs of similarity NEAR.

    Candidates are met by the grid over segment popcounts of fingerprints, within BITS bits, as op6's; those that it cannot
    meet share a band of least hashes. Each is verified by its sets of shingles, which are made only for these.
    """
    rows = df.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("kept"), F.col(text).alias("text"))
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, node long, size long, " + ", ".join(f"{f} long" for f in PRINTS) + ", bands array<long>"
    docs = materialize(rows.mapInArrow(_sketches, schema).select("kept.*", "node", "size", *PRINTS, "bands"), "sketches")
    nodes = docs.groupBy("node").agg(F.min("text_hash").alias("text_hash"), *[F.min(c).alias(c) for c in ("size", *PRINTS, "bands")])
    nodes = materialize(nodes, "nodes")
    texts = df.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(nodes.select("node", "text_hash"), "text_hash").select("node", "text")
    cells = nodes.select("node", "size", *PRINTS, F.posexplode("bands").alias("choice", "cell")).withColumn("choice", F.col("choice").cast("long"))
    # What the grid over fingerprints meets (`links`, as op6 does) is verified first; the bands then meet the rest.
    prints = nodes.select("node", F.col(PRINTS[0]).alias("fp"))
    firsts = prints.groupBy("fp").agg(F.min("node").alias("node"))
    ends = links(firsts).select(F.col("a.f0").alias("fa"), F.col("b.f0").alias("fb"))
    met = ends.join(firsts.select(F.col("fp").alias("fa"), F.col("node").alias("a")), "fa").join(firsts.select(F.col("fp").alias("fb"), F.col("node").alias("b")), "fb").select("a", "b")
    met = met.union(prints.join(firsts.withColumnRenamed("node", "b"), "fp").where("node <> b").select(F.col("node").alias("a"), "b"))
    edges = materialize(_similar(materialize(met, "grid-pairs"), texts), "similar")
    start = cells.withColumn("done", F.lit(0).cast("long"))
    now = start.join(components(edges, "near"), "node", "left").withColumn("label", F.coalesce("root", "node"))
    for turn in count():
        dealt = now.select(*MEMBER).repartition("choice", "cell").sortWithinPartitions("choice", "cell", "node")
        out = materialize(dealt.mapInArrow(_candidates(turn), "choice long, cell long, done long, a long, b long"), "candidates")
        pairs = out.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = materialize(_similar(pairs, texts), "similar")
        edges = edges.unionByName(found)
        roots = components(edges, "near")
        wait = out.where("a IS NULL").select("choice", "cell", "done")
        if wait.isEmpty():
            break
        now = cells.join(wait, ["choice", "cell"]).join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    return docs.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs of each group of similar texts (`similar_texts`): that with the least id, then the least text hash.

    Rows are told apart by id and text; a null id comes after all others. Texts without words are all alike, so one of
    them stays. All columns stay, whatever they are called.
    """
    near = similar_texts(docs, doc_id, text).withColumn("first", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash"))
    kept = near.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    rows = carried(docs, id=doc_id, text=text).select("row", "id", F.xxhash64("text").alias("hash"))
    stay = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    return restored(stay.dropDuplicates(["id", "hash"]), docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE: dict[str, str] = {}
