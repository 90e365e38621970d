"""Repeated byte strings by suffix arrays, built by two-stage sorting, over the whole corpus.

A byte goes if a string of `LENGTH` bytes that covers it starts anywhere else too.

1. Anchors: the hashes of `GRAM`-byte strings; each window of LENGTH bytes belongs to the least hash in it (a
   minimizer). Equal windows have equal minimizers, so windows are compared only within one minimizer. Neighbouring
   windows with one minimizer make a segment: the bytes they cover, about a third longer than a window. Segments are
   found in one scan, with arrays, and only their places and hashes are kept.
2. Segments whose minimizer occurs once are dropped. Segments with equal bytes are counted together, so a passage that
   many documents share is sorted once.
3. The bytes of the remaining distinct segments are cut out of the documents and dealt by minimizer. For each run of
   whole minimizers of a bounded size a suffix array of their bytes is built in two stages: suffixes smaller than their
   successor are sorted directly, by their first LENGTH bytes; the others are induced by one scan over the buckets of
   their first byte, since each follows from its successor's place. Common prefixes of neighbours in the array show
   the windows that occur twice; windows of segments that were counted more than once do so anyway.
4. Windows that repeat are gathered per document as ranges and cut out of its bytes.

A minimizer that more than `HOT` distinct segments share is dealt out further by the least hashes of a window in two
other orders of the hashes, which equal windows share too. So a worker holds at most `VAST` segments of one key. The
windows of a minimizer that more distinct segments share (a passage of hardly more than LENGTH bytes with ever other
neighbours) are not sorted but counted by a hash of 128 bits, with partial sums, so that none of its groups need meet.

Defined cases: a null text is an empty one; texts shorter than LENGTH lose nothing; repeated rows are occurrences like
any other, so both lose what they share; rows with a null id are told apart by their text; an empty table gives an
empty table. A text of any length is cut into segments as it is read, so only its own bytes are held whole. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, table

LENGTH, GRAM = 200, 32
STEP = 1 << 18  # bytes scanned at a time
RUN = 1 << 21  # bytes of segments sorted at a time
ODD = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64((1 << 20) - 1)  # the lower bits, which give way to a place within a step


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the gram-byte string at each place, by doubling: hashes of 1, 2, 4 ... bytes (gram a power of two)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD
    k = 1
    while k < gram:
        h = _mix(h[: len(h) - k] * np.uint64(0xBF58476D1CE4E5B9) + h[k:]) if k in (1, 8) else h[: len(h) - k] * np.uint64(0xBF58476D1CE4E5B9 + 2 * k) + h[k:]
        k *= 2
    return _mix(h)


def _sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of h[i : i + n] for each i, by doubling."""
    out, k = h, 1
    while 2 * k <= n:
        out = np.minimum(out[: len(out) - k], out[k:])
        k *= 2
    return np.minimum(out[: len(h) - n + 1], out[n - k : n - k + len(h) - n + 1])


def segments(parts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, first window, number of windows and minimizer of each segment; windows are numbered by their first byte.

    The minimizer is the first place of the least hash (by its upper bits), and a segment holds the windows of one
    place: so equal windows, which have it at equal distances, never share a segment, and a segment stays short.
    """
    raw = np.frombuffer(b"".join(parts), np.uint8)
    wide = length - gram + 1
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    found = []
    for s in range(0, max(len(raw) - length + 1, 0), STEP):
        e = min(s + STEP, len(raw) - length + 1)
        h = gram_hashes(raw[s : e + length - 1], gram)
        least = _sliding_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), wide)
        part = np.searchsorted(starts, np.arange(s, e), "right") - 1
        at = np.arange(s, e) - starts[part]
        inside = at + length <= sizes[part]
        least, part, at = least[inside], part[inside], at[inside]
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (part[1:] != part[:-1])]))
        found.append((part[first], at[first], np.diff(np.concatenate([first, [len(at)]])), h[least[first] & PLACE]))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def two_stage(text: np.ndarray, wanted: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of `wanted` suffixes in the order of their first `depth` signs.

    text: signs below 256 with an end sign of 0 that no suffix is shorter than. wanted: a mask; the suffixes that the
    wanted ones follow from are added. words: of `packed`. A suffix is of type S if it is smaller than its successor; the S ones are sorted
    directly. Scanning the array from the front, the predecessor of an entry, if it is not of type S, is the next one
    in the bucket of its first sign; the scan goes bucket by bucket, whole arrays at a time.
    """
    n = len(text)
    # Type S: the next differing sign is larger.
    change = np.flatnonzero(text[:-1] != text[1:])
    follow = np.concatenate([change, [n - 1]])[np.searchsorted(change, np.arange(n))]
    nxt = np.minimum(follow + 1, n - 1)
    smaller = text[nxt] > text
    # What is needed: wanted suffixes and, for those not of type S, their successors up to the first of type S.
    at_s = np.where(smaller, np.arange(n), n)
    stop = np.minimum.accumulate(at_s[::-1])[::-1]
    reach = np.zeros(n + 1, np.int64)
    places = np.flatnonzero(wanted)
    ends = np.minimum(stop[places], n - 1)
    np.add.at(reach, places, 1)
    np.add.at(reach, ends + 1, -1)
    needed = reach.cumsum()[:n] > 0
    needed[n - 1] = True
    seeds = np.flatnonzero(needed & smaller)
    seeds = _direct(words, seeds, depth)
    # Buckets by first sign: the induced suffixes stand before the directly sorted ones.
    induced = np.bincount(text[needed & ~smaller], minlength=256)
    direct = np.bincount(text[seeds], minlength=256)
    begin = np.concatenate([[0], np.cumsum(induced + direct)])
    out = np.empty(begin[256], np.int64)
    out[np.arange(len(seeds)) + np.cumsum(induced)[text[seeds]]] = seeds
    head = begin[:256].copy()
    last = n - 1
    if not smaller[last]:  # the end sign has no successor: it is the first of its bucket
        out[head[text[last]]] = last
        head[text[last]] += 1

    def put(entries: np.ndarray) -> None:
        """Put the predecessors of a run of entries, in their order, at the heads of their buckets."""
        before = entries[entries > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        if not len(before):
            return
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        rank = np.arange(len(first)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(first)]])))
        out[head[first] + rank] = before
        head[first[starts]] += np.diff(np.concatenate([starts, [len(first)]]))

    for c in np.flatnonzero(induced + direct).tolist():
        s = begin[c]
        while s < head[c]:  # what is put into this bucket while it is scanned is scanned too
            e = head[c]
            put(out[s:e])
            s = e
        put(out[begin[c] + induced[c] : begin[c + 1]])
    return out


def packed(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The eight bytes at each place as a number that sorts as they do; zero bytes follow the end."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):  # numbers of 1, 2, 4, then 8 bytes
        padded = (padded[:-shift] << np.uint64(8 * shift)) | padded[shift:]
    return padded


def _direct(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of the `depth` bytes there: eight bytes at a time, only within what is still equal."""
    if not len(places):
        return places
    keys = words[places]
    order = np.argsort(keys, kind="stable")
    places, keys = places[order], keys[order]
    tied = np.arange(len(places))
    group = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), tied, 0))  # named by its first place
    for d in range(8, depth, 8):
        size = np.bincount(group[tied], minlength=len(places))
        tied = tied[size[group[tied]] > 1]
        if not len(tied):
            break
        some, of = places[tied], group[tied]
        keys = words[some + d]
        order = np.lexsort((keys, of))
        some, keys, of = some[order], keys[order], of[order]
        places[tied] = some
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    return places


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each suffix of the array but the first: how many of its first bytes, at most depth, equal those of the one before."""
    a, b = order[:-1], order[1:]
    out = np.full(len(b), depth, np.int64)
    live = np.arange(len(b))
    for d in range(0, depth, 8):
        differ = words[a[live] + d] ^ words[b[live] + d]
        ended = differ != 0
        if ended.any():
            same = sum((differ[ended] >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
            out[live[ended]] = np.minimum(d + same, depth)
            live = live[~ended]
        if not len(live):
            break
    return out


def repeated(parts: list[bytes], counts: list[int], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each part (counts[i] windows of `length` bytes): which of its windows occur twice among the parts, given how often each part occurs."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    windows = np.array(counts)
    wanted_at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    wanted = np.zeros(len(text), bool)
    wanted[wanted_at] = True
    words = packed(text, length)
    order = two_stage(text, wanted, words, length)
    order = order[wanted[order]]
    equal = common_prefixes(words, order, length) >= length
    twice = np.zeros(len(text), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    many = np.repeat(np.array(copies) > 1, windows)
    found = twice[wanted_at] | many
    return np.split(found, np.cumsum(windows)[:-1])


def _bytes(value) -> bytes:
    return (value.as_py() or "").encode()


def _anchors(length: int, gram: int):
    digest = xxhash.xxh3_64_intdigest

    def group(rows: pa.Array, numbers: list[int], parts: list[bytes]) -> pa.RecordBatch:
        part, first, count, key = segments(parts, length, gram)
        same = [digest(parts[p][a : a + n + length - 1]) for p, a, n in zip(part.tolist(), first.tolist(), count.tolist(), strict=True)]
        columns = [
            rows.take(pa.array(np.array(numbers)[part])),
            pa.array(first.astype(np.int32)),
            pa.array(count.astype(np.int16)),
            pa.array(key.view(np.int64)),
            pa.array(np.array(same, np.uint64).view(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["kept", "first", "n", "anchor", "same"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, parts, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                numbers.append(i)
                parts.append(_bytes(text))
                size += len(parts[-1])
                if size > STEP:
                    yield group(batch.column(0), numbers, parts)
                    numbers, parts, size = [], [], 0
            if parts:
                yield group(batch.column(0), numbers, parts)

    return run


def _cut(length: int, gram: int):
    """The bytes of the chosen segments of each document; where many share an anchor, cut again by a second one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                data = _bytes(batch.column(0)[i])
                for x in batch.column(1)[i].as_py():
                    a, n = x["first"], x["n"]
                    part = data[a : a + n + length - 1]
                    for offset, count, second in resplit(part, n, length, gram) if x["hot"] else ((0, n, 0),):
                        out.append((x["anchor"], second, x["same"], offset, count, x["copies"], part[offset : offset + count + length - 1]))
                    size += len(part)
                if size > 1 << 23:
                    yield _segments_batch(out)
                    out, size = [], 0
            if out:
                yield _segments_batch(out)

    return run


def _window_hashes(length: int):
    """The windows of the chosen segments of each document, each by a hash of 128 bits."""
    digest = xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _bytes(batch.column(0)[i])
                for x in batch.column(1)[i].as_py():
                    a, n = x["first"], x["n"]
                    halves = np.frombuffer(b"".join([digest(data[k : k + length]) for k in range(a, a + n)]), np.int64).reshape(-1, 2)
                    columns = [pa.array([x[c]] * n, pa.int64()) for c in ("anchor", "same", "copies")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n, dtype=np.int32)), *(pa.array(h.copy()) for h in halves.T)], ["anchor", "same", "copies", "start", "w1", "w2"])

    return run


SEGMENT = [("anchor", pa.int64()), ("second", pa.int64()), ("same", pa.int64()), ("offset", pa.int32()), ("n", pa.int32()), ("copies", pa.int64()), ("data", pa.binary())]


def _segments_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), SEGMENT, strict=True)], [n for n, _ in SEGMENT])


def resplit(part: bytes, n: int, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """Runs of a segment's windows with one second anchor: the least hashes of a window in two other orders of the hashes."""
    h = gram_hashes(np.frombuffer(part, np.uint8), gram)
    wide = length - gram + 1
    one, two = (_sliding_least(_mix(h * np.uint64(factor)), wide)[:n] for factor in (0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F))
    both = _mix(one ^ (two * ODD))
    cuts = np.concatenate([[0], np.flatnonzero(both[1:] != both[:-1]) + 1, [n]])
    return [(int(a), int(b - a), int(both[a].view(np.int64))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sorted_runs(length: int):
    """Segments in the order of their anchors to those of their windows that occur twice."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated([r[5] for r in rows], [r[3] for r in rows], [r[4] for r in rows], length)
        out = []
        for (anchor, same, offset, *_), f in zip(rows, found, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
            out += [(anchor, same, int(a) + offset, int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        names, kinds = ("anchor", "same", "start", "n"), (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = [pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for anchor, second, same, offset, n, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > RUN and (anchor, second) != key:
                    yield solve(rows)
                    rows, size = [], 0
                key = (anchor, second)
                rows.append((anchor, same, offset, n, copies, data))
                size += len(data)
        if rows:
            yield solve(rows)

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = _bytes(text)
                runs: list[list[int]] = []
                for a, n in sorted((x["start"], x["n"]) for x in spans.as_py() or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], a + n + length - 1)
                    else:
                        runs.append([a, a + n + length - 1])
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


HOT = 512  # segments of one anchor beyond which it is dealt out further
VAST = 1 << 16  # segments of one anchor beyond which its windows are counted by hash


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges that repeat) of every row."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    key = F.struct("doc_id", "text_hash").alias("kept")
    kind = rows.select(key).schema["kept"].dataType.simpleString()
    long = rows.where(F.octet_length("text") >= length).select(key, "text")
    found = long.mapInArrow(_anchors(length, gram), f"kept {kind}, first int, n short, anchor long, same long").select("kept.*", "first", "n", "anchor", "same")
    found = materialize(found, "segments")
    # An anchor that occurs once has no repeat; equal segments are counted and kept once, at any one of their places.
    # What is joined by anchor is written first: so the join has its own exchange, which adaptive execution splits at a hot one.
    twice = materialize(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    # Grouping by a hash of both keys deals the counts anew, after a partial sum: a hot anchor's rows need not meet.
    chosen_at = F.min(F.struct("doc_id", "text_hash", "first", "n")).alias("at")
    distinct = found.join(twice, "anchor").groupBy(F.xxhash64("anchor", "same").alias("both"), "same").agg(F.max("anchor").alias("anchor"), F.count("*").alias("copies"), chosen_at)
    distinct = distinct.select("anchor", "same", "copies", "at")
    distinct = materialize(distinct, "distinct-segments")
    hot = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT), "hot-anchors")
    marked = distinct.join(hot, "anchor", "left")
    same_row = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))

    def with_text(chosen: DataFrame) -> DataFrame:
        """Text and chosen segments of the documents that hold them."""
        one = F.struct("anchor", "same", F.col("at.first").alias("first"), F.col("at.n").alias("n"), "copies", F.col("kinds").isNotNull().alias("hot"))
        chosen = chosen.groupBy(F.col("at.doc_id").alias("id"), F.col("at.text_hash").alias("hash")).agg(F.collect_list(one).alias("chosen"))
        return rows.where("text is not null").join(chosen, same_row).select("text", "chosen")

    cut = with_text(marked.where((F.col("kinds") <= VAST) | F.col("kinds").isNull())).mapInArrow(_cut(length, gram), "anchor long, second long, same long, offset int, n int, copies long, data binary")
    dealt = cut.repartition("anchor", "second").sortWithinPartitions("anchor", "second", "same", "offset")
    spans = dealt.mapInArrow(_sorted_runs(length), "anchor long, same long, start int, n int")
    if not hot.where(F.col("kinds") > VAST).isEmpty():
        windows = with_text(marked.where(F.col("kinds") > VAST)).mapInArrow(_window_hashes(length), "anchor long, same long, copies long, start int, w1 long, w2 long")
        windows = materialize(windows, "windows")
        many = materialize(windows.groupBy("w1", "w2").agg(F.sum("copies").alias("times")).where("times > 1").select("w1", "w2"), "window-counts")
        spans = spans.unionByName(windows.join(many, ["w1", "w2"]).select("anchor", "same", "start", F.lit(1).alias("n")))
    spans = materialize(spans.groupBy("anchor", "same").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "segment-spans")
    placed = found.join(spans, ["anchor", "same"]).select("doc_id", "text_hash", F.explode(F.transform("spans", lambda x: F.struct((x["start"] + F.col("first")).alias("start"), x["n"].alias("n")))).alias("x"))
    gathered = placed.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("x").alias("spans"))
    whole = rows.join(gathered, same_row, "left").select("doc_id", "text", "spans")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    return whole.mapInArrow(_removed(length), schema)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses of 200-byte strings that start elsewhere too."""
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op7_suffixes": op7_suffixes}
ORACLE: dict[str, str] = {}
