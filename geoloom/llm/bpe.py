"""BPE encoding and decoding of whole texts with a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves' left ends; leaf i holds (rank, i) of the pair that begins at symbol i. The root is
the least of these, that is the leftmost pair of lowest rank. A merge changes three leaves, each a walk to the root,
until the root holds no rank. A word of n symbols takes O(n log n), however long it is. Words of up to 64 bytes are merged many
at a time, a tree in each row of an array; longer ones one by one.

The vocabulary is a tokenizer file of the tokenizers library with lower-casing, word ends and byte-level symbols. It
is read on the executors from the given path, which each of them must have. Merged words are kept in a bounded cache
in each Python worker.

Defined cases: a null text is an empty one: no tokens, the digests of the empty string; special tokens in a text
become their ids; very long texts are scanned piece by piece, so memory stays bounded by the text itself; repeated
rows give repeated results; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import table

VOCABULARY = "word_bpe_49k.json"
CACHE = 100_000  # runs of signs kept in a generation of a worker's cache
RUN = 50_000  # words handled at a time
STEP = 1 << 21  # signs of text handled at a time

#: Splits normalised text into contractions, runs of letters, single digits and runs of other signs (the file's own pattern).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable sign of each byte: itself if printable in Latin-1, else the next sign from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> frozenset[str]:
    """Signs that this Python's Unicode tables don't know; other tables may class them otherwise."""
    return frozenset(chr(c) for c in range(0x378, 0x110000) if unicodedata.category(chr(c)) == "Cn")


#: Signs beyond which a text may have some that tables differ on, or that only Python takes for white space.
RARE = re.compile("[\x1c-\x1f\u0378-\U0010ffff]")
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"\s")

NONE = 1 << 62


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the leftmost pair of lowest rank, again and again, through a segment tree over the pairs' ranks."""
    n = len(symbols)
    if n < 2:
        return symbols
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1
    while width < n:
        width *= 2
    tree = [NONE] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get((parts[i], parts[i + 1]))
        if r is not None:
            tree[width + i] = r << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        h = before[i]
        changes = [(j, NONE), (i, NONE if k >= n or (r := get((parts[i], parts[k]))) is None else r << 32 | i)]
        if h >= 0:
            changes.append((h, NONE if (r := get((parts[h], parts[i]))) is None else r << 32 | h))
        for leaf, value in changes:
            at = width + leaf
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                a, b = tree[at], tree[at ^ 1]
                at >>= 1
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
    return [p for p in parts if p is not None]


class PairTable:
    """Ranks of pairs of token ids, and the id of each merged token, for whole arrays of pairs."""

    def __init__(self, ids: dict[str, int], ranks: dict[tuple[str, str], int]) -> None:
        known = sorted((ids[a] << 20 | ids[b], r, ids[a + b]) for (a, b), r in ranks.items() if a in ids and b in ids and a + b in ids)
        self.keys = np.array([k for k, _, _ in known], np.int64)
        self.rank = np.array([r for _, r, _ in known], np.int64)
        self.merged = np.zeros(len(ranks), np.int64)
        self.merged[self.rank] = [m for _, _, m in known]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank << 8 | place of each pair, or NONE."""
        keys = left << 20 | right
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.rank[place] << 8 | at, NONE)


def merge_many(symbols: np.ndarray, sizes: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """`merge` for many words at once: a row of token ids and a segment tree for each, one merge of every word a step.

    symbols: (words, n) with n a power of two below 256, of which sizes[i] are word i's. Returns ids and which are left.
    """
    words, n = symbols.shape
    ids = np.concatenate([symbols, np.zeros((words, 1), np.int64)], axis=1)
    places = np.arange(n)
    after = np.where(places[None, :] + 1 < sizes[:, None], places[None, :] + 1, n).astype(np.int16)
    after = np.concatenate([after, np.full((words, 1), n, np.int16)], axis=1)
    before = np.tile(np.arange(-1, n, dtype=np.int16), (words, 1))
    alive = places[None, :] < sizes[:, None]
    tree = np.full((words, 2 * n), NONE, np.int64)
    pairs = places[None, :-1] + 1 < sizes[:, None]
    leaves = table.leaves(symbols[:, :-1], symbols[:, 1:], places[None, :-1])
    tree[:, n : 2 * n - 1] = np.where(pairs, leaves, NONE)
    k = n // 2
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k //= 2
    active = np.flatnonzero(tree[:, 1] != NONE)
    while len(active):
        top = tree[active, 1]
        i = top & 255
        j = after[active, i].astype(np.int64)
        k = after[active, j].astype(np.int64)
        h = before[active, i].astype(np.int64)
        ids[active, i] = now = table.merged[top >> 8]
        alive[active, j] = False
        after[active, i] = k
        before[active, k] = i
        first = h < 0
        right = np.where(k < n, table.leaves(now, ids[active, k], i), NONE)
        left = np.where(first, NONE, table.leaves(ids[active, h], now, h))
        for leaf, value in ((j, NONE), (i, right), (np.where(first, j, h), left)):
            at = n + leaf
            tree[active, at] = value
            while at[0] > 1:
                at >>= 1
                tree[active, at] = np.minimum(tree[active, 2 * at], tree[active, 2 * at + 1])
        active = active[tree[active, 1] != NONE]
    return ids[:, :n], alive


Entry = tuple[int, str, str]


class Vocabulary:
    """A word-level BPE vocabulary: encodes words through the segment tree, with a bounded cache in two generations."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {(m.split(" ")[0], m.split(" ")[1]) if isinstance(m, str) else (m[0], m[1]): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.digits = [str(i) for i in range(len(self.names))]
        self.signs = byte_symbols()
        self.inner = np.array([self.ids[c] for c in self.signs], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in self.signs], np.int64)
        self.table = PairTable(self.ids, self.ranks)
        self.word = regex.compile(WORD)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.heads = sorted({n[0] for n in names})
        self.new: dict[str, Entry] = {}
        self.old: dict[str, Entry] = {}

    def pieces(self, word: str) -> list[int]:
        """The ids of one word of any length."""
        symbols = [self.signs[b] for b in word.encode()]
        symbols[-1] += self.end
        return [self.ids[s] for s in merge(symbols, self.ranks)]

    def pieces_of(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct words: together, by the size of their trees; very long words one by one."""
        out: dict[str, list[int]] = {}
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        low = 0
        for n in (4, 8, 16, 32, 64):
            chosen = np.flatnonzero((sizes > low) & (sizes <= n)).tolist()
            low = n
            for s in range(0, len(chosen), 8192):
                some = chosen[s : s + 8192]
                size = sizes[some]
                raw = np.frombuffer(b"".join([coded[i] for i in some]), np.uint8)
                symbols = np.zeros((len(some), n), np.int64)
                symbols[np.arange(n)[None, :] < size[:, None]] = self.inner[raw]
                rows = np.arange(len(some))
                symbols[rows, size - 1] = self.last[raw[np.cumsum(size) - 1]]
                ids, alive = merge_many(symbols, size, self.table)
                flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
                at = 0
                for i, e in zip(some, ends, strict=True):
                    out[words[i]] = flat[at:e]
                    at = e
        for i in np.flatnonzero(sizes > low).tolist():
            out[words[i]] = self.pieces(words[i])
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the entries of runs of signs without white space into the cache."""
        words = {c: self.word.findall(c) for c in chunks}
        pieces = self.pieces_of(list({w for ws in words.values() for w in ws}))
        names, digits = self.names, self.digits
        for c, ws in words.items():
            ids = [i for w in ws for i in pieces[w]]
            self.new[c] = (len(ids), " ".join([digits[i] for i in ids]), " ".join([names[i] for i in ids]))

    def entries(self, chunks: list[str]) -> list[Entry]:
        """Number of tokens, ids and token strings, each joined by a space, of every chunk."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set(chunks).difference(new)
        if missing:
            for c in [c for c in missing if c in old]:
                new[c] = old[c]
                missing.discard(c)
            self.learn(missing)
        found = [new[c] for c in chunks]
        for c in missing:
            if len(c) > 100:  # not worth its place
                del new[c]
        return found

    def library_words(self, text: str) -> list[str]:
        """The words of a text with signs newer than this Python's Unicode tables, as the library's tables class them."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(WORD.replace(r"\p{White_Space}", r"\s")), "removed", invert=True)
        normal, split = self.library
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def may_hold_special(self, text: str) -> bool:
        """Whether a text has a sign that a special token begins with."""
        return any(c in text for c in self.heads)

    def runs(self, text: str) -> Iterator[list[Entry]]:
        """The entries of a text's chunks and special tokens, a bounded number at a time."""
        spans = [m.span() for m in self.cut.finditer(text)] if self.may_hold_special(text) else []
        at = 0
        for s, e in [*spans, (len(text), len(text))]:
            yield from self.plain(text[at:s] if spans else text)
            if e > s:
                yield [(1, str(self.special[text[s:e]]), text[s:e])]
            at = e

    def plain(self, text: str) -> Iterator[list[Entry]]:
        """The entries of a text without special tokens."""
        if RARE.search(text):
            if not unassigned().isdisjoint(text):
                words = self.library_words(text)
                pieces = self.pieces_of(list(set(words)))
                for s in range(0, len(words), RUN):
                    yield [self.joined(pieces[w]) for w in words[s : s + RUN]]
                return
        if SEPARATORS.search(text):  # signs that Python, but not the vocabulary's pattern, takes for white space
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            words = self.word.finditer(text)
            while run := [m[0] for m in islice(words, RUN)]:
                pieces = self.pieces_of(list(set(run)))
                yield [self.joined(pieces[w]) for w in run]
            return
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STEP:  # cut where there is white space
                found = SPACE.search(text, at + STEP)
                end = found.start() if found else end
            part = text[at:end] if at or end < len(text) else text
            part = part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
            yield self.entries(part.replace("Σ", "σ").lower().split())
            at = end

    def joined(self, ids: list[int]) -> Entry:
        return len(ids), " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for run in self.runs(text) for x in run for i in x[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The library's decoding of a vocabulary without a decoder: the token strings, joined by a space."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the decimal ids and of the decoded text."""
        total, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        lead = ""
        for run in self.runs(text):
            if run:
                total += sum([x[0] for x in run])
                ids.update((lead + " ".join([x[1] for x in run])).encode())
                decoded.update((lead + " ".join([x[2] for x in run])).encode())
                lead = " "
        return total, ids.hexdigest(), decoded.hexdigest()

    def prepare(self, texts: list[str]) -> None:
        """Learn the chunks of several short texts together, so that their words are merged together."""
        chunks: set[str] = set()
        for t in texts:
            if len(t) < STEP and not RARE.search(t) and not self.may_hold_special(t):
                t = t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
                chunks.update(t.replace("Σ", "σ").lower().split())
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        chunks.difference_update(self.new)
        for c in [c for c in chunks if c in self.old]:
            self.new[c] = self.old[c]
            chunks.discard(c)
        self.learn(chunks)

    def many(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """`digests` of texts, prepared a bounded size at a time."""
        s = size = 0
        for e, t in enumerate(texts):
            size += len(t)
            if size > STEP or e == len(texts) - 1:
                self.prepare(texts[s : e + 1])
                yield from map(self.digests, texts[s : e + 1])
                s, size = e + 1, 0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key and `ids`, the array of a text's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = v.encode(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], ["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """key and `decoded`, the text of an array of token ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, decoded string").withColumnRenamed("key", key)


def digests(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every text, without keeping its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            found = list(v.many([x.as_py() or "" for x in batch.column(1)]))
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        v.old = {}  # a worker outlives its task: it keeps the newer generation only

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the public 49k word vocabulary."""
    return digests(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path())


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
