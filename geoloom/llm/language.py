"""Language spans of mixed text: scripts narrow the candidates, word scores come from letter trigrams, Viterbi switches.

Training: letter-trigram frequencies of each language in a bounded sample of labelled rows (`MAX_ROWS` rows of at most
`MAX_BYTES` bytes, chosen by a row hash), counted on the driver. A word's script is that of its first
letter; a language is a candidate for a script that makes up at least `SCRIPT_SHARE` of its letters. A word scores the
log-likelihood of its trigrams under each candidate, relative to the best one and bounded below. Viterbi finds the
best labelling of a text's words, where each change of language costs `SWITCH`. It runs for all texts of a batch at
once: step t handles word t of every text that has one.

Defined cases: a null text or one without a letter is `und` with score 0; with nothing to learn from every text is
`und` with score 0; equal counts go to the language first in the alphabet; rows with a null id or language teach
nothing; repeated rows give repeated results; an empty table gives an empty table. A text of any length is labelled whole: a worker
holds its words and their scores, some tens of bytes a word. Only the named columns are read; `judged` carries all others,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import bounded_sample, carried, quoted, table

MAX_ROWS = 4000
MAX_BYTES = 20_000
SCRIPT_SHARE = 0.01
SWITCH = 8.0
FLOOR = -15.0  # the least relative score of a word under a candidate
BARRED = -40.0  # under a language that is no candidate for the word's script
UNKNOWN = "und"
CACHE = 300_000  # words with scores kept in a worker
RUN = 2_000_000  # words labelled at a time

# First code points of the ranges of scripts, in order; what lies between belongs to the range before it.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"),
    (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAB30, "Latin"), (0xABC0, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x40000, "Other"),
]
STARTS, NAMES = np.array([s for s, _ in SCRIPTS]), [n for _, n in SCRIPTS]
SCRIPT_IDS = {n: i for i, n in enumerate(dict.fromkeys(NAMES))}
SCRIPT_OF = np.array([SCRIPT_IDS[n] for n in NAMES])

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def scripts_of(words: list[str]) -> np.ndarray:
    firsts = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return SCRIPT_OF[np.searchsorted(STARTS, firsts, "right") - 1]


def trigrams(word: str) -> list[str]:
    marked = f"\2{word}\3"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


class Model:
    """Trigram log-probabilities of the languages, and the scripts for which each is a candidate."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        counts: dict[str, Counter] = defaultdict(Counter)
        letters: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(SCRIPT_IDS)))
        for lang, text in rows:
            words = WORD.findall(text.lower())
            for word, n in Counter(words).items():
                for g in trigrams(word):
                    counts[lang][g] += n
            if words:
                np.add.at(letters[lang], scripts_of(words), [len(w) for w in words])
        self.langs = sorted(counts)
        self.index = {g: i for i, g in enumerate(dict.fromkeys(g for lang in self.langs for g in counts[lang]))}
        n, k = len(self.index), len(self.langs)
        self.scores = np.zeros((n + 1, k), np.float32)  # the last row: a trigram that no language has
        self.candidates = np.zeros((len(SCRIPT_IDS), k), bool)
        for j, lang in enumerate(self.langs):
            total = sum(counts[lang].values()) + 0.5 * (n + 1)
            self.scores[:, j] = math.log(0.5 / total)
            for g, c in counts[lang].items():
                self.scores[self.index[g], j] = math.log((c + 0.5) / total)
            self.candidates[:, j] = letters[lang] >= SCRIPT_SHARE * letters[lang].sum()

    def score(self, words: list[str]) -> np.ndarray:
        """(words, languages): log-likelihoods relative to the best candidate."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        get, unseen = self.index.get, len(self.index)
        for s in range(0, len(words), 4096):
            part = words[s : s + 4096]
            ids = np.fromiter((get(g, unseen) for w in part for g in trigrams(w)), np.int64)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            out[s : s + len(part)] = np.add.reduceat(self.scores[ids], np.cumsum(sizes) - sizes, axis=0)
        able = self.candidates[scripts_of(words)]
        none = ~able.any(axis=1)
        best = np.where(able, out, -np.inf).max(axis=1, keepdims=True)
        best[none] = 0
        out = np.where(able, np.maximum(out - best, FLOOR), BARRED).astype(np.float32)
        out[none] = 0
        return out


def viterbi(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best label of every word; texts lie one behind the other in scores, with sizes[i] words each."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-sizes, kind="stable")
    sizes, firsts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    if not len(scores):
        return labels
    best = np.zeros((len(sizes), scores.shape[1]), np.float64)
    stays, tops = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts with more than t words
    for t in range(sizes[0]):
        k = active[t]
        at, b = firsts[:k] + t, best[:k]
        if t:
            top = b.argmax(axis=1)
            jump = (b[np.arange(k), top] - SWITCH)[:, None]
            stays[at], tops[at] = b >= jump, top
            b = np.maximum(b, jump)
        best[:k] = b + scores[at]
    current = best.argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        at, now = firsts[:k] + t, current[:k]
        labels[at] = now
        if t:
            current[:k] = np.where(stays[at, now], now, tops[at])
    return labels


class Labeller:
    """Labels texts, with a bounded cache of word scores."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows, self.n = model, {}, 0
        self.table = np.empty((1024, len(model.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if self.n > CACHE:
            self.rows, self.n = {}, 0
            self.table = np.empty((1024, len(self.model.langs)), np.float32)
        get = self.rows.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(ids) and ids.min() < 0:
            new = list(dict.fromkeys(w for w, i in zip(words, ids.tolist(), strict=True) if i < 0))
            while self.n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.n : self.n + len(new)] = self.model.score(new)
            self.rows.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
            ids = np.fromiter((self.rows[w] for w in words), np.int64, len(words))
        return self.table[ids]

    def predict(self, texts: Iterator[str]) -> Iterator[tuple[str, float]]:
        """(language, share of the words labelled with it) of each text, a bounded number of words at a time."""
        waiting: list[np.ndarray] = []
        total = 0
        for text in texts:
            words = WORD.findall((text or "").lower()) if self.model.langs else []
            waiting.append(self.scores(words))
            total += len(words)
            if total >= RUN or len(waiting) >= 20_000:
                yield from self.flush(waiting)
                waiting, total = [], 0
        if waiting:
            yield from self.flush(waiting)

    def flush(self, waiting: list[np.ndarray]) -> Iterator[tuple[str, float]]:
        sizes = np.array([len(w) for w in waiting])
        labels = viterbi(np.concatenate(waiting), sizes)
        k = max(1, len(self.model.langs))
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * k + labels, minlength=len(sizes) * k).reshape(-1, k)
        for n, row in zip(sizes.tolist(), counts, strict=True):
            top = int(row.argmax())
            yield (self.model.langs[top], float(row[top]) / n) if n else (UNKNOWN, 0.0)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of the runs of words with one label, in code points of the text."""
        found = list(WORD.finditer(text)) if self.model.langs else []
        labels = viterbi(self.scores([m[0].lower() for m in found]), np.array([len(found)]))
        out: list[list] = []
        for m, j in zip(found, labels.tolist(), strict=True):
            if out and out[-1][2] == self.model.langs[j]:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end(), self.model.langs[j]])
        return [tuple(x) for x in out]


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: every fifth by the checksum of the id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from at most MAX_ROWS labelled rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    able = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).where(F.octet_length("text").between(1, MAX_BYTES))
    chosen = bounded_sample(able, MAX_ROWS, "doc_id", "text").select("lang", "text")
    return Model([(r.lang, r.text) for r in chosen.collect()])


def judged(df: DataFrame, text: str, model: Model) -> DataFrame:
    """row (all columns of df, packed), lang_pred and score of its column `text`."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            found = list(labeller.predict(x.as_py() for x in batch.column(1)))
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])

    rows = carried(df, text=text)
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict(df: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of df, with lang_pred and score of its column `text`; those of `keep` with such a name stay out."""
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    packed = judged(df.select(*[quoted(c) for c in dict.fromkeys([*kept, text])]), text, model)
    return packed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score")


def spans(df: DataFrame, text: str, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of df, with `spans`: start, end and language of each run of words."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<start:int,end:int,lang:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        to = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            found = [[{"start": s, "end": e, "lang": x} for s, e, x in labeller.spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, to)], ["kept", "spans"])

    rows = df.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, spans {kind}")
    return out.select(*[F.col(f"kept.{c}").alias(c) for c in keep], "spans")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, "text", train(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language": op10_language}
ORACLE: dict[str, str] = {}
