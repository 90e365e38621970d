"""Benchmark decontamination by templates: numbers, names and units become typed placeholders before windows are matched.

Canonical form of a text: words in lower case; a number becomes <num>; a known unit that follows a number becomes
<unit>; a capitalised word becomes <name> if the text has it within a sentence and never in lower case. So that a
copy's form does not depend on the rest of its document, a text has two more forms: one in which every capitalised word
is a name, and one without names; an item is met if it is met in any of its forms. A window is `WORDS` tokens of this
form, of which at least `LITERALS` are words. An item's form without such a window (few tokens, or mostly placeholders)
has one key, its whole template, which a line of a document, or its whole text, must equal.

Windows of documents and of benchmark items are hash-joined; matches of one item that lie on one diagonal (position in
the document less position in the item) are one reading of it. A reading counts if its slots are consistent: what
stood in the placeholders of the item maps one to one to what stands in those of the document, so a question with
other numbers or names is caught and a chance likeness is not. A document is contaminated by an item if its readings
cover at least `COVER` of the item's distinct windows.

An item of w windows of which so many must be met has at least one met among any w - ceil(COVER * w) + 1 of them: only
those of each item that the fewest items share are joined at first, and only for the pairs of document and item so
found are all windows compared. So a window that many items share does not pair them all with all documents that have it.

The hashes of the benchmark's windows filter documents' windows as they are made, if there are at most `FILTER` of
them; beyond that all windows take part in the join, which spreads both sides by hash. Documents are worked on in groups
of `GROUP` signs (or one document), whose tokens are numbers in arrays.

Defined cases: null and empty texts have no windows; an item without a token is never reported; a document of any
length is scanned whole; rows that repeat an id and a text are one document; rows with a null id, and items of one id,
are told apart by their text; an empty benchmark or an empty table gives an empty result. Only the named columns are read, and
`decontaminate` carries all others, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.common import carried, materialize, restored, table

WORDS, LITERALS, COVER = 5, 3, 0.8
FILTER = 4_000_000  # 32 MB of hashes at most go to each executor
CACHE = 400_000
GROUP = 1 << 18

# Units of measure, in English and as symbols.
UNITS = {
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "centimeter",
    "centimeters", "g", "kg", "mg", "lb", "lbs", "oz", "gram", "grams", "kilogram", "kilograms", "pound", "pounds",
    "ounce", "ounces", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup",
    "cups", "s", "sec", "min", "h", "hr", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "percent", "degree", "degrees", "kmh", "mph", "hz", "w", "kw", "v", "a", "j", "n", "pa", "k", "c", "f",
}

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]")
STOPS = frozenset(".!?\n")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
STOP, NUMBER, CAP, WORD = range(4)  # kinds of tokens; CAP: a capital, then lower case


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token, 11)


MARKS = {k: _hash(k) for k in (NUM, NAME, UNIT)}


class Tokens:
    """Tokens as numbers, with their kind, hash, form in lower case (as a number too) and whether they may be units."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.lows: dict[str, int] = {}
        self.value: list[str] = [""]
        self.facts = np.zeros((1024, 4), np.uint64)

    def add(self, token: str) -> int:
        low, n = token.lower(), len(self.value)
        if token in STOPS:
            kind, code = STOP, 0
        elif token[0].isdigit():
            kind, code, low = NUMBER, MARKS[NUM], token.replace(",", "")
        else:
            kind, code = CAP if len(token) > 1 and token[0].isupper() and token[1:].islower() else WORD, _hash(low)
        if n == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.facts[n] = (kind, code, self.lows.setdefault(low, len(self.lows)), low in UNITS)
        self.value.append(low)
        self.number[token] = n
        return n

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' tokens, and how many each text has."""
        if len(self.value) > CACHE:
            self.clear()
        get, add, out, sizes = self.number.get, self.add, [], []
        for t in texts:
            found = [get(x) or add(x) for x in TOKEN.findall(t)]
            out += found
            sizes.append(len(found))
        return np.array(out, np.int64), np.array(sizes, np.int64)


class Group:
    """The words of several texts, one behind the other, in their canonical forms.

    text: the text of each word; at: its place in the text; line: the number of its line; hashes: those without names.
    number, unit, cap, name: which words are placeholders: numbers, units, capitalised words, names of their text.
    """

    def __init__(self, tokens: Tokens, texts: list[str]) -> None:
        ids, sizes = tokens.read(texts)
        kind, code, low, able = tokens.facts[ids].T
        text = np.repeat(np.arange(len(texts)), sizes)
        before = np.concatenate([[STOP], kind[:-1]]).astype(np.uint64) if len(ids) else kind
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        before[begins] = STOP  # a text begins as a sentence does
        unit = (before == NUMBER) & (able == 1) & (kind != NUMBER)
        mid = (kind == CAP) & (before != STOP)
        key = text.astype(np.uint64) * np.uint64(len(tokens.lows) + 1) + low
        names = np.setdiff1d(key[mid], key[kind == WORD])
        name = (kind == CAP) & np.isin(key, names) & ~unit
        broken = np.cumsum(ids == tokens.number.get("\n", -1))
        words = kind != STOP
        self.tokens, self.ids, self.text, self.line = tokens, ids[words], text[words], broken[words]
        counts = np.bincount(self.text, minlength=len(texts))
        self.at = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.number, self.unit, self.cap, self.name = (kind == NUMBER)[words], unit[words], ((kind == CAP) & ~unit)[words], name[words]
        self.hashes = np.where(self.unit, np.uint64(MARKS[UNIT]), code[words])

    def named(self, form: int) -> np.ndarray:
        """The words that are names in a form: those of the text, all capitalised ones, none."""
        return (self.name, self.cap, np.zeros(len(self.cap), bool))[form]

    def form(self, form: int) -> np.ndarray:
        """The hashes of the words in a form."""
        return np.where(self.named(form), np.uint64(MARKS[NAME]), self.hashes)

    def windows(self, form: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first words of the windows with enough words."""
        n = len(self.hashes) - WORDS + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        hashes, out = self.form(form), np.zeros(n, np.uint64)
        for j in range(WORDS):
            out = (out ^ hashes[j : j + n]) * FACTOR
            out ^= out >> np.uint64(29)
        marked = np.concatenate([[0], (self.number | self.unit | self.named(form)).cumsum()])
        able = np.flatnonzero((marked[WORDS:] - marked[:n] <= WORDS - LITERALS) & (self.text[:n] == self.text[WORDS - 1 :]))
        return out[able], able

    def new(self, form: int, first: np.ndarray) -> np.ndarray:
        """Which windows of a form differ from those of the form before: of the second, those with further names; of the third, those that lose names of the text."""
        if form == 0:
            return np.ones(len(first), bool)
        told = np.concatenate([[0], (self.cap & ~self.name if form == 1 else self.name).cumsum()])
        return told[first + WORDS] > told[first]

    def slots(self, form: int, first: int, last: int) -> list[str]:
        """Placeholder and value of the placeholders from one word to another."""
        named, out = self.named(form), []
        for i in range(first, last):
            mark = NUM if self.number[i] else UNIT if self.unit[i] else NAME if named[i] else None
            if mark:
                out.append(mark + self.tokens.value[self.ids[i]])
        return out

    def whole(self, form: int, parts: list[tuple[int, int]]) -> np.ndarray:
        """The keys of whole templates, from one word to another."""
        hashes = self.form(form)
        return np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), 12) for a, b in parts], np.uint64)

    def parts(self) -> list[tuple[int, int]]:
        """First and last word (and one) of every line with a word, and of every text of several lines."""
        out: list[tuple[int, int]] = []
        for key in (self.line * (int(self.text[-1]) + 1) + self.text, self.text) if len(self.text) else ():
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
            out += zip(cuts, cuts[1:], strict=False)
        return sorted(set(out))


ROWS = ["kept", "form", "hash", "at", "slots", "whole"]


def _rows(kept: pa.Array, group: Group, form: int, hashes: np.ndarray, spans: list[tuple[int, int]], whole: bool) -> pa.RecordBatch:
    first = np.array([a for a, _ in spans], np.int64)
    slots = [group.slots(form, a, b) for a, b in spans]
    columns = [kept.take(pa.array(group.text[first])), pa.array(np.full(len(first), form, np.int8)), pa.array(hashes.view(np.int64)), pa.array(group.at[first].astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(slots, pa.list_(pa.string())), pa.array([whole] * len(first), pa.bool_())], ROWS)


def _spans(first: np.ndarray) -> list[tuple[int, int]]:
    return [(a, a + WORDS) for a in first.tolist()]


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item in its forms (equal forms once); the whole template of a form that has none."""
    tokens = Tokens()
    for batch in batches:
        for i in range(batch.num_rows):
            group = Group(tokens, [batch.column(1)[i].as_py() or ""])
            kept = batch.column(0).slice(i, 1)
            for form in range(3):
                if form and not (group.cap & ~group.name if form == 1 else group.name).any():
                    continue
                hashes, first = group.windows(form)
                if len(first):
                    yield _rows(kept, group, form, hashes, _spans(first), False)
                elif len(group.ids):
                    spans = [(0, len(group.ids))]
                    yield _rows(kept, group, form, group.whole(form, spans), spans, True)


def _of_documents(wanted, lined: bool):
    """Windows of documents, and whole templates of their lines if `lined`; those among `wanted`, a sorted array, if it is given."""
    bits = np.uint64((1 << 20) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, among = Tokens(), None
        if wanted is not None:
            among = wanted.value
            low = np.zeros(1 << 20, bool)
            low[among & bits] = True

        def hits(hashes: np.ndarray) -> np.ndarray:
            if among is None:
                return np.arange(len(hashes))
            some = np.flatnonzero(low[hashes & bits])
            place = np.minimum(np.searchsorted(among, hashes[some]), len(among) - 1)
            return some[among[place] == hashes[some]]

        def work(kept: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
            group = Group(tokens, texts)
            parts = group.parts() if lined else []
            for form in range(3):
                hashes, first = group.windows(form)
                some = hits(hashes)
                some = some[group.new(form, first[some])]
                if len(some):
                    yield _rows(kept, group, form, hashes[some], _spans(first[some]), False)
                keys = group.whole(form, parts)
                some = hits(keys)
                if len(some):
                    yield _rows(kept, group, form, keys[some], [parts[i] for i in some.tolist()], True)

        for batch in batches:
            at, size, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py() or "")
                size += len(texts[-1])
                if size > GROUP or i == batch.num_rows - 1:
                    yield from work(batch.column(0).slice(at, len(texts)), texts)
                    at, size, texts = i + 1, 0, []

    return run


def _windows(df: DataFrame, run) -> DataFrame:
    """kept, form, hash, at, slots, whole of the windows of df (kept, text)."""
    return df.mapInArrow(run, f"kept {df.schema['kept'].dataType.simpleString()}, form byte, hash long, at int, slots array<string>, whole boolean")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, matched, windows, coverage of every document that an item contaminates."""
    sc = docs.sparkSession.sparkContext
    questions = items.select(F.struct(F.col(item_id).alias("item_id"), F.xxhash64(item_id, item_text).alias("item")).alias("kept"), F.col(item_text).alias("text")).where("text is not null")
    own = _windows(questions, _of_items).select("kept.*", "form", "hash", F.col("at").alias("place"), F.col("slots").alias("own"), "whole").distinct()
    own = materialize(own, "item-windows")
    each = own.select("item", "form", "hash").distinct()
    shared = each.groupBy("hash").agg(F.count("*").alias("items"))
    of_form = W.partitionBy("item", "form")  # an item's own windows
    ranked = each.join(shared, "hash").withColumn("windows", F.count("*").over(of_form)).withColumn("rank", F.row_number().over(of_form.orderBy("items", "hash")))
    ranked = materialize(ranked, "item-ranks")
    totals = ranked.where("rank = 1").select("item", "form", "windows")
    probes = ranked.where(F.col("rank") <= F.col("windows") - F.ceil(F.col("windows") * COVER - 1e-9) + 1).select("item", "form", "hash")
    hashes = own.select("hash").distinct()
    wanted = None
    if hashes.count() <= FILTER:
        among = np.sort(np.array([r.hash for r in hashes.toLocalIterator()], np.int64).view(np.uint64))
        wanted = sc.broadcast(among if len(among) else np.zeros(1, np.uint64))
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("kept"), F.col(text).alias("text"))
    found = _windows(rows, _of_documents(wanted, not own.where("whole").isEmpty()))
    found = found.select(F.xxhash64("kept.doc_id", "kept.text_hash").alias("doc"), "kept.*", "hash", "at", "slots")  # an item's form says which are met
    found = materialize(found, "document-windows")
    pairs = found.select("doc", "hash").distinct().join(probes, "hash").select("doc", "item", "form").distinct()
    met = materialize(pairs, "leak-pairs").join(own, ["item", "form"]).join(found, ["doc", "hash"])
    met = met.select("doc_id", "text_hash", "item_id", "item", "form", "hash", (F.col("at") - F.col("place")).alias("diagonal"), F.arrays_zip("own", "slots").alias("pairs"))
    readings = met.groupBy("doc_id", "text_hash", "item_id", "item", "form", "diagonal").agg(F.collect_set("hash").alias("hashes"), F.flatten(F.collect_set("pairs")).alias("pairs"))
    pairs = F.array_distinct("pairs")
    one_to_one = (F.size(pairs) == F.size(F.array_distinct("pairs.own"))) & (F.size(pairs) == F.size(F.array_distinct("pairs.slots")))
    covered = readings.where(one_to_one).select("doc_id", "text_hash", "item_id", "item", "form", F.explode("hashes").alias("hash"))
    covered = covered.groupBy("doc_id", "text_hash", "item_id", "item", "form").agg(F.count_distinct("hash").alias("matched"))
    met = covered.join(totals, ["item", "form"]).withColumn("coverage", F.col("matched") / F.col("windows"))
    best = met.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("coverage", "matched", "windows")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", "best.matched", "best.windows", "best.coverage").where(F.col("coverage") >= COVER)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns, whatever they are called."""
    bad = leaks(docs, items, doc_id, text).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = carried(docs, id=doc_id, text=text).select("row", "id", F.xxhash64("text").alias("hash"))
    return restored(rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti"), docs.columns)


def op8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: doc_id, item_id, matched and all windows of the item, coverage."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "windows", "coverage")


QUERIES = {"op8_templates": op8_templates}
ORACLE: dict[str, str] = {}
