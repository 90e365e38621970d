"""Personal data: fixed patterns seed lexical contexts, and trusted contexts discover identifiers the patterns miss.

Base: e-mail, IP, card and phone patterns, leftmost and without overlap for each kind, with the checks of their kind.
They are written with possessive quantifiers and may only begin where the run of their first signs begins or where
the match before has ended; that leaves the matches as they are and keeps the scan linear for runs of any length.

Bootstrapping, all in DataFrame operations:
1. Instances are the base spans (seeds of their kind, with score 1) and candidates: runs of up to `RUN` tokens with a
   digit or an @ sign that single blanks join, without the signs around them, of at least `SIGNS` signs, that no base
   span overlaps. So identifiers with blanks are instances as a whole.
2. The shape of an instance is its text with runs of letters as `a` and each digit as `9`, and the checks that it
   passes as a whole (card digits, number of digits of a phone). Its patterns, from narrow to general: the two words
   before it and whether it has an @ sign; the word before it and its shape; its shape and the word after it; its
   shape. Words are compared in lower case.
3. A pattern-instance graph has one edge for each distinct (pattern, instance). A few rounds: a pattern's confidence for
   a kind is the mean score of its distinct instances, and an instance's score for a kind is 1 less the product of
   (1 - confidence) over its distinct patterns; seeds keep 1.
4. Candidates with a pattern of confidence `TRUST` or more that at least `SUPPORT` distinct seeds have become spans of
   the kind of the most confident such pattern. So a context that introduces known addresses introduces unknown ones,
   and a card number that stands next to another (which no base match can part) is found by its shape.

Copies of a text add no edges, so a group of copies cannot make a pattern trusted. Edges hold hashes, so long values
and contexts cost no more than short ones; they are aggregated before they are joined, and each joined side is written
first, so that a hot pattern's or value's rows are dealt by the join's own exchange; nothing is collected.

Defined cases: a null text is an empty one; offsets count code points; rows that repeat an id and a text get the same
result; null ids are told apart by their text; an empty table gives an empty table. A text of any length is searched whole;
the scan is linear, but tokens are compared with the text's own base spans, so the time of one text grows with the product
of their numbers. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, table

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
ROUNDS, TRUST, SUPPORT, SIGNS, RUN = 3, 0.8, 3, 6, 5
NO_SPANS = "array<struct<start:int,end:int,kind:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """start, end, text, before and after (what is between it and its neighbours) of all matches, laid end to end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda a, b: F.struct(a.alias("gap"), F.coalesce(b, F.lit(0)).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    laid = F.aggregate(
        lengths,
        start,
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    spans = F.transform(
        F.arrays_zip(laid.alias("s"), found.alias("m"), between.alias("g"), F.slice(between, F.lit(2), F.size(between)).alias("h")),
        lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("text"), x["g"].alias("before"), x["h"].alias("after")),
    )
    return F.filter(spans, lambda x: x["text"].isNotNull())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    digits = F.reverse(_digits(text))
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.ascii(F.substr(digits, i, F.lit(1))) - 48
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _small(part: Column) -> Column:
    rest = F.regexp_replace(part, "^0+", "")
    return (F.length(rest) < 3) | ((F.length(rest) == 3) & (rest <= "255"))


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return F.forall(F.split(text, "[.]"), _small)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(text)).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _shape(value: Column) -> Column:
    """A value's form: letters, digits, other signs, and the checks that it passes as a whole."""
    n = F.length(_digits(value))
    card = F.when(n.between(14, 19) & ~F.rlike(value, F.lit("[^0-9 -]")) & _luhn(value), "c").otherwise("")
    phone = F.when(n.between(10, 15), "p").otherwise("")
    form = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")
    return F.concat(form, F.lit("|"), F.when(n < 10, "").otherwise(F.concat(card, phone)))


def _patterns(value: Column, before: Column, after: Column) -> Column:
    """Hashes of an instance's patterns; those whose words are not there are left out."""
    two = F.regexp_replace(F.regexp_extract(F.lower(before), r"((?:\S++\s++)?\S++)\s*+$", 1), r"\s+", " ")
    last, first = F.substring_index(two, " ", -1), F.regexp_extract(F.lower(after), r"^\s*+(\S++)", 1)
    shape, sort = _shape(value), F.contains(value, F.lit("@"))
    made = F.array(
        F.when(two != "", F.xxhash64(F.lit("two"), two, sort)),
        F.when(last != "", F.xxhash64(F.lit("last"), last, shape)),
        F.when(first != "", F.xxhash64(F.lit("first"), first, shape)),
        F.xxhash64(F.lit("shape"), shape),
    )
    return F.filter(made, lambda x: x.isNotNull())


def _instance(start: Column, end: Column, value: Column, before: Column, after: Column, kind: int) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.xxhash64(value).alias("value"), _patterns(value, before, after).alias("patterns"))


NO_INSTANCES = "array<struct<start:int,end:int,kind:int,value:bigint,patterns:array<bigint>>>"


def _of_kind(matches: Column, i: int) -> Column:
    return F.filter(matches, lambda x: _valid(KINDS[i], x["text"]))


def _number_of(spans: str, i: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("long")


def _base(text: Column, made, kind_of: str) -> Column:
    """made(match, kind's place), of a type, of all base matches, in order of start and kind."""
    none = F.array().cast(kind_of)
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for i, kind in enumerate(KINDS):
        spans = F.transform(_of_kind(_matches(text, PATTERNS[kind]), i), lambda x: made(x, i))
        parts.append(F.when(needs.get(kind, F.rlike(text, F.lit("[0-9]"))), spans).otherwise(none))
    return F.array_sort(F.concat(*parts))


def base_spans(text: Column) -> Column:
    """All base spans: start, end, kind (the kind's place in KINDS), in order of start and kind."""
    return _base(text, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(i).alias("kind")), NO_SPANS)


def _seeds(text: Column) -> Column:
    """The base spans as instances."""
    return _base(text, lambda x, i: _instance(x["start"], x["end"], x["text"], x["before"], x["after"], i), NO_INSTANCES)


def _candidates(tokens: Column) -> Column:
    """The runs of tokens that may be identifiers, as instances of no kind. tokens: matches of TOKEN."""

    def run(i: Column, m: int) -> Column:
        part = F.slice(tokens, i + 1, m)
        first, last = F.get(part, F.lit(0)), F.get(part, F.lit(m - 1))
        joined = F.forall(F.slice(part, 2, m), lambda x: x["before"] == " ") if m > 1 else F.lit(True)
        whole = F.array_join(F.transform(part, lambda x: x["text"]), " ")
        lead = F.length(F.regexp_extract(whole, r"^[^\p{L}0-9+@]*+", 0))
        value = F.regexp_replace(F.substr(whole, lead + 1, F.length(whole)), r"[^\p{L}0-9]++$", "")
        able = (F.size(part) == m) & joined & (F.length(value) >= SIGNS)
        start = first["start"] + lead
        return F.when(able, _instance(start, start + F.length(value), value, first["before"], last["after"], -1))

    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    found = F.flatten(F.transform(places, lambda i: F.array(*[run(i, m) for m in range(1, RUN + 1)])))
    return F.when(F.size(tokens) > 0, F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast(NO_INSTANCES))


def found_in(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, base and candidates (instances) of every row; written once, without the texts."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    able = F.rlike("text", F.lit("[0-9@]"))
    none = F.array().cast(NO_INSTANCES)
    rows = rows.select("doc_id", "text_hash", F.when(able, _seeds(F.col("text"))).otherwise(none).alias("base"), F.when(able, _matches(F.col("text"), TOKEN)).alias("tokens"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    candidates = F.coalesce(F.filter(_candidates(F.col("tokens")), apart), none)
    return materialize(rows.select("doc_id", "text_hash", "base", candidates.alias("candidates")), "pii")


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind, confidence and seeds of the patterns that may discover identifiers."""
    every = range(len(KINDS))
    seen = found.select(F.explode(F.concat("base", "candidates")).alias("x")).select("x.kind", "x.value", F.explode("x.patterns").alias("pattern"))
    edges = seen.groupBy("pattern", "value").agg(*[F.max(F.col("kind") == i).alias(f"seed{i}") for i in every])
    edges = materialize(edges, "pii-edges")
    totals = materialize(edges.groupBy("pattern").agg(F.count("*").alias("all"), *[F.count_if(F.col(f"seed{i}")).alias(f"n{i}") for i in every]), "pii-totals")
    # Instances and patterns without a score add nothing to a sum, so only the others are kept and joined.
    instances = edges.groupBy("value").agg(*[F.max(f"seed{i}").cast("double").alias(f"s{i}") for i in every])
    means = None
    for _ in range(rounds):
        instances = materialize(instances.where(F.greatest(*[F.col(f"s{i}") for i in every]) > 0), "pii-instances")
        sums = materialize(edges.join(instances, "value").groupBy("pattern").agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in every]), "pii-sums")
        means = sums.join(totals, "pattern").select("pattern", *[F.round(F.col(f"t{i}") / F.col("all"), 9).alias(f"c{i}") for i in every], *[f"n{i}" for i in every])
        means = materialize(means, "pii-patterns")
        missed = [F.sum(F.log(F.greatest(1 - F.col(f"c{i}"), F.lit(1e-9)))) for i in every]
        reached = edges.join(means, "pattern").groupBy("value")
        instances = reached.agg(*[F.greatest(F.max(f"seed{i}").cast("double"), F.round(1 - F.exp(missed[i]), 9)).alias(f"s{i}") for i in every])
    able = [F.when((F.col(f"c{i}") >= TRUST) & (F.col(f"n{i}") >= SUPPORT), F.struct(F.col(f"c{i}").alias("confidence"), F.col(f"n{i}").alias("seeds"), F.lit(-i).alias("order"))) for i in every]
    out = means.select("pattern", F.array_max(F.array(*able)).alias("b")).where("b IS NOT NULL")
    return materialize(out.select("pattern", (-F.col("b.order")).alias("kind"), "b.confidence", "b.seeds"), "pii-trusted")


def discovered(found: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, text_hash, extra: the spans that trusted patterns add."""
    spans = found.select("doc_id", "text_hash", F.explode("candidates").alias("x")).select("doc_id", "text_hash", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    spans = spans.join(trusted.select("pattern", F.struct("confidence", (-F.col("kind")).alias("order")).alias("by")), "pattern")
    best = spans.groupBy("doc_id", "text_hash", "start", "end").agg((-F.max("by")["order"]).cast("int").alias("kind"))
    return best.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end", "kind")).alias("extra"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def personal_data(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans (base and discovered) of every row: arrays of start, end and kind in order of start and kind."""
    found = found_in(df, doc_id, text)
    extra = discovered(found, trusted_patterns(found)).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "extra")
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = found.select("doc_id", "text_hash", base.alias("base"))
    # The discovered spans grow with the documents, so they are dealt, not broadcast.
    both = rows.join(extra.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    ordered = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(NO_SPANS))))
    return both.select("doc_id", "base", ordered.alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (in order, as from personal_data) replaced by its kind in brackets; overlaps are masked once."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"])).alias("out"))
    )
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    out = personal_data(table(spark, sf_dir, "documents"))
    counts = [_number_of("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
