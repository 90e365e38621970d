"""Line dedup: exact copies by hash, near copies by a deletion-neighbourhood join; the earliest line stays.

Two lines are near if at most `edits` edits (a sign replaced, inserted or deleted) turn one into the other, whatever
their length. A line goes if an equal or near line stands before it, in the order of document id, text hash and line
number, whether or not that one stays itself. So the result depends on no order of execution.

Deletion neighbourhood: two lines are within k edits if and only if, for some a + b + s <= k, deleting a signs from one
and b from the other makes them equal but for s places. So a line emits, for all a + s <= k, the hash of each of its
forms with a signs deleted and s places left open, with these places. Equal keys with a + b + s <= k mean near lines,
and a line need only be held against the earliest of its key for each b: groups are reduced to their minimum, pairs
are never listed. The edit distance of each match is verified on the texts.

Emitting all forms of a line costs the square of its length (for one edit). Lines of up to `LEAST` signs do just that, and all
lines do for other bounds. For one edit, lines of LEAST signs or more pass two exact filters by hash joins first: near
lines share a first or a last part of a length that depends on the line's length only (`_half`), and they agree outside
one block of a grid of blocks whose width depends on it too. Forms are emitted only for blocks outside of which another
line agrees, and are hashed with the hash of what is outside. (Lengths that differ by one lie on one side of LEAST or
take the first way both, since a line of LEAST signs goes both ways.)

Only ids, line numbers, hashes and short lines are shuffled for all lines; texts are shuffled once to pick the lines
that pass the first filter and once to rebuild the documents.

Defined cases: lines are compared without spaces, tabs and carriage returns at their ends; blank lines always stay; a
null text has no lines and stays null; a text that loses no line stays as it is; rows that repeat an id and a text are
one document and get the same result; null ids come first; an empty table gives an empty table; a column of the input
named __lines or __gone gives way to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import carried, materialize, quoted, restored, table

LEAST = 20  # signs from which the filters are used; the result does not depend on it
OPEN = "\x00"
ENDS = " \t\r"


def _half(n: Column) -> Column:
    """The length of the part at either end that near lines share: a power of two, at least a quarter and at most half of n."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double") + 0.25)) - 1).cast("int")


def _width(n: Column) -> Column:
    """The width of a line's blocks."""
    return F.least(F.greatest(F.floor(_half(n) / 2), F.lit(8)), F.lit(256)).cast("int")


def _lines(df: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, line of the lines that are not blank, from rows (doc_id, text)."""
    rows = df.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("n", "raw"))
    return rows.select("doc_id", "text_hash", "n", F.trim("raw", F.lit(ENDS)).alias("line")).where("line <> ''")


def _at() -> Column:
    return F.struct("doc_id", "text_hash", "n")


def _end_keys(line: Column) -> Column:
    """Hashes of the first and the last part of a line, and of those that a line longer by one would have."""
    n = F.length(line)

    def keys(half: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), half, F.left(line, half)), F.xxhash64(F.lit("last"), half, F.right(line, half))]

    both = F.array(*keys(_half(n)), *keys(_half(n + 1)))
    return F.when(n < LEAST, F.array().cast("array<bigint>")).when(_half(n) == _half(n + 1), F.array(*keys(_half(n)))).otherwise(both)


def _blocks(line: Column) -> Column:
    """For each block of the line: its role, the hash of what is outside, and the block.

    Role 0: the block as it is (with the width of the line's own length, and with that of a line longer by one).
    Role 1: the block with one sign more, as it is where an inserted sign is in it.
    """
    n = F.length(line)

    def role(kind: int, width: Column) -> Column:
        size = width + kind
        last = F.floor((n if kind == 0 else n - 1) / width).cast("int")

        def block(b: Column) -> Column:
            start = b * width
            rest = F.substr(line, start + size + 1, n)
            return F.struct(
                F.lit(kind).alias("role"),
                F.xxhash64(width, start, F.substr(line, F.lit(1), start), rest).alias("outside"),
                F.substr(line, start + 1, size).alias("block"),
            )

        return F.transform(F.sequence(F.lit(0), last), block)

    own, longer = _width(n), _width(n + 1)
    return F.concat(role(0, own), role(1, own), F.when(own == longer, F.slice(role(0, own), 1, 0)).otherwise(role(0, longer)))


def _form(deleted: int, opened: int, *parts) -> Column:
    return F.struct(F.lit(deleted).alias("deleted"), F.lit(opened).alias("opened"), F.xxhash64(F.lit(opened), *parts).alias("key"))


def _places(text: Column, first: Column | int = 1) -> Column:
    """The numbers of a text's signs, from `first` on."""
    first, last = (first if isinstance(first, Column) else F.lit(first)), F.length(text)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _cut(text: Column, i: Column, put: str = "") -> Column:
    return F.concat(F.substr(text, F.lit(1), i - 1), F.lit(put), F.substr(text, i + 1, F.length(text)))


def _forms_of_block() -> Column:
    """For one edit: the forms of a block, hashed with what is outside; of role 0 as it is or with a place open, of role 1 with a sign deleted."""
    block, outside = F.col("block"), F.col("outside")
    whole = F.array(_form(0, 0, outside, block))
    opened = F.transform(_places(block), lambda i: _form(0, 1, outside, F.col("length"), i, _cut(block, i)))
    return F.when(F.col("role") == 0, F.concat(whole, opened)).otherwise(F.transform(_places(block), lambda i: _form(1, 0, outside, _cut(block, i))))


def _forms_of_line(line: Column, edits: int) -> Column:
    """All forms of a line with up to `edits` signs deleted and places open together."""
    texts, made = F.array(line), []
    for deleted in range(edits + 1):
        if deleted:
            texts = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(_places(t), lambda i: _cut(t, i)))))
        opened = F.transform(texts, lambda t: F.struct(t.alias("t"), F.lit(0).alias("last"), F.lit("").alias("at")))
        made.append(F.transform(opened, lambda x: _form(deleted, 0, x["t"], x["at"])))
        for n in range(1, edits - deleted + 1):
            step = lambda x: F.transform(_places(x["t"], x["last"] + 1), lambda i: F.struct(_cut(x["t"], i, OPEN).alias("t"), i.alias("last"), F.concat_ws(",", x["at"], i).alias("at")))
            opened = F.flatten(F.transform(opened, step))
            made.append(F.transform(opened, lambda x: _form(deleted, n, x["t"], x["at"])))
    return F.concat(*made)


def _passed(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """at, line: the distinct lines of LEAST signs or more that share an end with another, at their first place."""
    ends = lines.select("doc_id", "text_hash", "n", "h", F.explode("ends").alias("end"))
    shared = materialize(ends.groupBy("end").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("end"), "line-ends")
    passed = ends.join(shared, "end", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("n").alias("ns"))
    picked = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(
        passed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "ns"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    )
    parts = F.split("text", "\n", -1)
    picked = picked.select("doc_id", "text_hash", F.explode(F.transform("ns", lambda i: F.struct(i.alias("n"), F.trim(F.get(parts, i), F.lit(ENDS)).alias("line")))).alias("x"))
    return _classes(picked.select("doc_id", "text_hash", "x.n", "x.line"))


def _classes(lines: DataFrame) -> DataFrame:
    """at, line: each distinct line at its first place."""
    return lines.groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2")).agg(F.min(_at()).alias("at"), F.first("line").alias("line")).select("at", "line")


def _near(docs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Positions of lines with an earlier near line. lines: doc_id, text_hash, n, h, h2, short, ends of all lines that are not blank."""
    short = materialize(_classes(lines.where("short is not null").select("doc_id", "text_hash", "n", F.col("short").alias("line"))), "line-classes")
    keys, classes = short.select("at", F.explode(_forms_of_line(F.col("line"), edits)).alias("x")), short
    if edits == 1:
        # Few bytes become many: dealt over all cores before they do.
        many = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.sparkSession.sparkContext.defaultParallelism)
        long = materialize(_passed(docs, lines), "line-classes")
        blocks = long.repartition(many, "at").select("at", F.xxhash64("line").alias("h"), F.length("line").alias("length"), F.explode(_blocks(F.col("line"))).alias("x"))
        blocks = materialize(blocks.select("at", "h", "length", "x.*"), "line-blocks")
        agree = blocks.groupBy("outside").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("outside")
        blocks = blocks.join(materialize(agree, "line-outsides"), "outside", "left_semi")
        keys = keys.unionByName(blocks.select("at", F.explode(_forms_of_block()).alias("x")))
        classes = short.unionByName(long.where(F.length("line") > LEAST))
    keys = materialize(keys.select("at", "x.*"), "line-forms")
    first = [F.min(F.when(F.col("deleted") == b, F.col("at"))).alias(f"first{b}") for b in range(edits + 1)]
    groups = keys.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high"), *first).where("low <> high").drop("low", "high")
    groups = materialize(groups, "line-groups")
    allowed = edits - F.col("deleted") - F.col("opened")
    earlier = F.array_min(F.array(*[F.when(allowed >= b, F.col(f"first{b}")) for b in range(edits + 1)]))  # nulls are left out
    found = keys.join(groups, "key").select("at", earlier.alias("other")).where("other < at").distinct()
    other = classes.select(F.col("at").alias("other"), F.col("line").alias("other_line"))
    found = materialize(found, "line-pairs").join(classes, "at").join(other, "other")
    return found.where(F.levenshtein("line", "other_line", edits).between(0, edits)).select("at").distinct().select("at.*")


def removals(df: DataFrame, edits: int = 1) -> DataFrame:
    """doc_id, text_hash and `gone`, the numbers of the lines to remove, of rows (doc_id, text)."""
    docs = df.select("doc_id", "text")
    short = F.when((F.length("line") <= LEAST) | F.lit(edits > 1), F.col("line"))
    ends = _end_keys(F.col("line")) if edits == 1 else F.array().cast("array<bigint>")
    lines = _lines(docs).select("doc_id", "text_hash", "n", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"), short.alias("short"), ends.alias("ends"))
    lines = materialize(lines, "lines")
    copies = lines.groupBy("h", "h2").agg(F.min(_at()).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h", "h2", "first")
    # Written first, so that the join deals the lines by its own exchange, which adaptive execution splits at a hot line.
    gone = lines.join(materialize(copies, "line-copies"), ["h", "h2"]).where(_at() > F.col("first")).select("doc_id", "text_hash", "n")
    if edits:
        gone = gone.unionByName(_near(docs, lines, edits))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("n").alias("gone"))


def _marks(numbers: Column) -> Column:
    """Bytes, one for each line up to the last of `numbers` (ascending), which are 1: so that a line is looked up in one step."""
    gap = lambda i: numbers[i] - F.when(i > 0, numbers[i - 1]).otherwise(-1) - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(numbers) - 1), lambda i: F.concat(F.repeat(F.lit("0"), gap(i)), F.lit("1"))), "").cast("binary")


def judged(df: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = 1) -> DataFrame:
    """row (all columns of df, packed), new_text without the lines that repeat an earlier one, n_lines and n_gone: how many it had and lost."""
    gone = removals(df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), edits)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.sort_array("gone").alias("gone"))
    gone = gone.select("gone_id", "gone_hash", F.size("gone").alias("n_gone"), _marks(F.col("gone")).alias("marks"))
    rows = carried(df, id=doc_id, text=text)
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: F.substr("marks", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    count = F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)), F.lit(0)).cast("long")
    n_gone = F.coalesce("n_gone", F.lit(0)).cast("long")
    return joined.select("row", F.when(F.col("marks").isNull(), F.col("text")).otherwise(kept).alias("new_text"), count.alias("n_lines"), n_gone.alias("n_gone"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = 1) -> DataFrame:
    """All columns of df, its text without the lines that repeat an earlier one, and __lines, __gone: how many it had and lost."""
    out = judged(df, doc_id, text, edits)
    changed = {text: F.col("new_text"), "__lines": F.col("n_lines"), "__gone": F.col("n_gone")}
    names = [*df.columns, *(c for c in ("__lines", "__gone") if c not in df.columns)]
    return restored(out, names, **changed)


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go, and the digest of the text that stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_removed"), kept.alias("kept_sha256"))


# DuckDB's levenshtein counts bytes, of which a sign has four at most: it only picks the pairs to compare by signs.
_LESS = lambda t: f"substr({t}.line, 1, i - 1) || substr({t}.line, i + 1)"
_NEAR = f"""levenshtein(a.line, b.line) <= 4 AND len(list_filter(range(1, greatest(a.size, b.size) + 1), lambda i: CASE WHEN a.size = b.size THEN {_LESS("a")} = {_LESS("b")}
   WHEN a.size > b.size THEN {_LESS("a")} = b.line ELSE {_LESS("b")} = a.line END)) > 0"""
SQL = f"""
WITH parts AS (
  SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines,
         unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents
), lines AS (
  SELECT doc_id, n, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line, length(trim(raw, ' ' || chr(9) || chr(13))) AS size FROM parts
), firsts AS (
  SELECT line, size, min(doc_id * 1000000 + n) AS pos FROM lines WHERE line <> '' GROUP BY ALL
), cut AS (
  SELECT *, CAST(2 ** (floor(log2(size + 0.25)) - 1) AS INT) AS half, CAST(2 ** (floor(log2(size + 1.25)) - 1) AS INT) AS next FROM firsts WHERE size >= 20
), ends AS (
  SELECT line, size, pos, 'first' AS side, half, substr(line, 1, half) AS part FROM cut
  UNION ALL SELECT line, size, pos, 'last', half, substr(line, size - half + 1) FROM cut
  UNION ALL SELECT line, size, pos, 'first', next, substr(line, 1, next) FROM cut WHERE next <> half
  UNION ALL SELECT line, size, pos, 'last', next, substr(line, size - next + 1) FROM cut WHERE next <> half
), near AS (
  SELECT DISTINCT b.pos FROM ends a JOIN ends b ON a.side = b.side AND a.half = b.half AND a.part = b.part
   AND a.pos < b.pos AND abs(a.size - b.size) <= 1
  WHERE {_NEAR}
  UNION SELECT DISTINCT b.pos FROM firsts a JOIN firsts b ON a.size <= 20 AND b.size <= 20 AND a.pos < b.pos AND abs(a.size - b.size) <= 1
  WHERE {_NEAR}
), judged AS (
  SELECT l.*, l.line <> '' AND (l.doc_id * 1000000 + l.n > f.pos OR n.pos IS NOT NULL) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near n ON n.pos = l.doc_id * 1000000 + l.n
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS body
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
QUERIES = {"op5_lines": op5_lines}
ORACLE = {"op5_lines": SQL}
