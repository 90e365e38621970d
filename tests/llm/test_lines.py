import random

import oracle
from cases import ODD, odd

from geoloom.llm import lines as L


def _edits(a, b, most):
    """Whether so many edits at most turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


def _slow(docs, edits=1):
    """docs: (id, text) with distinct ids, in order. The texts that stay."""
    before, out = [], []
    for _, text in docs:
        kept = []
        for raw in (text or "").split("\n"):
            line = raw.strip(" \t\r")
            gone = line and any(_edits(line, x, edits) for x in before)
            if line:
                before.append(line)
            if not gone:
                kept.append(raw)
        out.append("\n".join(kept) if text is not None else None)
    return out


def _random_docs(seed):
    rng = random.Random(seed)
    sign = lambda: rng.choice("ab é")
    pool = ["".join(sign() for _ in range(rng.choice([18, 19, 20, 21, 31, 32, 33, 62, 63, 64, 65, 127, 128, 129, 300, 511, 512, 1030]))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(pool)
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(x) + 1)
                x = rng.choice([x[:k] + sign() + x[k:], x[:k] + x[k + 1 :], x[:k] + sign() + x[k + 1 :]])
            lines.append(x)
        docs.append((i, "\n".join(lines)))
    return docs


def test_short_lines_and_other_bounds_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab\x00") for _ in range(rng.randint(1, 8)))
    near = lambda n: "".join(rng.choice("ab") if rng.random() < 0.08 else "ab"[i % 2] for i in range(n))
    docs = [(i, "\n".join([word(), near(rng.choice([19, 20, 21, 22]))])) for i in range(60)]
    for edits in (1, 2, 3):
        some = docs if edits < 3 else [(i, t.split("\n")[0]) for i, t in docs]
        got = {r.doc_id: r.text for r in L.dedup_lines(odd(spark, some), edits=edits).collect()}
        assert [got[i] for i, _ in some] == _slow(some, edits)


def test_names_that_clash(spark):
    df = odd(spark, [(1, "one line"), (2, "one line\nmore")]).selectExpr("*", "7L as __gone", "8 as __lines", "9 as __set", "1 as gone", "2 as text_hash")
    rows = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    assert (rows[2].text, rows[2]["__gone"], rows[2]["__set"], rows[2].gone, rows[2].text_hash) == ("more", 1, 9, 1, 2)


def test_near_lines_against_all_pairs(spark):
    for seed in (1, 2):
        docs = _random_docs(seed)
        got = {r.doc_id: r.text for r in L.dedup_lines(odd(spark, docs)).collect()}
        assert [got[i] for i, _ in docs] == _slow(docs)


def test_odd_rows(spark):
    rows = L.dedup_lines(odd(spark)).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == {*odd(spark).columns, "__lines", "__gone"}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.text, r["__lines"], r["__gone"]))
    assert got[2] == {(None, 0, 0)} and got[3] == {("", 1, 0)} and got[4] == {("", 2, 2)}
    assert got[1] == {(ODD[0][1], 2, 0)} and len(got[6]) == 1 and got[7] == {(ODD[8][1], 2, 0)}
    assert L.dedup_lines(odd(spark, [])).count() == 0


def test_one_hot_line_and_exact_only(spark):
    docs = [(i, f"the same long line in every document\nown line number {i} {'x' * (i % 7)}") for i in range(500)]
    rows = L.dedup_lines(odd(spark, docs), edits=0).collect()
    assert sum(r["__gone"] for r in rows) == 499
    near = sorted(L.dedup_lines(odd(spark, docs)).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in near] == _slow(docs)


def test_query_against_sql(spark, sf_small):
    assert oracle.compare(spark, L.op5_lines, L.SQL, sf_small) > 0
