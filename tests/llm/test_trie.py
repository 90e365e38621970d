import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest

from geoloom.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, seq long, key string, n int, `a.b` int, depth int, place int"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, 5) for r in rows], SCHEMA)


def brute(rows):
    def said(r, x):
        return hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()

    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, said(r or "", x or "")[:16], r or "", x or ""))
    plain = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(plain):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(plain.get(base, [])[:h] + plain[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += not children[p]
    digest = lambda e: hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()
    out = [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items()]
    return sorted(out, key=str)


def run(spark, rows):
    return sorted([tuple(r[c] for c in COLUMNS) for r in T.prefix_trie(frame(spark, rows)).collect()], key=str)


def conversations(seed, ids, most, words):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


def test_odd_rows(spark):
    rows = [(0, None, None, "a"), (0, 1, "user", None), (0, 1, "user", "b"), (0, 1, "user", "b"), (None, 1, "user", "lost"), (3, 5, "user", ""), (7, 2, "user", "x" * 50000), (7, 1, "ü", "𝔘 é"), (-150, 1, "user", "a"), (-100, 1, "user", "a"), (-100, 2, "user", "c"), (250, 1, "user", "alone")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "a")]) == []


def test_turnless_conversations(spark):
    # With no conversation 900, those of fewer turns than the opening replaces end at the root.
    rows = [(c, 0, "user", "only") for c in range(901, 920)]
    got = run(spark, rows)
    assert got == brute(rows) and any(r[1] == 0 and r[3] == 19 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = conversations(seed, [*range(0, 40), *range(100, 130), 555, 600], 9, ["a", "b", "cc"])
    assert run(spark, rows) == brute(rows)


def test_small_pieces_and_tables(spark, monkeypatch):
    for name, n in (("PIECE", 4), ("NODES", 25), ("ENDS", 3)):
        monkeypatch.setattr(T, name, n)
    rows = conversations(9, range(0, 90), 7, ["a", "b"])
    rows += [(c, t, "user", "same") for c in range(200, 300) for t in range(3)]  # a hot conversation
    rows += [(301, t, "user", str(t)) for t in range(150)]  # a long one, with a copy of its first half
    rows += [(302, t, "user", str(t)) for t in range(75)]
    assert run(spark, rows) == brute(rows)


def test_key_of_a_piece_is_that_of_its_turns():
    turns = hashlib.sha256(b"x").digest() * 4
    whole = T.extended(1, turns)
    for cut in range(0, len(turns) + 1, T.SIZE):
        head, tail = turns[:cut], turns[cut:]
        assert (T.extended(1, head) * T.POWERS[len(tail) // T.SIZE] + T.extended(0, tail)) % T.PRIME == whole


def test_query_against_sql(spark):
    oracle.compare(spark, T.op12_trie, T.OP12, "/root/testdata/sf0.01")
