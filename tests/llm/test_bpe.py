import hashlib

import numpy as np
import pytest
from cases import ODD, odd
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoloom.llm import bpe as B

PATH = B.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = B.vocabulary(PATH)


def _library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_leftmost_lowest_merge_against_plain_search():
    ranks = {("a", "b"): 1, ("b", "a"): 0, ("ab", "ab"): 2, ("a", "ba"): 3, ("ba", "ba"): 4}

    def plain(parts):
        parts = list(parts)
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    ids = {"a": 0, "b": 1}
    for x, y in ranks:
        ids.setdefault(x + y, len(ids))
    table, names = B.PairTable(ids, ranks), {i: t for t, i in ids.items()}
    rows, want = [], []
    for n in range(1, 9):
        for k in range(2**n):
            word = ["ab"[k >> i & 1] for i in range(n)]
            assert B.merge(word, ranks) == plain(word)
            rows.append(word)
            want.append(plain(word))
    symbols = np.array([[ids[c] for c in w] + [0] * (8 - len(w)) for w in rows])
    got, alive = B.merge_many(symbols, np.array([len(w) for w in rows]), table)
    assert [[names[i] for i in r[a]] for r, a in zip(got, alive, strict=True)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_as_the_library(text):
    ids, decoded = _library(text)
    assert OWN.encode(text) == ids and OWN.decode(ids) == decoded


@pytest.mark.parametrize("text", [t or "" for _, t in ODD] + ["don't we'll I'VE 'S", "<|startoftext|>a<|endoftext|><|endoftext|> b", "İı ΣΣ ODOS ẞ", "a" * 5000])
def test_odd_texts(text):
    ids, decoded = _library(text)
    assert OWN.encode(text) == ids and OWN.decode(ids) == decoded
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert OWN.digests(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_long_texts_in_runs(monkeypatch):
    text = "Whole texts, never prefixes 123. " * 12000
    ids, decoded = _library(text)
    monkeypatch.setattr(B, "STEP", 777)
    assert OWN.digests(text)[0] == len(ids) and OWN.digests(text)[2] == hashlib.sha256(decoded.encode()).hexdigest()


def test_frames(spark):
    coded = B.encode(odd(spark), "doc_id", "text", PATH)
    assert [r.ids for r in coded.collect()] == [_library(t or "")[0] for _, t in ODD]
    assert [r.decoded for r in B.decode(coded, "doc_id", "ids", PATH).collect()] == [_library(t or "")[1] for _, t in ODD]
    assert B.digests(odd(spark, []), "doc_id", "text", PATH).count() == 0


def test_query_against_the_library(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    for r in B.op3_bpe(spark, sf_small).collect():
        ids, decoded = _library(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
