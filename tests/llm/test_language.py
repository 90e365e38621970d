from collections import Counter

import numpy as np
from cases import ODD, odd

from geoloom.llm import language as L


def _plain_viterbi(scores):
    n, k = scores.shape
    best, back = scores[0].astype(float), []
    for t in range(1, n):
        step = [[best[i] - (L.SWITCH if i != j else 0) for i in range(k)] for j in range(k)]
        back.append([int(np.argmax(s)) for s in step])
        best = np.array([max(s) for s in step]) + scores[t]
    labels = [int(best.argmax())]
    for b in reversed(back):
        labels.append(b[labels[-1]])
    return best.max(), labels[::-1]


def _value(scores, labels):
    return sum(scores[i, j] for i, j in enumerate(labels)) - L.SWITCH * sum(a != b for a, b in zip(labels, labels[1:]))


def test_viterbi_over_many_texts_finds_the_best_labelling():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 1, 30, 12, 1])
    scores = (rng.normal(size=(sizes.sum(), 3)) * 6).astype(np.float32)
    labels, at = L.viterbi(scores, sizes), 0
    for n in sizes:
        part = scores[at : at + n]
        if n:
            best, _ = _plain_viterbi(part)
            assert abs(_value(part, labels[at : at + n].tolist()) - best) < 1e-3
        at += n


TRAIN = [(i, "the cat and the dog are in the house with another thing", "en") for i in range(10, 30)] + [(i, "der Hund und die Katze sind nicht in dem Haus gewesen", "de") for i in range(30, 50)] + [(i, "кошка и собака были дома", "ru") for i in range(50, 70)]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, score int")


def test_spans_of_mixed_text(spark):
    model = L.train(_frame(spark, TRAIN))
    assert model.langs == ["de", "en", "ru"]
    text = "the dog and the cat are in another house. Der Hund und die Katze sind nicht gewesen. собака и кошка"
    found = [(text[s:e].split()[0], lang) for s, e, lang in L.Labeller(model).spans(text)]
    assert found == [("the", "en"), ("Der", "de"), ("собака", "ru")]


def test_odd_rows(spark):
    model = L.train(_frame(spark, TRAIN))
    rows = L.predict(odd(spark), "text", model, ["doc_id", "key"]).collect()
    assert [r.doc_id for r in rows] == [i for i, _ in ODD] and {r.key for r in rows} == {"k"}
    assert [r.lang_pred for r in rows][1:3] == ["und", "und"] and rows[0].lang_pred == rows[3].lang_pred in model.langs and rows[-1].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in rows) and L.predict(odd(spark, []), "text", model, ["doc_id"]).count() == 0
    nothing = L.train(_frame(spark, [(None, "a", "en"), (1, "a", None)]))
    assert {r.lang_pred for r in L.predict(odd(spark), "text", nothing, ["doc_id"]).collect()} == {"und"}
    assert len(L.spans(odd(spark), "text", model, ["doc_id"]).collect()) == len(ODD)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in L.op10_language(spark, sf).collect() if r.held_out]
    right = Counter(r.lang_pred == true[r.doc_id] for r in rows)
    assert right[True] / len(rows) > 0.95
