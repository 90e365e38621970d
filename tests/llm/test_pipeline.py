import corpus_pipeline as P
import test_lines
import test_simhash
import test_templates
from cases import odd
from tokenizers import Tokenizer

from geoloom.llm import bpe, language, simhash


def _similar(docs):
    """The least id of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more, by all pairs."""
    sets = []
    for _, t in docs:
        words = [w.lower() for w in (t or "").encode().split()]
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                high, low = sorted((find(i), find(j)), reverse=True)
                root[high] = low
    return {docs[find(i)][0] for i in range(len(docs))}


def test_stages_against_plain_python(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    model = language.train(docs)
    kept = {i for (i, _), (lang, share) in zip(texts, language.Labeller(model).predict(t for _, t in texts), strict=True) if lang != "und" and share >= P.LEAST_SHARE}
    one = P.identify(spark, docs, sf_small).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept and len(kept) > 0.9 * len(texts)
    two = P.dedup_lines(spark, one, sf_small).cache()
    rows = sorted((r.doc_id, r.text) for r in two.collect())
    assert two.columns == columns and [t for _, t in rows] == test_lines._slow([x for x in texts if x[0] in kept])
    assert all(r.n_chars == len(r.text) for r in two.collect() if r.text != dict(texts)[r.doc_id])
    three = P.dedup_near(spark, two, sf_small).cache()
    stay = {r.doc_id for r in three.collect()}
    assert three.columns == columns and stay == _similar(rows)
    four = P.decontaminate(spark, three, sf_small).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    left = [x for x in rows if x[0] in stay]
    bad = {i for i, _ in test_templates._slow(left, items)}
    assert four.columns == columns and {r.doc_id for r in four.collect()} == stay - bad
    library = Tokenizer.from_file(bpe.vocabulary_path())
    tokens = {r.doc_id: r.n_tokens for r in P.encode(spark, four, sf_small).collect()}
    assert tokens == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in left if i not in bad}


def test_run_writes_every_stage(spark, sf_small):
    rows = P.run(spark, sf_small).collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "n_tokens"} and len({r.doc_id for r in rows}) == len(rows)


def test_odd_rows(spark, sf_small):
    docs = odd(spark)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_small).columns == docs.columns
        assert stage(spark, odd(spark, []), sf_small).count() == 0
    assert P.dedup_near(spark, docs, sf_small).count() == len({t or "" if (t or "").strip() else "" for _, t in test_simhash.ODD})


CLASHING = ["score", "lang_pred", "__id", "__hash", "__kept", "__lines", "__gone", "a.b", "row", "id", "hash", "new_text", "n_gone", "marks", "c0", "tick`", "first", "gone_id", "spans"]


def test_columns_of_any_name(spark, sf_small):
    docs = odd(spark).selectExpr("*", *(f"{i} AS `{c.replace('`', '``')}`" for i, c in enumerate(CLASHING)), "named_struct('doc_id', 1, 'a.b', text) AS nested", "CAST(NULL AS array<string>) AS empty")
    plain = odd(spark)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.schema == docs.schema
        rows = out.collect()
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == sorted((str(r["doc_id"]), str(r["text"])) for r in stage(spark, plain, sf_small).collect())
        assert all(r[c] == i for r in rows for i, c in enumerate(CLASHING)) and all(r["nested"]["doc_id"] == 1 for r in rows)
    assert P.encode(spark, docs, sf_small).count() == docs.count()
