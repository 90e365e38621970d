from geoloom.llm import common


def test_sample_is_bounded_repeatable_and_whole_when_small(spark):
    rows = spark.range(20000).withColumnRenamed("id", "doc_id")
    some = sorted(r.doc_id for r in common.bounded_sample(rows, 2000, "doc_id").collect())
    assert 1600 <= len(some) <= 2000 and some == sorted(r.doc_id for r in common.bounded_sample(rows.repartition(7), 2000, "doc_id").collect())
    assert common.bounded_sample(rows, 20000, "doc_id").count() == 20000
    alike = spark.range(5000).selectExpr("1 AS doc_id")
    assert common.bounded_sample(alike, 100, "doc_id").count() <= 200


def test_materialize(spark):
    df = spark.createDataFrame([(1, [None, "a"], None)], "a int, b array<string>, c double")
    kept = common.materialize(df, "test")
    assert kept.schema == df.schema and kept.collect() == df.collect()
    assert common.materialize(df.limit(0), "test").count() == 0
