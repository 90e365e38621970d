"""Queries over the inverted-file index of the vectors."""

from __future__ import annotations

from geoloom.operators import vectors as V
from geoloom.plans.change import _vectors

LISTS, PROBES, ROUNDS, K = 16, 12, 2, 10


def ivf_knn(spark, sf_dir):
    """The ten nearest rows of every twentieth vector among those in the twelve of sixteen lists nearest to it.

    The test vectors lie in all directions alike, so a list holds few of a query's neighbours and many lists are probed;
    where vectors gather, a few are enough (tests/test_vectors.py has both).
    """
    v = _vectors(spark, sf_dir)
    return V.build_index(v, LISTS, ROUNDS).search(v.where("vec_id % 20 = 0"), K, PROBES)


def ivf_lists(spark, sf_dir):
    """How many vectors each list of the index holds."""
    v = _vectors(spark, sf_dir)
    return V.build_index(v, LISTS, ROUNDS).blocks.groupBy("list").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


_UNIT = "list_transform({0}, lambda x: x / sqrt(list_inner_product({0}, {0})))"
_NEAREST = "SELECT vec_id, arg_min(j, (-d, j)) AS j FROM (SELECT {0}.vec_id, c.j, round(list_inner_product({0}.v, c.c), 9) AS d FROM {0}, c{1} c) GROUP BY vec_id"


def _round(i: int) -> str:
    mean = f"SELECT j, list(m ORDER BY i) AS m FROM (SELECT a.j, i, avg(v[i]) AS m FROM a{i} a JOIN s USING (vec_id), range(1, (SELECT len(v) FROM s LIMIT 1) + 1) t(i) GROUP BY 1, 2) GROUP BY j"
    return f"a{i} AS ({_NEAREST.format('s', i)}), m{i} AS ({mean}), c{i + 1} AS (SELECT c.j, coalesce({_UNIT.format('m.m')}, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j)"


_INDEX = f"""u AS MATERIALIZED (SELECT vec_id, {_UNIT.format("(embedding::DOUBLE[])")} AS v, row_number() OVER (ORDER BY sha256(vec_id::VARCHAR), vec_id) AS rn FROM embeddings),
 s AS (SELECT * FROM u WHERE rn <= {LISTS * V.SAMPLE}), c0 AS (SELECT rn - 1 AS j, v AS c FROM s WHERE rn <= {LISTS}), {", ".join(_round(i) for i in range(ROUNDS))},
 own AS ({_NEAREST.format("u", ROUNDS)})"""
IVF_LISTS = f"WITH {_INDEX} SELECT j::INT AS list, count(*) AS n FROM own GROUP BY j"
IVF = f"""WITH {_INDEX},
 probes AS (SELECT u.vec_id, c.j FROM u, c{ROUNDS} c WHERE u.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_inner_product(u.v, c.c), 9) DESC, c.j) <= {PROBES}),
 f AS (SELECT p.vec_id AS query_id, r.vec_id, round(list_inner_product(q.v, r.v), 6) AS score FROM probes p JOIN own ON own.j = p.j JOIN u q ON q.vec_id = p.vec_id JOIN u r ON r.vec_id = own.vec_id WHERE p.vec_id <> r.vec_id)
 SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM f QUALIFY rank <= {K}"""

QUERIES = {"ivf_knn": ivf_knn, "ivf_lists": ivf_lists}
ORACLE = {"ivf_knn": IVF, "ivf_lists": IVF_LISTS}
