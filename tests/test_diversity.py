"""Diverse results against the greedy run over all candidates, plainly."""

import numpy as np

from geoloom.config import T
from geoloom.plans import registry


def test_diverse_rows_come_from_all_candidates(spark, sf_small):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect())
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    got = {(r.query_id, r.place): r.vec_id for r in registry.queries()["mmr_rank"](spark, sf_small).collect()}
    queries = [q for q in ids if q % 20 == 0]
    assert len(got) == 5 * len(queries)
    far = 0
    for q in queries:
        score = np.round(m @ m[ids == q][0], 6)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][: T.fetch_k]
        chosen = []
        while len(chosen) < 5:
            value = [-np.inf if i in chosen else T.mmr_lambda * score[i] - (1 - T.mmr_lambda) * max([m[i] @ m[c] for c in chosen], default=0) for i in order]
            chosen.append(order[int(np.argmax(value))])
        assert [got[q, p] for p in range(1, 6)] == ids[chosen].tolist()
        far += any(c not in order[:5] for c in chosen)
    assert far
