"""The vector search on rows unlike the given ones, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import ann


def tight(r, n, d):
    """Four fifths of all rows in one narrow cluster, which codes trained on the others cannot tell apart."""
    return np.where((np.arange(n) % 10 < 8)[:, None], r.normal(size=d) + r.normal(size=(n, d)) * 0.01, r.normal(size=(n, d)))


def apart(r, n, d):
    """Clusters, and queries that lie in none of them."""
    centres = r.normal(size=(40, d))
    return np.where((np.arange(n) % 50 == 0)[:, None], r.normal(size=(n, d)), centres[r.integers(0, 40, n)] + r.normal(size=(n, d)) * 0.05)


@pytest.mark.parametrize("kind", [tight, apart])
def test_recall(spark, kind):
    x = kind(np.random.default_rng(5), 6000, 32).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {}
    for row in ann.search(spark, df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    unit = ann.unit(x.astype(np.float64))
    hits = 0
    for q in range(0, 6000, 50):
        score = unit @ unit[q]
        score[q] = -9
        hits += len(got[q] & {*np.argsort(-score, kind="stable")[:5].tolist()})
    assert hits >= 0.97 * 600
