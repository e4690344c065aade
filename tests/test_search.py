"""Nearest vectors and other searches by an index, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityjobs.operators import cells, retrieval, urls


def slow_nearest(queries, vectors, k):
    out = []
    for q, a in queries:
        found = sorted((round(1 - float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 4) + 0.0, v) for v, b in vectors)
        out += [(q, v, d, rank) for rank, (d, v) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_nearest_by_cells_are_those_of_all_pairs(spark, monkeypatch, spread):
    """Clustered and shapeless vectors; a third of the rows are one vector, so that its cell is cut."""
    monkeypatch.setattr(retrieval, "FIT_ROWS", 200)
    monkeypatch.setattr(retrieval, "FIT_ROWS_A_CELL", 10)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(15, 6))
    rows = [(i, (centres[i % 15] + spread * rng.normal(size=6)).astype(np.float32)) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]
    met = []
    monkeypatch.setattr(retrieval, "meet", lambda r, a, p, b, run, schema: met.append(p) or cells.meet(r, a, p, b, run, schema, 50, 9))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in rows] + [(5000, None), (5001, [0.0] * 6)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(map(tuple, retrieval.knn_topk(queries, vectors, 7).collect()))
    want = slow_nearest([(i, v.astype(float)) for i, v in rows if i % 10 == 0], [(i, v.astype(float)) for i, v in rows], 7)
    assert got == want
    if spread < 1:  # most cells are ruled out
        assert met[1].count() < 0.3 * 15 * 60
    some = sorted(map(tuple, retrieval.knn_topk(queries, vectors, 3, F.col("vec_id") < 100).collect()))
    assert some == slow_nearest([(i, v.astype(float)) for i, v in rows if i % 10 == 0], [(i, v.astype(float)) for i, v in rows if i < 100], 3)


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "local-cluster[3,2,1024]"

    with pytest.raises(ValueError):
        urls.shared_folder(Cluster)
    assert urls.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
