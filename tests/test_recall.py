"""Recall of the hashed neighbours against brute force."""

import duckdb
import numpy as np
import pytest

from scoreloom.catalog import load
from scoreloom.models import neighbors

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bucket", [None, 0.0625])
def test_recall_of_hashed_neighbors(spark, bucket):
    found = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall()
    ids, vectors = np.array([i for i, _ in found]), np.array([v for _, v in found], float)
    distance = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    left, right = np.nonzero((distance <= 1.1) & (ids[:, None] != ids[None]) & (ids % 5 != 0)[None])
    want = set(zip(ids[left].tolist(), ids[right].tolist()))
    if bucket is None:
        rows = load()["approximate_neighbor_pairs"].run(spark, DATA)
    else:
        points = spark.read.parquet(f"{DATA}/embeddings.parquet")
        rows = neighbors.approximate_neighbors(points, points.filter("vec_id % 5 <> 0"), "vec_id", "embedding", 1.1, bucket)
    got = {(r["vec_id"], r["neighbor"]) for r in rows.collect()}
    print(f"{len(got)} of {len(want)} pairs, bucket {bucket}")
    assert len(want) > 50 and got <= want and len(got) >= 0.9 * len(want)


def test_hashed_neighbors_are_those_of_the_join(spark):
    """Spark's own join makes a row of every pair that shares a bucket; here only pairs within the radius become rows."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    points = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    rows = neighbors.approximate_neighbors(points, points, "vec_id", "embedding", 1.15, 0.0625, 3)
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
    vectors = points.select("vec_id", array_to_vector(points.embedding.cast("array<double>")).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=0.0625, numHashTables=3, seed=1).fit(vectors)
    want = model.approxSimilarityJoin(vectors, vectors, 1.15, "distance").selectExpr("datasetA.vec_id AS a", "datasetB.vec_id AS b", "distance")
    pairs = {(r.a, r.b): r.distance for r in want.filter("a <> b").collect()}
    got = {(r["vec_id"], r["neighbor"]): r["distance"] for r in rows.collect()}
    assert len(pairs) > 20 and got.keys() == pairs.keys() and all(abs(got[k] - pairs[k]) < 1e-9 for k in got)
