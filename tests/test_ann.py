"""The inverted-file index against the exact search."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ann, vectors

SMALL = Path("/root/testdata/sf0.001")


def table(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered(spark):
    """1,500 vectors around 30 places, some odd rows, and 16 queries."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 24)) * 4
    rows = [(i, centers[i % 30] + rng.normal(size=24)) for i in range(1500)]
    odd = [(-1, None), (-2, []), (-3, [1.0] * 23), (-4, [0.0] * 24), (7, rows[7][1])]
    df = table(spark, rows + odd).repartition(3).cache()
    asked = df.where("vec_id >= 0 AND vec_id % 97 = 0 AND size(embedding) = 24").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return df, asked, ann.build(df, lists=30, parts=8, codes=32, rounds=4)


def mean_recall(found, exact, k=10):
    return ann.recall(found, exact, k).agg(F.avg("recall")).first()[0]


def test_recall_and_exact_scores(clustered):
    df, asked, index = clustered
    exact = vectors.top_k(df, asked, 50)
    found = ann.search(index, asked, 10).cache()
    assert mean_recall(found, exact) >= 0.9 and index.nprobe < 15
    counts = {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()}
    assert counts == {i * 97: 10 for i in range(16)}
    wrong = found.join(exact.withColumnRenamed("score", "exact"), ["query_id", "id"]).where(F.abs(F.col("score") - F.col("exact")) > 1e-8)
    assert wrong.count() == 0


def test_more_lists_and_candidates_find_all(clustered):
    df, asked, index = clustered
    found = ann.search(index, asked, 10, nprobe=30, refine=200)
    key = lambda r: (r["query_id"], r["rank"], r["id"], round(r["score"], 7))
    assert sorted(map(key, found.collect())) == sorted(map(key, vectors.top_k(df, asked, 10).collect()))


def test_every_vector_is_indexed_once_and_lists_are_pruned(clustered):
    df, asked, index = clustered
    whole = df.where("size(embedding) = 24")
    assert sorted(r["id"] for r in index.rows().select("id").collect()) == sorted(r["vec_id"] for r in whole.collect())
    assert index.sizes.sum() == 1502 and len(index.sizes) == 30
    plan = ann.search(index, asked.limit(1), 5, nprobe=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ReadSchema: struct<id:bigint,vector:array<double>>" in plan  # codes are not read again for the exact scores


def test_more_lists_are_probed_until_there_are_k_rows(clustered):
    _, asked, index = clustered
    found = ann.search(index, asked, 300, nprobe=1, refine=1)
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {300}


def test_a_saved_index_answers_alike(clustered, spark):
    _, asked, index = clustered
    again = ann.load(spark, index.path)
    assert again.nprobe == index.nprobe and np.array_equal(again.sizes, index.sizes)
    assert sorted(map(tuple, ann.search(again, asked).collect())) == sorted(map(tuple, ann.search(index, asked).collect()))


def test_dot_products_empty_tables_and_few_rows(spark, clustered):
    df, asked, _ = clustered
    dots = ann.build(df, lists=10, parts=5, codes=16, metric="dot", rounds=2)  # 24 is no multiple of 5
    assert mean_recall(ann.search(dots, asked, nprobe=10, refine=40), vectors.top_k(df, asked, 10, metric="dot")) >= 0.9
    none = ann.build(table(spark, []))
    assert none.sizes.sum() == 0 and ann.search(none, asked).count() == 0
    two = ann.build(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]))
    asks = spark.createDataFrame([(1, [1.0, 0.2]), (2, None), (3, [1.0])], "query_id long, vector array<float>")
    assert [(r["query_id"], r["id"], r["rank"]) for r in ann.search(two, asks).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_recall_on_the_given_vectors(spark):
    """These vectors lie in no clusters, so most lists are needed; the index finds that out."""
    from plumbline.plans import retrieval

    exact = retrieval.first_ranker(spark, str(SMALL), 10)
    found = retrieval.vec2_index_search(spark, str(SMALL))
    assert mean_recall(found, exact) >= 0.9 and found.count() == 50
