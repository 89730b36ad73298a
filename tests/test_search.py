"""Searches by products of matrices against pairs one by one, with copies, ties and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from colloquy.operators import retrieval
from tests.test_medoids import joined

DIM = 64


def table(spark, x, name, ids=None):
    rows = [(i, None if v is None else [None if n is None else float(n) for n in v]) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, f"{name}_id long, {name}_vec array<double>")


def crowd(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIM)) / 8
    x[n // 2 : n // 2 + n // 4] = x[0]  # a common vector
    x[5] = x[6] + 2e-10  # alike to the ninth digit
    return x


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """3,000 vectors, of which 30 ask."""
    path = str(tmp_path_factory.mktemp("large"))
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), i // 100 % 10) for i, v in enumerate((rng.normal(size=(3_000, DIM)) / 8).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{path}/embeddings.parquet")
    return path


def counted(spark, name, path):
    """How many rows a query has, and the most that a join in it made."""
    found = __spark_entry__.queries()[name](spark, path)
    return len(found.collect()), joined(found._jdf.queryExecution().executedPlan())


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def without_products(name):
    """The rankings of all pairs, cut to k after that."""
    return lambda q, x, k: {"nearest": retrieval.nearest, "most_alike": retrieval.most_alike}[name](q, x, k=None).filter(F.col("rank") <= k)


@pytest.mark.parametrize("name", ["nearest", "most_alike"])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_search_is_exact(spark, name, k):
    x = crowd(300)
    items, queries = table(spark, x, "item"), table(spark, x[::50], "query", range(0, 300, 50))
    assert rows_of(getattr(retrieval, name)(queries, items, k=k)) == rows_of(without_products(name)(queries, items, k))
    assert rows_of(getattr(retrieval, name)(queries, items, k=k, most_queries=2)) == rows_of(without_products(name)(queries, items, k))


@pytest.mark.parametrize("name", ["nearest", "most_alike"])
def test_odd_vectors(spark, name):
    x = [list(v) for v in crowd(60)]
    x[3], x[4], x[7], x[8], x[10] = None, [1.0], [float("nan")] + x[7][1:], [1e200] * DIM, [None] + x[10][1:]
    items, queries = table(spark, x, "item"), table(spark, x[:12], "query")
    assert rows_of(getattr(retrieval, name)(queries, items, k=5)) == rows_of(without_products(name)(queries, items, 5))
    found = {r["item_id"]: r["rank"] for r in retrieval.nearest(queries.filter("query_id = 0"), items, k=60).collect()}
    assert {found[i] for i in (3, 4, 10)} == {58, 59, 60}  # without a distance: the last
    assert getattr(retrieval, name)(queries.limit(0), items, k=5).collect() == [] == getattr(retrieval, name)(queries, items.limit(0), k=5).collect()


@pytest.mark.parametrize("odd", [False, True])
def test_fused_rankings(spark, odd):
    x = [list(v) for v in crowd(300)]
    queries = table(spark, [*x[::50], None], "query", [*range(0, 300, 50), 999])
    if odd:
        x[9] = None
    items = table(spark, x, "item")
    ranks = [f(queries, items, k=None).select("query_id", "item_id", "rank") for f in (retrieval.nearest, retrieval.most_alike)]
    want = retrieval.fuse(*ranks)
    assert rows_of(retrieval.fused_rankings(queries, items)) == rows_of(want.select("query_id", "item_id", F.round("rrf", 9).alias("rrf")))
    best = rows_of(want.filter("query_id <> item_id").groupBy("query_id").agg(F.max("rrf").alias("rrf")))
    assert rows_of(retrieval.best_fused(queries, items)) == best == rows_of(retrieval.best_fused(queries, items, most_items=10, most_queries=3))


def test_large_values_and_one_item(spark):
    x = crowd(40) * 1e6
    items, queries = table(spark, x, "item"), table(spark, x[:3], "query")
    ranks = [f(queries, items, k=None).select("query_id", "item_id", "rank") for f in (retrieval.nearest, retrieval.most_alike)]
    assert rows_of(retrieval.fused_rankings(queries, items)) == rows_of(retrieval.fuse(*ranks).withColumn("rrf", F.round("rrf", 9)))
    one = items.filter("item_id = 0")
    assert retrieval.best_fused(queries.filter("query_id = 0"), one).collect() == []
    assert [r["rrf"] for r in retrieval.fused_rankings(queries.filter("query_id = 0"), one).collect()] == [round(2 / 61, 9)]


def test_rrf_fusion_joins_no_pairs(spark, large):
    n, pairs = counted(spark, "rrf_fusion", large)
    assert n == 30 * 3000 and pairs < 10_000


def test_best_similarity_joins_no_pairs(spark, large):
    n, pairs = counted(spark, "best_similarity", large)
    assert n == 30 and pairs < 10_000


def test_hybrid_rank_joins_no_pairs(spark, large):
    n, pairs = counted(spark, "hybrid_rank", large)
    assert n == 150 and pairs < 10_000


def test_knn_topk_joins_no_pairs(spark, large):
    n, pairs = counted(spark, "knn_topk", large)
    assert n == 240 and pairs < 10_000


def test_bm25_of_k_is_that_of_all(spark):
    texts = ["common " * (i % 3 + 1) + " ".join(f"w{(i * j) % 37}" for j in range(i % 11)) for i in range(200)] + ["common w1 w2"] * 150 + [None, "", "other"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string").repartition(3)
    queries = spark.createDataFrame([(0, "common w1 W1 w5"), (1, "w2 w3 absent"), (2, None), (3, "absent"), (4, "common")], "query_id int, query_text string")
    every = retrieval.bm25(queries, items)
    want = retrieval.top_k(every.withColumn("score", F.round("score", 6)), 5, F.col("score").desc(), F.col("item_id"))
    for most in (2000, 2):
        some = retrieval.bm25(queries, items, k=5, digits=6, most_queries=most)
        assert some.count() < 100 < every.count()
        assert rows_of(retrieval.top_k(some.withColumn("score", F.round("score", 6)), 5, F.col("score").desc(), F.col("item_id"))) == rows_of(want)
    assert retrieval.bm25(queries, items.limit(0), k=5).collect() == [] == retrieval.bm25(queries.limit(0), items, k=5).collect()


def test_bm25_topk_shuffles_no_words_of_items(spark):
    found = __spark_entry__.queries()["bm25_topk"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(found.collect()) == 200 and "Join" not in plan and plan.count("Exchange") == 1  # the candidates, by query
