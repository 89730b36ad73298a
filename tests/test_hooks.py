"""Hooks for models that stay outside, k-means and similarity with its fallbacks."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.functions import vectors
from colloquy.operators import hooks, retrieval


def _upper(texts):
    return [t.upper() for t in texts]


def _sizes(texts):
    return np.array([[len(t), 0.0, 1.0] for t in texts])


def _two_lines(texts):
    return ["a\nb" for _ in texts]


def test_texts(spark):
    rows = spark.createDataFrame([(0, "ab"), (1, None), (2, " ")], "i int, t string").repartition(1)
    found = rows.select("i", hooks.generated(F.col("t"), _upper).alias("g"), hooks.translated(F.col("t"), _upper).alias("l")).orderBy("i").collect()
    assert [(r["g"], r["l"]) for r in found] == [("AB", "AB"), (None, None), (" ", "")]
    for text, answer in (("a\nb", _upper), ("a", _two_lines)):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(text,)], "t string").select(hooks.translated(F.col("t"), answer)).collect()


def test_vectors(spark):
    rows = spark.createDataFrame([(0, "abc"), (1, None), (2, " ")], "i int, t string")
    found = [r["v"] for r in rows.select("i", hooks.encoded(F.col("t"), _sizes, dim=3).alias("v")).orderBy("i").collect()]
    assert np.allclose(found, [[3 / 10**0.5, 0, 1 / 10**0.5], [0, 0, 0], [0, 0, 0]])


def test_clusters(spark):
    points = [(i, [float(i % 2) * 9 + i / 100, 1.0]) for i in range(20)] + [(20, None), (21, [float("nan"), 1.0])]
    rows = spark.createDataFrame(points, "id int, vec array<double>")
    found = {r["id"]: r["cluster"] for r in retrieval.clusters(rows, k=2, seed=1).collect()}
    assert len({found[i] for i in range(0, 20, 2)}) == len({found[i] for i in range(1, 20, 2)}) == 1 and found[0] != found[1]
    assert found[20] is None and found[21] is None
    assert retrieval.clusters(rows.limit(0), k=2, seed=1).collect() == []


def test_similarity(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    fused = spark.createDataFrame([(1, 0.02), (1, 0.03)], "query_id int, rrf double")
    cosines = spark.createDataFrame([(1, 0.9), (2, 0.5), (2, 0.4)], "query_id int, cosine double")
    found = {r["query_id"]: (r["similarity"], r["kind"]) for r in retrieval.best_similarity(q, fused, cosines).collect()}
    assert found == {1: (0.03, "rrf"), 2: (0.5, "cosine"), 3: (0.0, "none")}
    row = q.limit(1).select(
        retrieval.idle_like(F.lit(0.025), F.lit(0.0301)).alias("a"), retrieval.idle_like(F.lit(0.025), F.lit(0.0299)).alias("b"), retrieval.idle_like(F.lit(None).cast("double"), F.lit(0.1)).alias("c"),
        vectors.unit_cosine(F.array(F.lit(1.0)), F.array(F.lit(-2.0))).alias("d"), vectors.unit_cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("e"),
    ).first()
    assert tuple(row) == (True, False, True, 0.0, 0.5)
