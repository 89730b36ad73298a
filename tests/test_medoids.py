"""Medoids of large groups and odd vectors against all pairs in numpy."""

import numpy as np
from pyspark.sql import functions as F

from colloquy.operators import retrieval


def brute(ids, x, k):
    means = [(round(float(np.sqrt(((x - v) ** 2).sum(axis=1)).mean()), 9), i) for i, v in zip(ids, x, strict=True)]
    return [i for _, i in sorted(means)[:k]]


def joined(plan):
    """The most rows that a join of an executed plan made."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return joined(plan.executedPlan())
    if "QueryStage" in name:
        return joined(plan.plan())
    made = plan.metrics().get("numOutputRows") if "Join" in name else None
    below = [joined(plan.children().apply(i)) for i in range(plan.children().size())]
    return max([made.get().value() if made is not None and made.isDefined() else 0, *below])


def test_large_group_without_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 6)).round(3)
    x[700:] += 4  # a second crowd
    x[100:120] = x[99]
    rows = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)], "id int, label string, vec array<double>")
    found = retrieval.medoids(rows, group="label", k=5)
    assert [r["id"] for r in sorted(found.collect(), key=lambda r: r["rank"])] == brute(range(len(x)), x, 5)
    assert joined(found._jdf.queryExecution().executedPlan()) < 100 * len(x)
    small = retrieval.medoids(rows, group="label", k=5, chunk=100)  # many chunks, some pairs of them with an empty side
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found.collect()))


def test_copies_and_ties_go_by_id(spark):
    rows = spark.createDataFrame([(i, "g", [float(i % 3), 1.0]) for i in range(9, -1, -1)], "id int, label string, vec array<double>")
    assert [r["id"] for r in sorted(retrieval.medoids(rows, group="label", k=3, chunk=1).collect(), key=lambda r: r["rank"])] == [1, 4, 7]


def test_rows_without_vector_come_last(spark):
    rows = spark.createDataFrame([(1, "g", None), (2, "g", [1.0, 2.0]), (3, "g", [4.0, 6.0]), (4, "g", [1.0, 2.0]), (5, "h", [float("nan")]), (6, "h", [1.0])], "id int, label string, vec array<double>")
    found = {r["id"]: (r["mean_distance"], r["rank"]) for r in retrieval.medoids(rows, group="label", k=9).collect()}
    assert {i: found[i] for i in (1, 2, 3, 4)} == {2: (1.666666667, 1), 4: (1.666666667, 2), 3: (3.333333333, 3), 1: (None, 4)}
    assert np.isnan(found[5][0]) and np.isnan(found[6][0])
    assert retrieval.medoids(rows.filter(F.lit(False)), group="label", k=3).collect() == []
