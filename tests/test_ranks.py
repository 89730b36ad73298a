"""Ranks within large groups against plain sorting."""

from collections import defaultdict

from pyspark.sql import functions as F

from colloquy.operators import retrieval, sampling

ROWS = [(i, "big" if i % 5 else None if i % 10 else "small") for i in range(400)]


def groups():
    out = defaultdict(list)
    for i, g in ROWS:
        out[g].append(i)
    return out


def test_retention(spark):
    rows = spark.createDataFrame(ROWS, "id int, g string")
    want = sorted(i for ids in groups().values() for i in sorted(ids)[:-7])
    assert sorted(r["id"] for r in sampling.keep_newest(rows, group="g", order="id", keep=7).collect()) == want
    spared = sampling.keep_newest(rows, group="g", order="id", keep=7, spared=F.col("id") < 2).collect()
    assert sorted(r["id"] for r in spared) == [i for i in want if i >= 2]
    assert sampling.keep_newest(rows.limit(0), group="g", order="id", keep=7).collect() == []


def test_rank_in_group(spark):
    rows = spark.createDataFrame([(i, g) for i, g in ROWS if g], "id int, g string").withColumn("d", F.md5(F.col("id").cast("string")))
    found = sampling.rank_in_group(rows, "at", group="g", digest="d", ties=("id",), digits=1).collect()
    for g in ("big", "small"):
        mine = sorted((r["d"], r["id"], r["at"]) for r in found if r["g"] == g)
        assert [at for *_, at in mine] == list(range(len(groups()[g])))


def test_holdout(spark):
    rows = spark.createDataFrame(ROWS, "id int, g string")
    found = sampling.holdout_by_group(rows, group="g", ids=("id",), per_group=4, total=9, seed="1").collect()
    held = [r["g"] for r in found if r["part"] == "val"]
    assert len(found) == len(ROWS) and len(held) == 9 and max(held.count(g) for g in groups()) <= 4


def test_reference_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 3), 1.0]) for i in range(30)], "id int, vec array<double>")
    refs = spark.createDataFrame([(j, [float(j), 1.0, 2.0]) for j in range(12)], "class int, vec array<double>")
    one, many = (sorted(map(tuple, retrieval.reference_class(rows, refs, block=b).collect())) for b in (1000, 3))
    assert one == many and len(one) == 30
    assert {tuple(r)[1:] for r in retrieval.reference_class(rows, refs.limit(0)).collect()} == {(None, None)}
