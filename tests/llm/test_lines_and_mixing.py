import math
import random
import re

import pytest

from colloquy.llm.line_dedup import boilerplate_lines, drop_boilerplate
from colloquy.llm.mixing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_docs(spark):
    rows = [(i, f"own {i}\nCopyright\n\nshared by two {i // 2}", "a") for i in range(40)]
    rows += [(100 + i, "Copyright", "b") for i in range(4)] + [(200, None, "a"), (201, "", None), (202, "x\nCopyright", None), (0, rows[0][1], "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_lines", "'h' AS host", "2 AS line_hash")


def brute_lines(rows, ratio, least):
    pages, drop = {}, set()
    for _, text, host in rows:
        if text is not None:
            pages.setdefault(host, set()).add(text)
    for host, texts in pages.items():
        count = {}
        for t in texts:
            for line in {x for x in t.split("\n") if x.strip(" ")}:
                count[line] = count.get(line, 0) + 1
        drop |= {(host, k) for k, n in count.items() if n >= least and n > ratio * len(texts)}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or (h, x) not in drop)) for i, t, h in rows]


@pytest.mark.parametrize("limit", [0, 10_000])
def test_line_dedup_against_brute_force(spark, limit):
    docs = line_docs(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = drop_boilerplate(docs, broadcast_lines=limit).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(brute_lines(rows, 0.05, 5), key=str)
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["n_lines"], first["n_dropped"], first["text"]) == (4, 1, "own 1\n\nshared by two 0")
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in got}[200] == (0, 0)
    assert drop_boilerplate(docs.limit(0)).count() == 0


def test_copies_are_one_page(spark):
    docs = spark.createDataFrame([(i, "same\ntext", "a") for i in range(50)], "doc_id long, text string, source string")
    assert boilerplate_lines(docs).count() == 0


def brute_targets(sizes, shares=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in capped)
        total = sum(w for s, w in weight.items() if s not in capped)
        target = {s: cap * sizes[s] if s in capped else left * weight[s] / total for s in names} if total else {s: cap * sizes[s] for s in names}
        over = {s for s in names if s not in capped and target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def mix_docs(spark, seed=1):
    rng = random.Random(seed)
    rows, n = [], 0
    for source, count in (("a", 300), ("b", 30), ("c", 120), ("Z", 5), (None, 40), ("d", 0), ("e", 80)):
        for _ in range(count):
            rows.append((n, " ".join(["w"] * rng.randint(0, 60)), source))
            n += 1
    rows += [(None, "a b c", "a"), (n, None, "a"), (3, rows[3][1], "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "9 AS size", "'x' AS target"), rows


def test_mix_against_brute_force(spark):
    docs, rows = mix_docs(spark)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = brute_targets(sizes)
    got = mix(docs, rows_per_bucket=10).collect()
    assert len(got) == len(rows)
    for source in sizes:
        mine = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in mine} == {sizes[source]}
        assert all(math.isclose(r["target"], target[source]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[source]) <= max(r["size"] for r in mine) * 2
        whole = int(target[source] // sizes[source]) if sizes[source] else 0
        assert {r["copies"] for r in mine if r["size"]} <= {whole, whole + 1} and all(r["taken"] <= 3 * r["size"] for r in mine)
    again = mix(docs.repartition(7), rows_per_bucket=10, broadcast_sources=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mix(docs, rows_per_bucket=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, other))


def test_quality_weights_favour(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 10, "a") for i in range(1000)] + [(2000 + i, "w " * 10, "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), shares=(1, 3)).filter("source = 'a' AND taken > 0").collect()
    even = sum(r["doc_id"] % 2 == 0 for r in got)
    assert 480 <= len(got) <= 520 and even > 0.6 * len(got)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(blank).collect()] == [0, 0]
