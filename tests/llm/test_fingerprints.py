import hashlib
import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.fingerprints import STEPS, WINDOW, edit_each, edited_neighbours, entropy_steps, fingerprint_each, fingerprints, likeness, rarity_ranks, read, steps_of_each

RANKS = np.arange(STEPS + 1, dtype=np.int32)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=WINDOW, max_size=300))
def test_entropy_of_every_window(data):
    got = entropy_steps(np.frombuffer(data, dtype=np.uint8))
    for i in range(len(data) - WINDOW + 1):
        c = Counter(data[i : i + WINDOW])
        h = -sum(v / WINDOW * math.log2(v / WINDOW) for v in c.values())
        assert abs(got[i] - h * STEPS / 6) <= 0.51


def test_working_together_changes_nothing():
    raws = [bytes(np.random.default_rng(i).integers(97, 110, size=n, dtype=np.uint8)) for i, n in enumerate((10, 64, 65, 5000, 0, 40_000, 300))]
    for raw, steps in zip(raws, steps_of_each(raws, chunk=6000), strict=True):
        assert steps is None if len(raw) < WINDOW else steps.tolist() == entropy_steps(np.frombuffer(raw, dtype=np.uint8)).tolist()


def test_likeness():
    rng = np.random.default_rng(4)
    words = [" ".join("".join(rng.choice(list("abcdefghij"), size=rng.integers(2, 9))) for _ in range(600)) for _ in range(6)]
    prints = fingerprint_each(words + ["", "a", "short text of some bytes"], RANKS)
    for p in prints:
        assert likeness(p.packed, p.packed) == 1.0 and read(p.digest).tolist() == p.packed.tolist()
    edits = edit_each(list(zip(prints[:5], prints[1:6], strict=True)), RANKS)
    for a, e, b in zip(prints, edits, prints[1:], strict=False):
        assert likeness(a.packed, e.packed) > 0.4 > 0.1 > likeness(a.packed, b.packed)
    assert likeness(prints[6].packed, prints[7].packed) == 0.0 and likeness(prints[6].packed, prints[6].packed) == 1.0


def test_neighbours_against_a_plain_version(spark):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("aé bcdefgh"), size=n)) for n in rng.integers(0, 900, size=60)] + ["", None, "x" * 5000]
    rows = [(int(i) * 37 - 500, t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(None, "nobody's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS extra", "'x' AS fingerprint")
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for per_bucket in (5, 1000):
        got = {r["doc_id"]: r for r in edited_neighbours(docs, rows_per_bucket=per_bucket).collect()}
        assert len(got) == len(rows)
        for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
            t, after = t or "", after or ""
            k = len(t) // 3
            assert got[i]["n_chars"] == len(t)
            assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
    ranks = rarity_ranks(docs)
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs, ranks=ranks).collect()}
    assert all(got[i]["fingerprint"] == alone[i] for i in got)


def test_ties_repeats_and_few_rows(spark):
    many = spark.createDataFrame([(i % 4, f"text {i % 8} " * 40) for i in range(64)], "doc_id long, text string")
    rows = edited_neighbours(many, rows_per_bucket=3).collect()
    assert len(rows) == 64
    one = edited_neighbours(spark.createDataFrame([(7, "abc def")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest() and one[0]["near_next"] == 1.0
    nulls = edited_neighbours(spark.createDataFrame([(None, "abc"), (None, "xyz")], "doc_id long, text string")).collect()
    assert len(nulls) == 2
    assert edited_neighbours(many.limit(0)).count() == 0
