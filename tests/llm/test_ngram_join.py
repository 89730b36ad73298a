import random
import re

import numpy as np
import pytest

from colloquy.llm.ngram_join import Blocks, _Meeting, _packed, _parity, _unpacked, components, overlaps, shingle_set, similarity_components, word_hashes_of_each

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(((doc_id, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "Ü", "A", "a", "x y"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a b"), (4, "A b"), (5, "a b c"), (6, "w " * 50), (7, "W " * 70)]
    common = " ".join(rng.choices(words, k=40))
    for _ in range(12):  # groups of near copies around the threshold, some with a shared passage
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy) + (" " + common if rng.random() < 0.4 else "")))
    base = rng.choices(words, k=80)
    for i in range(40):  # a chain: each like its neighbours only
        rows.append((len(rows), " ".join(base[i : i + 60] + [str(x) for x in range(i)])))
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 70)])
def test_against_all_pairs(spark, seed, k, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS n")
    got = sorted(map(tuple, similarity_components(docs, k=k, percent=percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_shuffled_instead_of_broadcast_and_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (3, "a b c d e f g h i j k l m n o p q r s t u v"), (4, "A b c d e f g h i j k l m n o p q r s t u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85)
    for limit in (0, 1000):
        assert sorted(map(tuple, similarity_components(docs, k=4, percent=85, broadcast_docs=limit).collect()), key=str) == want
    assert similarity_components(docs.limit(0)).count() == 0


def test_a_long_text_is_hashed_in_parts():
    text = " ".join(f"word{i % 997}" for i in range(200_000)) + " " + "z" * 900_000 + " end"
    whole = word_hashes_of_each([text], chunk=1 << 30)[0]
    parts = word_hashes_of_each(["a", text, "b c"], chunk=5000)
    assert whole.tolist() == parts[1].tolist() and len(parts[0]) == 1 and len(parts[2]) == 2


def alike(x, y, percent):
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


@pytest.mark.parametrize("percent", [85, 80, 70, 50])
def test_blocks_of_linked_sets(percent):
    """Sets that link have as many equal signatures under the larger one's class as either tells, and one at least."""
    rng, plan, tried = random.Random(percent), Blocks(percent), 0
    pool = np.random.default_rng(1).integers(0, 1 << 63, size=5000, dtype=np.uint64).tolist()
    for _ in range(1500):
        n = rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 13, 20, 40, 90, 300])
        x = set(rng.sample(pool, n))
        y = set(x)
        for _ in range(rng.randint(0, 1 + n * (100 - percent) // 100)):
            (y.discard(rng.choice(sorted(y))) if rng.random() < 0.5 and len(y) > 1 else y.add(rng.choice(pool)))
        if x == y or not alike(x, y, percent):
            continue
        tried += 1
        (sx, gx), (sy, gy) = (plan.signatures(np.array(sorted(s), dtype=np.uint64)) for s in (x, y))
        c = plan.first(max(len(x), len(y)))
        equal = [g for g in set(gx.tolist()) & set(gy.tolist()) if g >> 56 == c]
        need = max(sx[c - plan.first(len(x))], sy[c - plan.first(len(y))])
        assert len(equal) >= (need if need > 0 else -need) >= 1
    assert tried > 200


def test_parity_bound():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ({rng.randrange(300) for _ in range(rng.randint(1, 90))} for _ in range(2))
        x, y = (shingle_set(word_hashes_of_each([" ".join(map(str, s))])[0], 1) for s in (a, b))
        bits = sum(bin(int(p) & (1 << 64) - 1 ^ int(q) & (1 << 64) - 1).count("1") for p, q in zip(_parity(x), _parity(y), strict=True))
        assert bits <= len(a ^ b)


def test_entries_round_trip_and_meet():
    rng = np.random.default_rng(3)
    sig, node = rng.integers(0, 1 << 63, size=400, dtype=np.uint64) % np.uint64(150), rng.integers(-9, 9, size=400)
    back = _unpacked(_packed(sig, node))
    assert sorted(zip(*map(np.ndarray.tolist, back), strict=True)) == sorted(zip(sig.tolist(), node.tolist(), strict=True))
    want = {(s, n) for s in set(sig.tolist()) for n in set(node[sig == s].tolist()) if len(set(node[sig == s].tolist())) > 1}
    for step in (400, 37, 1):
        state, got = _Meeting(), set()
        for i in range(0, 400, step):
            got |= set(zip(*map(np.ndarray.tolist, state.meet(sig[i : i + step], node[i : i + step])), strict=True))
        assert got == want


def test_overlaps_against_counting():
    rng = random.Random(5)
    for percent in (50, 85):
        for _ in range(60):
            pool = [rng.getrandbits(64) for _ in range(80)]
            head = set(rng.sample(pool, rng.randint(1, 60)))
            others = [set(rng.sample(sorted(head), rng.randint(1, len(head)))) | set(rng.sample(pool, rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
            arrays = [np.array(sorted(s), dtype=np.uint64) for s in (head, *others)]
            assert overlaps(arrays[0], arrays[1:], percent).tolist() == [alike(head, o, percent) for o in others]


def test_components_broadcast_or_shuffled(spark):
    rng = random.Random(8)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(12)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(25)]
    links = [(a, b) for a, b in links if a != b]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(links, "a long, b long")
    for most in (0, 1000):
        assert {r["node"]: r["label"] for r in components(frame, most, salts=3).collect()} == label


def test_crowds_of_half_alike_documents(spark):
    """Many documents that share passages, few of which link, whatever counts as a crowd; groups of one hub each."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    passages = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    rows = [(i, " ".join([passages[i % 3], *rng.choices(words, k=25)])) for i in range(60)]
    base = rng.choices(words, k=100)
    for i in range(60):
        copy = list(base)
        for j in range(2):
            copy[(i * 7 + j * 13) % 100] = f"z{i}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200, rows[3][1]), (201, rows[3][1] + " x"), (202, rows[100][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85)
    for crowd, rounds in ((64, 2), (1, 1)):
        assert sorted(map(tuple, similarity_components(docs, k=4, percent=85, crowd=crowd, rounds=rounds).collect()), key=str) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_least_sets_of_a_class_leave_their_weak_blocks_out(percent):
    """Sets that give all their blocks meet in empty ones, all with all; those just under a class's sizes did."""
    rng, plan, tried = np.random.default_rng(percent), Blocks(percent), 0
    for c, low in enumerate(plan.low[:26]):
        n = -(-low * percent // 100)
        if plan.plan[c][0] and c in plan.classes(n):
            given = [plan.signatures(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)))[0][c - plan.first(n)] for _ in range(20)]
            tried += 1
            assert sum(x < 0 for x in given) <= 2, (c, n)
    assert tried > 15
