import zlib

import numpy as np
import pytest

from colloquy.llm.packing import WordTokenizer, pack, sum_of_squares, tokenize_pieces

tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "Hello, World! it's 3 o'clock.", "", "   ", "Éclair, çà et là. Naïve façade: 123,456.78!!", "á éclair Å ſtraße", "İstanbul ΣΑΣ σας ΟΔΟΣ",
    "tab\tnew\nline\x1cfs\x1dgs nbsp　wide ls\x85nel", "<|endoftext|> and x<|startoftext|>y", "日本語のテキスト、と English。", "don't we'll I'D they'Ve 'tis", "... ,. .,a. b., c..", "x" * 3000,
    "emoji 😀😀 ok 👩‍👩‍👧", "mixed123abc 4five _under_score", "İŉſŸ ŸØå",
]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    for t in TEXTS + TEXTS:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_random_words_are_those_of_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    rng, plain, ours = random.Random(5), Tokenizer.from_file(PATH), WordTokenizer(PATH, most_words=50)
    parts = ["th", "ing", "er", "é", "sch", "ä", "SS", "ñ", "tion", ".", ",", "'s", "1", "-", "Q"]
    for _ in range(300):
        t = " ".join("".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(10))
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def check_places(lengths, sequence, offset, capacity):
    places = {}
    for n, s, o in zip(lengths, sequence, offset, strict=True):
        places.setdefault(s, []).append((o, n))
    for parts in places.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(places)


def test_rule_against_a_plain_version():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 30, size=200)
    gaps, bins = [], []
    for n in sorted(lengths.tolist(), reverse=True):
        count = {g: sum(x == g for x in gaps) for g in range(1, 30)}

        def total(c):
            return sum(v * v for v in c.values())

        best = None
        for g in [n, *range(n + 1, 30), None]:
            c = dict(count)
            if g is None:
                c[30 - n] = c.get(30 - n, 0) + 1
            elif count.get(g, 0):
                c[g] -= 1
                if g > n:
                    c[g - n] += 1
            else:
                continue
            if best is None or total(c) < best[0]:
                best = (total(c), g)
        if best[1] is None:
            gaps.append(30 - n)
        else:
            gaps[gaps.index(best[1])] -= n
        bins.append(best[0])
    sequence, offset = sum_of_squares(lengths, 30)
    n = check_places(lengths, sequence, offset, 30)
    assert n == len(gaps)


def test_pieces_and_places(spark):
    texts = [*TEXTS, None, "word " * 9001, "word " * 9001]
    docs = spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS offset")
    rows = pack(tokenize_pieces(docs, tokenizer_path=PATH, capacity=64, with_ids=True), capacity=64, shard_rows=20).collect()
    check_places([r["length"] for r in rows], [r["sequence_id"] for r in rows], [r["offset"] for r in rows], 64)
    ours = WordTokenizer(PATH)
    for i, t in enumerate(texts):
        want = np.frombuffer(ours.encode(t or ""), "<u4").tolist() + [1]
        mine = sorted((r for r in rows if r["doc_id"] == (i if i != 2 else None)), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == want
        assert [r["start"] for r in mine] == list(range(0, len(want), 64)) and all(r["length"] == 64 for r in mine[:-1])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    assert pack(tokenize_pieces(docs.limit(0), tokenizer_path=PATH)).count() == 0


def test_few_sequences():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 4095)
    sequence, offset = sum_of_squares(lengths, 4096)
    assert check_places(lengths, sequence, offset, 4096) <= 1.005 * lengths.sum() / 4096 + 1


def test_idle_workers_hold_no_words(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 4)), "doc_id long, text string").repartition(4)
    assert tokenize_pieces(docs, tokenizer_path=PATH).count() == len(TEXTS) * 4

    def held(batches):
        import pyarrow as pa

        from colloquy.llm.packing import _loaded

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(t.known) for t in _loaded.values())] * batch.num_rows})

    assert all(r["n"] == 0 for r in spark.range(0, 64, 1, 4).mapInArrow(held, "n bigint").collect())
