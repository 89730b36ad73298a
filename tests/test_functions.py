"""Literal cases of Column functions and operators."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import scores, text, vectors
from colloquy.functions.similarity import echo_ratio, is_echo, redundant
from colloquy.operators import conversations as conv
from colloquy.operators import fsm, memory, sampling, speech
from colloquy.streaming.memory import score_one


def one(spark, *columns, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(*columns).first()


def test_text(spark):
    t = F.col("t")
    assert tuple(one(spark, *text.split_turn(t), t='A\nB\n"hi" tail')) == ("B", "hi")
    assert tuple(one(spark, *text.split_turn(t), t="no quotes")) == ("", "no quotes")
    assert tuple(one(spark, *text.split_turn_strict(t), t='A\nB\n"hi"')) == ("A\nB", "hi")
    assert tuple(one(spark, *text.split_turn_strict(t), t='"hi"')) == (None, None)
    assert sorted(one(spark, text.token_set(t), t="a Bb bb c_1")[0]) == ["bb", "c_1"]
    assert one(spark, text.balanced_quotes(t), t='a "b" "c')[0] is False
    assert one(spark, text.strip(t), t="　 a b \n")[0] == "a b"
    assert one(spark, text.sentences(t), t="One. Two! Three?")[0] == ["One.", "Two!", "Three?"]
    lexicon = {"angry": ["x"], "sad": ["s"], "happy": ["h"]}
    assert one(spark, text.keyword_class(t, lexicon, ("angry", "sad", "happy"), "neutral"), t="s h")[0] == "sad"
    assert one(spark, text.last_digits(t), t="G_100_v25.pth")[0] == "25" and one(spark, text.last_digits(t), t="x")[0] is None
    assert one(spark, text.intent(t), t="Will you?")[0] == "question" and one(spark, text.intent(t), t=" ")[0] == ""


def test_scores(spark):
    c = F.col("c")
    for n, want in ((19, 0.1), (20, 0.7), (39, 0.7), (40, 1.0), (140, 1.0), (141, 0.7), (200, 0.7), (201, 0.35), (240, 0.35), (241, 0.1)):
        assert one(spark, scores.length_reward(c), c="a " * n)[0] == pytest.approx(want)
    assert one(spark, scores.format_reward(c), c='Nar.\n"ok ok"')[0] == pytest.approx(1.0)
    assert one(spark, scores.format_reward(c), c='Nar.\n"ok ok" more')[0] == 0.0
    assert one(spark, scores.role_split_reward(c, ["Ann"]), c="Ann: hi\nUSER: x")[0] == 0.0
    assert score_one("fact", 1, 1, 1, 0, None, "v") == (1.0, pytest.approx(0.855))
    assert score_one("fact", 1, 1, 1, 9, "v", "v")[0] == 0.0 and score_one("x", 1, 1, 1, 0, "w", "v")[0] == 0.4


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    row = one(spark, vectors.slerp(a, b, 0.5), vectors.slerp(a, a, 0.5), vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), vectors.add_difference(a, b, a, 1.0), vectors.has_nan(F.array(F.lit(float("nan")))))
    assert row[0] == pytest.approx([2**-0.5] * 2) and row[1] == [1.0, 0.0] and row[2] == 0.0 and row[3] == [0.0, 1.0] and row[4] is True
    words = lambda s: F.split(F.lit(s), " ")
    row = one(spark, vectors.ngram_overlap(words("x y z"), words("x y z w"), 3), vectors.ngram_overlap(words("x y z w"), words("x y z"), 3), vectors.ngram_overlap(words("x y"), words("x y z"), 3))
    assert tuple(row) == (1.0, 0.5, 0.0)
    assert sum(x * x for x in one(spark, vectors.hashed_embedding(words("a b c a"), 16))[0]) == pytest.approx(1.0)


def test_similarity(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    long = lit("this is a long enough sentence", "well, this is a long enough sentence, really, you know it")
    row = one(spark, echo_ratio(*lit("hello there", "hello there")), echo_ratio(*lit("", "x")), is_echo(*long), is_echo(*lit("abc", "xyz")), is_echo(*lit(None, "x")))
    assert tuple(row) == (1.0, 0.0, True, False, False)


def test_echo_against_matching_every_pair(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    make = lambda: " ".join(rng.choices(["so", "it", "Goes", "“on”", "a", "and", "x?"], k=rng.randint(0, 9)))
    pairs = [(make(), make()) for _ in range(300)]
    pairs += [(t, t.replace("so", "to")) for t, _ in pairs[:60]]

    def measure(pair):
        x, y = (" ".join(t.replace("“", "").replace("”", "").split()).lower() for t in pair)
        u, v = ({w.strip("?") for w in t.split() if len(w.strip("?")) > 1} for t in (x, y))
        ratio = max(SequenceMatcher(None, x, y).ratio(), len(u & v) / len(u | v) if u and v else 0.0) if x and y else 0.0
        return ratio, bool(x and y) and (ratio >= 0.78 or len(x) >= 24 and (x in y or y in x))

    rows = spark.createDataFrame(pairs, "a string, b string").select(echo_ratio(F.col("a"), F.col("b")), is_echo(F.col("a"), F.col("b"))).collect()
    for row, pair in zip(rows, pairs, strict=True):
        ratio, echo = measure(pair)
        assert row[0] == pytest.approx(ratio) and row[1] == echo, pair


def test_redundant():
    assert redundant("Same words here!", "Same, words... here") and not redundant("short", "short")


def turns(spark, roles):
    names = {"s": "system", "u": "user", "a": "assistant"}
    return spark.createDataFrame([(1, i, names[r], f"{r}{i}") for i, r in enumerate(roles.split())], "conv_id long, turn long, role string, text string")


def test_conversations(spark):
    assert [r["turn"] for r in conv.collapse_runs(turns(spark, "a u u a a u")).orderBy("pos").collect()] == [2, 4]
    assert conv.collapse_runs(turns(spark, "a a")).count() == conv.collapse_runs(turns(spark, "u")).count() == 0
    assert sorted(r["turn"] for r in conv.prompt_samples(turns(spark, "s u a a u a")).collect()) == [2, 5]
    assert conv.until_last_user(turns(spark, "u a u a")).count() == 3
    assert one(spark, conv.label_mask(F.array(*map(F.lit, (5, 6, 7))), F.lit(2)))[0] == [-100, -100, 7]


def test_sampling(spark):
    assert [sampling.eval_size(*x) for x in ((10, 0.05), (1, 0.05), (100, 0.05), (10, 0))] == [1, 0, 5, 0]
    lengths = spark.createDataFrame([(n,) for n in (32, 33, 300, 301, 400, 401)], "n int").select(sampling.length_buckets(F.col("n"), (32, 300, 400))).collect()
    assert [r[0] for r in lengths] == [None, 0, 0, 1, 1, None]
    parts = sampling.split(spark.range(1000), "id", ratio=0.1, seed="1")
    assert parts.filter("part = 'eval'").count() == 100 and parts.count() == 1000


def test_fsm(spark):
    for value, expression, want in ((None, ">=0", False), (2, ">=2", True), (2, "<2", False), (2, "==2", True)):
        assert one(spark, fsm.condition(F.lit(value).cast("int"), expression))[0] is want
    with pytest.raises(ValueError, match="no such"):
        fsm.condition(F.lit(1), "~1")
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate((0, 2, 0, 0))], "session long, turn long, t int")
    rules = (fsm.Rule("a", "b", {"t": ">=2"}), fsm.Rule("b", "a", {"t": "==0"}))
    assert [r["state"] for r in fsm.replay(rows, rules, initial="a", signals=("t",)).orderBy("turn").collect()] == ["a", "b", "a", "a"]
    assert [r["state"] for r in fsm.replay(rows, rules, initial="a", signals=("t",), dwell=1).orderBy("turn").collect()] == ["a", "b", "b", "a"]


def test_speech(spark):
    assert one(spark, speech.with_blanks(F.array(F.lit(7), F.lit(8))))[0] == [0, 7, 0, 8, 0]
    assert one(spark, speech.blank_counts(F.array(F.lit(1), F.lit(2))))[0] == [3, 4]
    assert tuple(one(spark, *speech.clip(F.lit(100), F.lit(950), F.lit(1000)))) == (0, 1000)
    lines = speech.parse_transcript(spark.createDataFrame([("a|s|EN|t",), ("a|b",), (" ",)], "value string")).collect()
    assert [(r["utt"], r["error"]) for r in lines] == [("a", None), (None, "2 fields")]


def test_merge(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("y", 3), ("z", 4)], "k string, v int")
    got = lambda w: {r["k"]: r["v"] for r in memory.merge_dictionaries(a, b, key="k", value="v", incoming_wins=w).collect()}
    assert got(True) == {"x": 1, "y": 3, "z": 4} and got(False) == {"x": 1, "y": 2, "z": 4}
