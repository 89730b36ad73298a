"""Literal cases of row conversion and of the turn gate."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.functions import turns
from colloquy.operators import rows
from colloquy.operators.gate import turn_gate


def cells(spark, column, values, schema="t string"):
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(found, key=lambda r: r["i"])]


def test_messages(spark):
    a, b, c = F.lit("s"), F.col("t"), F.lit("a")
    assert [x and len(x) for x in cells(spark, rows.three_messages(a, b, c, strict=False), ["u", "", None])] == [3, None, None]
    with pytest.raises(PySparkException, match="missing"):
        cells(spark, rows.three_messages(a, b, c), [""])
    given = [[(" User ", " x "), ("tool", "y"), ("user", " "), (None, "z")], [("tool", "y")], None]
    found = cells(spark, rows.normal_messages(F.col("m"), a, F.lit(" u "), c), given, "m array<struct<role:string,content:string>>")
    assert [[tuple(m) for m in x] for x in found] == [[("user", "x")]] + [[("system", "s"), ("user", "u"), ("assistant", "a")]] * 2
    assert cells(spark, rows.instruction_prompt(F.lit(" do "), F.col("t")), ["x", None]) == ["### Instruction:\ndo\n\n### Input:\nx\n\n### Response:\n", "### Instruction:\ndo\n\n### Response:\n"]
    assert cells(spark, rows.translation_prompt(F.lit("do"), F.col("t")), [None]) == ["### Instruction:\ndo\n\n### Input:\n\n\n### Output:\n"]


def test_tables(spark):
    pairs = spark.createDataFrame([(("가", "あ"),), ((" ", "あ"),), ((None, "あ"),), (None,)], "d struct<ko:string,jp:string>").select(F.struct(F.col("d").alias("dialogue")).alias("scene"))
    assert [tuple(r) for r in rows.nested_pairs(pairs).collect()] == [("가", "あ")]
    said = spark.createDataFrame([(1, 0, "assistant", '"a" "b"'), (1, 1, "user", '"c"'), (2, 0, "assistant", None)], "conv_id int, turn int, role string, text string")
    assert sorted(tuple(r) for r in rows.quoted_span_rows(said).collect()) == [(1, 0, 0, "a"), (1, 0, 1, "b")]
    asked = spark.createDataFrame([("p", [("user", "x")]), ("p", None), (" ", None)], "prompt string, prompt_messages array<struct<role:string,content:string>>")
    assert sorted(r["prompt"] for r in rows.with_prompt(asked).collect()) == ["USER: x", "p"]
    with pytest.raises(ValueError):
        rows.with_prompt(spark.range(1))
    paths = spark.createDataFrame([("m/G_9.pth",), ("m/G_100.pth",), ("m/D_200.pth",), ("m/G_x.pth",)], "path string")
    assert [r[0] for r in rows.latest_by_digits(paths).collect()] == ["m/G_100.pth"]
    assert rows.latest_by_digits(paths.limit(0)).count() == 0
    assert tuple(rows.seconds_total(spark.createDataFrame([(1.5,), (None,)], "seconds double")).first()) == (1.5, 2)
    models = [spark.createDataFrame([("a", [1.0 + i])], "style string, vector array<double>") for i in range(2)]
    assert [tuple(r) for r in rows.looked_up(models[0], *models).collect()] == [("a", [1.0], [2.0])]
    with pytest.raises(PySparkException, match="model 0 has no b"):
        rows.looked_up(spark.createDataFrame([("b",)], "style string"), *models).collect()


def test_more_texts(spark):
    t = F.col("t")
    assert cells(spark, turns.told_as_dialogue(t, F.lit("소마")), ["뭐?", "소마, 온다", "간다. 해줘. 끝", "간다.", None]) == [True, True, True, False, False]
    assert cells(spark, turns.replace_word(t, F.lit("a.b"), F.lit("$1")), ["a.b xa.b a.b!", "axb"]) == ["$1 xa.b $1!", "axb"]
    assert cells(spark, turns.pronoun_for_protagonist(t, F.lit(True)), ["주인공은 주인공 주인공들"]) == ["그녀은 그녀 주인공들"]
    actions = F.array(F.lit("a"), F.lit("b"))
    assert cells(spark, rows.not_thrice(F.col("h"), actions), [["a", "b"], ["b", "a", "a"], [], ["a"] * 9], "h array<string>") == [["a", "b"], ["b"], ["a", "b"], ["b"]]


def test_gate(spark):
    told = [
        ("user", '주인공을 본다\n"오늘은 어디로 갈까?"', ""),
        ("assistant", '1. 사야가 고개를 든다\n"바다에 가 보고 싶어."', ""),
        ("user", '손을 든다\n"오늘은 어디로 갈까?!"', "user_repeat_turn"),
        ("user", '손을 든다\n"바다에 가 보고 싶어."', "user_echo_assistant"),
        ("user", "말이 없다", "user_requires_single_quote"),
        ("assistant", '소마는 고개를 든다\n"그래, 좋아."', "asst_role_conflict"),
        ("assistant", '사야가 고개를 든다\n"바다에 가 보고 싶어!"', "asst_repeat_turn"),
        ("assistant", '선택지 하나\n사야가 웃는다\n"그럼 내일 산에서 만나."', ""),
        ("assistant", '사야를 본다\n"바다에 가 보고 싶어."', "asst_echo_user"),
        ("assistant", None, "asst_empty"),
    ]
    turned = spark.createDataFrame([(1, i, r, x, "소마", "사야") for i, (r, x, _) in enumerate(told)], "conv_id int, turn int, role string, text string, player string, protagonist string")
    found = sorted(turn_gate(turned).collect(), key=lambda r: r["turn"])
    assert [r["code"] for r in found] == [c for _, _, c in told]
    assert found[0]["text"] == '사야을 본다\n"오늘은 어디로 갈까?"'
    assert turn_gate(turned.limit(0)).count() == 0
