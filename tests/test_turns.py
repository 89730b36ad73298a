"""Literal cases of turn forms, rule codes, JSON in texts and judges' labels."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import payloads, turns

T = N = P = None


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    global T, N, P
    T, N, P = F.col("t"), F.lit("카즈키"), F.lit("사야")


def every(spark, column, texts):
    """The column for each text, in order, in one job."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


USER = {
    None: "user_empty", " \n": "user_empty", '(가) "안녕"': "user_forbidden_chars", '가: "안녕"': "user_colon_char", '"안녕': "user_unbalanced_quotes",
    "말이 없다": "user_requires_single_quote", '"가" "나"': "user_requires_single_quote", '"…"': "user_quote_silent", '사야는 웃었다\n"안녕"': "user_role_conflict",
    '판정 기준\n"안녕"': "user_policy_leak", '하나\n둘\n"안녕"': "user_too_many_lines", '"안녕"\n고개를 들었다': "user_last_line_must_be_quote",
    '손을 든다\n"나는 오늘 학교에서 너를"': "user_dialogue_truncated", '손을 들었습니다.\n"안녕"': "user_action_formal", '손을 든다\n"안녕, 잘 지냈어?"': "", '"너를"': "",
}
ASSISTANT = {
    None: "asst_empty", "*웃음*": "asst_forbidden_chars", "사야: 안녕": "asst_colon_char", '프롬프트를 보았다\n"안녕"': "asst_meta", '다음 행동\n"안녕"': "asst_meta",
    '고개를 들었다\n"안녕': "asst_unbalanced_quotes", '"안녕"': "asst_requires_two_lines", '말투 규칙을 보았다\n"안녕"': "asst_policy_leak",
    '고개를 들었습니다.\n"안녕"': "asst_narr_formal", '그는 "아" 했다\n"안녕"': "asst_narr_has_quote", "고개를 들었다\n안녕": "asst_dia_requires_single_quote",
    '고개를 들었다\n"..."': "asst_dia_silent", '고개를 들었다\n" 12. "': "asst_dialogue_numeric", '고개를 들었다\n"나는 오늘 학교에서 너를"': "asst_dialogue_truncated",
    '고개를 들었다\n"카즈키가 왔어."': "asst_player_third_person", '고개를 들었다\n"사야는 웃었다 했다."': "asst_dialogue_narration", '웃었다\n"안녕"': "asst_narr_too_short",
    '1. 고개를 들었다\n"안녕"': "", '[서술]\n고개를 들었다\n"안녕"': "", '고개를 들었다\n"카즈키, 안녕"': "",
}
CRISIS = {
    "": "crisis_empty", "(가)": "crisis_forbidden_chars", "가: 나": "crisis_colon_char", '"가': "crisis_unbalanced_quotes", '"가"': "crisis_requires_two_lines",
    '"가"\n"나"': "crisis_no_narr_line", "가\n나": "crisis_requires_single_quote", '가\n"카즈키를 봐"': "crisis_player_third_person", '가\n"카즈키!"': "",
}


def test_codes(spark):
    assert every(spark, turns.user_code(T, N, P), USER) == list(USER.values())
    assert every(spark, turns.assistant_code(T, N, P), ASSISTANT) == list(ASSISTANT.values())
    assert every(spark, turns.crisis_code(T, N), CRISIS) == list(CRISIS.values())


def test_labels_and_names(spark):
    assert every(spark, turns.speaker_label(T, F.lit("a.b"), F.lit("")), ["a.b : hi", "axb: hi", " a.b：", ": x"]) == [True, False, True, False]
    assert every(spark, turns.speaker_label(T, F.lit(r"a\Eb$")), [r"a\Eb$: hi", "ab: hi"]) == [True, False]
    assert every(spark, turns.strip_label(T), ["ACT 2: go", "3) go", "사야의 대사: go", "사야의 행동", "[첫 번째 줄]", "- Speech: go", None]) == ["go", "go", "go", "", "", "go", ""]
    assert every(spark, turns.protagonist_named(T, F.lit("사야")), ["주인공이 사 야를", None]) == ["사야이 사야를", ""]
    assert every(spark, turns.player_named(T, F.lit("소마")), ["{{user}} {USER} user users 유저 카즈키 소 마"]) == ["소마 소마 소마 users 소마 소마 소마"]
    assert every(spark, turns.player_named(T, F.lit("a$1")), ["user and a $ 1"]) == ["a$1 and a$1"]
    assert every(spark, turns.player_named(T, F.lit("")), ["{{user}} 카즈키"]) == ["플레이어 카즈키"]
    assert every(spark, turns.truncated(T), ["나는 너를", "나는 오늘 너를", "그냥 가자 그리고", "그래서"]) == [False, True, True, False]


def test_forms(spark):
    said = ["", '"가"', "가", '"..."', '웃음\n말 "나" 끝\n"다"', '웃음\n"..."\n"다"', "웃음\n말", '"가" "나"']
    breath = turns.BREATH
    assert every(spark, turns.two_lines(T), said) == [f'{breath}\n"..."', f'{breath}\n"가"', f'{breath}\n"가"', f'{breath}\n"..."', '웃음\n"나"', '웃음\n"다"', '웃음\n"말"', f'{breath}\n"가 나"']
    assert every(spark, turns.two_sentences(T), ["", "가. 나.", '웃음. 둘.\n"다! 라."']) == ['잠시 숨을 고른다.\n"..."', '잠시 숨을 고른다.\n"가."', '웃음.\n"다!"']
    assert every(spark, turns.quoted_turn(T), [None, "사야: 안녕", '*웃음*\n\n"사야: 안녕"', 'a\nb\n"c"', "***"]) == ["", '"안녕"', '웃음\n"안녕""', 'a\n"c"', ""]
    assert every(spark, turns.quoted_line(T), ['a "b" c "d" e', '"', '""']) == ['"b" c "d"', '"""', '"..."']
    assert every(spark, turns.no_space_before_break(T), ["a \t\nb "]) == ["a\nb "]
    assert every(spark, turns.without_meta(T), ["[[가]]\n\n선택지 하나\n장르: x\n나  다 ACT 3", "json", None]) == ["가\n나 다", "", ""]
    assert every(spark, turns.without_square_brackets(T), ["[가] [] [[나]]"]) == ["가 [] [나]"]
    assert every(spark, turns.fill_placeholder(T, turns.chosen_name(F.lit(1))), ["{{user}}"])[0] in turns.PLAYER_NAMES


def test_json(spark):
    full = {"type": " fact ", "subject": "s" * 30, "key": "k", "value": 3, "confidence": "0.5", "future_impact": 7, "emotion_intensity": "x"}
    found = every(spark, payloads.candidates(T), ["so: " + json.dumps({"candidates": [full, {"type": "a"}, 5, None]}) + " end", "none", "{bad", '{"candidates": 3}', '{"a": 1} {"b": 2}', None])
    assert [tuple(r) for r in found[0]] == [("fact", "s" * 24, "k", "3", 0.5, 1.0, 0.0)]
    assert found[1:] == [[], [], [], [], []]
    texts = ['x {"a": {"b": 1}} {"c": 2, }', '{"a": [1,2,],}', "{x} {}", "none", None]
    assert every(spark, F.to_json(payloads.first_object(T)), texts) == ['{"c":2}', '{"a":[1,2]}', "{}", None, None]
    assert every(spark, payloads.fenced_json(T), ["```json\n {x} \n```", 'a {"b": 1} c', "{x}", "", '{"a":1} {"b":2}']) == ["{x}", '{"b": 1}', None, None, None]


def test_payload(spark):
    both = {"ko": "가", "jp": "あ"}
    good = {"user": '손을 든다\n"안녕"', "assistant_raw": '사야가 웃는다\n"응"', "scene": {"speaker": "사야", "narration": both, "dialogue": both}}
    texts = [good, good | {"more": 1}, good | {"user": "카즈키, 안녕"}, good | {"user": "가: 나"}, good | {"assistant_raw": "사야\n응"}, good | {"user": 5}, good | {"scene": good["scene"] | {"dialogue": {"ko": " ", "jp": "x"}}}, good | {"scene": []}]
    asked = payloads.valid_payload(T, N, P, F.lit(False))
    assert every(spark, asked, [json.dumps(x, ensure_ascii=False) for x in texts] + ["{", None]) == [True] + [False] * 9
    led = payloads.valid_payload(T, N, P, F.lit(True))
    assert every(spark, led, [json.dumps(good | {"user": u}, ensure_ascii=False) for u in ('카즈키, 든다\n"안녕"', '든다\n"카즈키"')]) == [True, False]


def test_judges(spark):
    raw = ["it is Informal", "formal", "존댓말", "반말", "?", None]
    assert every(spark, payloads.style_label(T), raw) == ["informal", "formal", "formal", "informal", "unknown", "unknown"]
    assert every(spark, payloads.style_mismatch(T, F.lit(True)), raw) == [True, False, False, True, True, True]
    assert every(spark, payloads.style_mismatch(T, F.lit(None).cast("boolean")), raw) == [False] * 6
    said = ["pass", "FAIL", "pass or fail", "stall", "advance, stall", "", None]
    assert every(spark, payloads.quality_failed(T), said) == [False, True, False, True, True, True, True]
    assert every(spark, payloads.user_role_failed(T), said) == [False, True, True, False, False, False, False]
    assert every(spark, payloads.stalled(T), said) == [False, False, False, True, False, False, False]
    assert every(spark, payloads.to_float(T), ["1e2", "x", None]) == [100.0, 0.0, 0.0]
    assert every(spark, payloads.to_int(T, 0, 5, 3), ["9", "x", "-2", None]) == [5, 3, 0, 3]
    assert every(spark, payloads.to_flag(T), [" YES ", "1", "no", "x", None]) == [True, True, False, False, False]
