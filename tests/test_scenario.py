"""Literal cases of scenario texts: cleaning, fields, told attributes and rule codes."""

from pyspark.sql import functions as F

from colloquy.functions import scenario

FILL = "가나다라마바사아자차" * 12


def book(**changes):
    parts = {
        "s0": f"0. 역할 선언\n당신은 이제 「유리」가 됩니다. {FILL}", "s1": "1. 장르: 연애물   비극", "s2": "2. 상황", "s3": "3. 주인공 정의\n- 이름: 사야 (검사)\n- 성별: 여성",
        "s4": "4. 플레이어 정의\n- 이름: 소마", "s5": "5. 관계 및 변화 규칙\n관계 상태: 거리감", "s6": "6. 발화와 분위기 규칙\n기본 말투: 반말",
        "s7": '7. 가장 최근 상호작용\n플레이어의 최근 턴: "가자"\n주인공의 최근 턴: "나도 갈게. 할게"\n관계 상태: 사랑과 친밀',
    } | changes
    return "\n".join(x for x in parts.values() if x)


def every(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_codes(spark):
    cases = {
        None: "too_short", "  ": "too_short", book(): "unknown", book(s5="5 관계"): "section_missing_5", book(s0=FILL): "section_missing_0",
        book(s7="7. 가장 최근 상호작용\n주인공의 최근 턴: 그래"): "missing_recent_user", book(s7="7. 가장 최근 상호작용\n플레이어의 최근 턴: 그래"): "missing_recent_protagonist",
        book(s3="3. 주인공 정의"): "protagonist_count=0", book(s2="2. 마이"): "protagonist_count=2", book(s2="2. 마이와 코하루"): "protagonist_count=3",
        book(s4="4. 플레이어 정의"): "player_count=0", book(s2="2. 카즈키"): "player_count=2", book(s6="6. 발화와 분위기 규칙\n기본 말투 범주: 존댓말"): "speech_style_mismatch_sec6_sec7",
        book(s6="6. 발화와 분위기 규칙\n기본 말투: 반말 또는 존댓말"): "unknown", book(s1="1.장르"): "section_missing_1",
    }
    assert every(spark, scenario.scenario_code(F.col("t")), cases) == list(cases.values())
    assert every(spark, scenario.valid_scenario(F.col("t")), [None, book(), book(s5="")]) == [False, True, False]


def test_fields(spark):
    assert every(spark, scenario.genre(F.col("t")), [book(), "없다", None]) == ["연애물 비극", "", ""]
    names = [book(), book(s0="0. 당신은 이제 유리 입니다"), book(s0="0. 역할"), "- 이름: 『하나』", "이름: (없음)", None, book(s0="0.", s3="3. 주인공 정의")]
    assert every(spark, scenario.protagonist_name(F.col("t")), names) == ["유리", "유리", "사야", "하나", "주인공", "주인공", "소마"]
    players = [book(), "플레이어의 이름은 '보리', 끝", "플레이어는 「보리」 라고", "플레이어 (보리)", "플레이어", None]
    assert every(spark, scenario.player_name(F.col("t")), players) == ["소마", "보리", "보리", "보리", "플레이어", "플레이어"]
    assert every(spark, scenario.relation_status(F.col("t")), [book(), book(s7="7. 가장 최근 상호작용"), "관계 상태: 모름", None]) == ["친밀", "거리감", "", ""]
    speech = [book(), "말투 존댓말, 말투 반말", "반말로", "존댓말과 반말", "6. 발화와 분위기 규칙\n7. 반말", None]
    assert every(spark, scenario.formal_speech(F.col("t")), speech) == [False, True, False, True, None, None]


def test_styles(spark):
    lines = ["갑니다. 좋습니다", "나도 할게!", "했어. 고마워요", "가자. 이게 뭐야", "제가 하죠", "저기요", "갈까?", "갈까", "가자", "", None]
    assert every(spark, scenario.line_style(F.col("t")), lines) == ["존댓말", "반말", None, "반말", "존댓말", "존댓말", "반말", "반말", None, None, None]
    turns = [book(), "7. 가장 최근 상호작용\n사야의 턴: “그래”", "3. 주인공 정의\n이름: 유리(검사)\n7. 가장 최근 상호작용\n사야 최근 턴: 가\n유리의 가장 최근 턴: 나", "7. 가장 최근 상호작용", None]
    assert every(spark, scenario.recent_line(F.col("t")), turns) == ["나도 갈게. 할게", "그래", "나", None, None]
    no_style = book(s7="7. 가장 최근 상호작용\n플레이어의 최근 턴: 가\n주인공의 최근 턴: 가자")
    assert every(spark, scenario.style_conflict(F.col("t")), [book(), no_style, "", None]) == [False, True, False, False]


def test_told_attributes(spark):
    texts = ["주인공은 소녀이다", "주인공은 왕자이다", "주인공. 그녀 는", "주인공. 그 는", "소녀", "가" * 250 + "주인공", "소녀" + "가" * 250 + "주인공", None]
    assert every(spark, scenario.protagonist_gender(F.col("t")), texts) == ["female", "male", "female", "male", None, None, None, None]
    texts = [book(), "주인공의 이름: 하나\n플레이어의 이름: 둘이\n당신의 이름: 셋이", "플레이어 주인공 이름: 하나 이름: 둘이", "주인공" + "x" * 130 + "이름: 하나", None]
    found = [(x["protagonist"], x["player"]) for x in every(spark, scenario.told_names(F.col("t")), texts)]
    assert found == [("사야", "소마"), ("하나", "둘이"), ("하나", "둘이"), (None, None), (None, None)]


def test_cleaning(spark):
    texts = ["**《가》** 『나』\t <다>\n\n\n\n라 ", None, "x" * 300_000]
    assert every(spark, scenario.cleaned(F.col("t")), texts) == ["가 나 다\n\n라", "", "x" * 300_000]
    rows = [f"줄 {i}" for i in range(30)]
    texts = ["7. 끝\n\n" + "\n \n".join(rows), "앞\n7. 끝\n" + "\n".join(rows), "앞\n7.끝", " 앞 ", None, "😀\n7. 끝\n가"]
    want = ["\n".join(["7. 끝", *rows[:20]]), "\n".join(["앞", "7. 끝", *rows[:19]]), "앞\n7.끝", "앞", "", "😀\n7. 끝\n가"]
    assert every(spark, scenario.until_section_7(F.col("t")), texts) == want
    dropped = ["/meta/ x", "**라벨**", "Scene Direction: x", "fsm 상태", "상태= 3", "A) 간다", "1. 간다", "②. x", "이제 이야기를 시작", "본 출력은 x", " "]
    kept = ["  그냥 줄", "a / b", "**가** 나", "1.간다", "1.", "이제 간다", "② . x", "(B 간다", "끝", "상태", "x FSM"]
    lines = [x for pair in zip(dropped, kept, strict=True) for x in pair]
    assert every(spark, scenario.without_leftovers(F.col("t")), ["\n".join(lines), None]) == ["\n".join(kept), ""]
