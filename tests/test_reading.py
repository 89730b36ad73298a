import pytest
from hypothesis import given
from hypothesis import strategies as st

from colloquy.functions import normalise, phonemes


@pytest.mark.parametrize(("given", "wanted"), [
    ("2,450円", "二千四百五十円"), ("78.06", "七十八点零六"), ("!?い。。？", "!?い..?"), ("そうか、ね…！", "そうか,ね...!"), ("＄１０", "十ドル"), ("ラ〜メン~", "ラーメンー"), ("10000 20030", "一万二万三十"), (None, ""), ("あ゛い", "あい"), ("Ａｂ（c）", "Ab'c'"),
])
def test_japanese(given, wanted):
    assert normalise.japanese(given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    ("It cost $1.50 in 1987.", "It cost one dollar, fifty cents in nineteen eighty-seven."), ("1,234 and 21st", "twelve thirty-four and twenty-first"), ("£5 or 3.14", "five pounds or three point fourteen"), ("2000 2005 1900 1905", "two thousand two thousand five nineteen hundred nineteen oh five"),
    ("a,b；c", "a, b, c"), ("$0", "zero dollars"), ("3000 0 112th", "three thousand zero one hundred twelfth"), (None, ""),
])
def test_english(given, wanted):
    assert normalise.english(given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("我有12个，嗯！", "我有十二个,恩!"), ("105.2%abc", "一百零五点二"), ("10010", "一万零一十")])
def test_chinese(given, wanted):
    assert normalise.chinese(given) == wanted


def test_kana():
    assert phonemes.phonemes_of("ーサーミー") == [phonemes.LONG, "s", "a", "a", "m", "i", "i"]
    assert phonemes.phonemes_of("!?!") == ["!", "?", "!"] and phonemes.phonemes_of("キャット") == ["ky", "a", "q", "t", "o"]
    with pytest.raises(ValueError, match="no mora"):
        phonemes.phonemes_of("漢")
    assert phonemes.resolve_long([["ー", "a"], ["ー", "ー"], [], ["."], ["ー"]]) == [["-", "a"], ["a", "a"], [], ["."], ["-"]]


def test_tones():
    assert phonemes.align_tones([".", "w", "a", ",", "o", "."], [("w", 0), ("a", 1), ("o", 0)]) == [(".", 0), ("w", 0), ("a", 1), (",", 0), ("o", 0), (".", 0)]
    with pytest.raises(ValueError, match="unexpected"):
        phonemes.align_tones(["k"], [("w", 0)])


@given(st.lists(st.tuples(st.sampled_from([*phonemes.KANA.values(), ",", "!"]), st.integers(0, 1)), max_size=20))
def test_kana_round_trip(pairs):
    assert phonemes.to_kana(phonemes.from_kana(pairs)) == pairs


@given(st.integers(0, 200), st.integers(1, 40))
def test_distribution(total, parts):
    got = phonemes.distribute(total, parts)
    assert sum(got) == total and max(got) - min(got) <= 1 and got == sorted(got, reverse=True)


def test_realignment():
    assert phonemes.distribute(5, 3) == [2, 2, 1]
    assert phonemes.realign([2, 2], list("abcd"), list("abxcd")) == [2, 3]
    assert phonemes.realign([2, 2], list("abcd"), list("abcd")) == [2, 2]
    assert phonemes.realign([1, 3], list("abcd"), list("bcd")) == [1, 2]


@given(st.lists(st.integers(1, 3), min_size=1, max_size=6), st.data())
def test_realignment_adds_up(counts, data):
    generated = data.draw(st.lists(st.sampled_from("abc"), min_size=sum(counts), max_size=sum(counts)))
    given_ = data.draw(st.lists(st.sampled_from("abc"), min_size=len(counts), max_size=20))
    got = phonemes.realign(counts, generated, given_)
    assert sum(got) == len(given_) and min(got) >= 1


def test_english_phones():
    table = {"HELLO": ("HH", "AH0", "L", "OW1")}
    assert phonemes.english_phones(["hello", ",", "zzz"], table) == (["hh", "ah", "l", "ow", ",", "UNK"], [3, 1, 3, 2, 0, 0])
