"""Text normalisers for reading aloud, by language. They need Unicode composition and number words, which no built-in
expression has, so they run in Arrow batches; each is also a plain function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What punctuation becomes.
TO_COMMA = "：；，·・、"
TO_DOT = "。\n．$"
TO_QUOTE = "“”\"‘’（）()《》【】[]「」"
TO_HYPHEN = "˗‐‒–—―⁃−⎯⏤─━⸺⸻"
DOTS = ("…", "···", "・・・")
MARKS = "!?.,'-…"
CURRENCY_JA = {"$": "ドル", "¥": "円", "£": "ポンド", "€": "ユーロ"}


def _punctuation(hyphens: str) -> Callable[[str], str]:
    table = {c: "," for c in TO_COMMA} | {c: "." for c in TO_DOT} | {c: "'" for c in TO_QUOTE} | {c: "-" for c in hyphens} | {"！": "!", "？": "?"}
    pattern = re.compile("|".join([*map(re.escape, DOTS), "[" + re.escape("".join(table)) + "]"]))
    return lambda text: pattern.sub(lambda m: "..." if m[0] in DOTS else table[m[0]], text)


_all_marks = _punctuation(TO_HYPHEN)
_english_marks = _punctuation("—−～~")

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion"]
_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def _under_thousand(n: int) -> str:
    if n >= 100:
        return f"{_ONES[n // 100]} hundred" + (f" {_under_thousand(n % 100)}" if n % 100 else "")
    if n < 20:
        return _ONES[n]
    return _TENS[n // 10 - 2] + (f"-{_ONES[n % 10]}" if n % 10 else "")


def english_number(n: int) -> str:
    if n < 0:
        return "minus " + english_number(-n)
    if n >= 1000 ** len(_SCALES):
        return " ".join(_ONES[int(d)] for d in str(n))
    groups, at = [], 0
    while n or not at:
        if n % 1000 or not (n or groups):
            groups.append((_under_thousand(n % 1000) + " " + _SCALES[at]).strip())
        n, at = n // 1000, at + 1
    return ", ".join(reversed(groups))


def english_year(n: int) -> str:
    """Numbers between 1000 and 3000 are read as years, in two halves; others as numbers."""
    if not 1000 < n < 3000:
        return english_number(n)
    century, rest = divmod(n, 100)
    if century == 20 and rest < 10:
        halves = ["two thousand", _ONES[rest] if rest else ""]
    else:
        halves = [english_number(century), english_number(rest) if rest >= 10 else f"oh {_ONES[rest]}" if rest else "hundred"]
    return " ".join(filter(None, halves))


def english_ordinal(n: int) -> str:
    head, sep, last = re.fullmatch(r"(.*?)([ -]?)([a-z]+)", english_number(n)).groups()
    last = _ORDINALS.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return head + sep + last


#: A number as it is written: dollars, pounds, or a plain one with a fraction or the ending of an ordinal.
_WRITTEN = re.compile(r"\$(?P<dollars>[0-9.,]*[0-9])|£(?P<pounds>[0-9,]*[0-9])|(?P<number>[0-9](?:[0-9,]*[0-9])?)(?:\.(?P<fraction>[0-9]+))?(?:(?P<nth>st|nd|rd|th))?")


def _money(amount: str) -> str:
    """Dollars, and behind one point cents."""
    units = amount.split(".")
    if len(units) > 2:
        return ". ".join(english_year(int(u)) for u in units if u) + " dollars"
    counted = [(int(u or 0), name) for u, name in zip(units, ("dollar", "cent"), strict=False)]
    return ", ".join(f"{english_year(n)} {name}" + "s" * (n != 1) for n, name in counted if n) or "zero dollars"


def _read_out(m: re.Match) -> str:
    found = {k: v.replace(",", "") for k, v in m.groupdict().items() if v is not None}
    if "dollars" in found:
        return _money(found["dollars"])
    if "pounds" in found:
        return english_year(int(found["pounds"])) + " pounds"
    *before, last = (int(found[k]) for k in ("number", "fraction") if k in found)
    return " point ".join([*map(english_year, before), (english_ordinal if "nth" in found else english_year)(last)])


def english(text: str | None) -> str:
    """Numbers in words - with separators, pounds, dollars, decimals, ordinals and years - and plain punctuation, with a
    space behind it."""
    return re.sub(r"([,;.?!])(\w)", r"\1 \2", _english_marks(_WRITTEN.sub(_read_out, text or "")))


_HAN = "零一二三四五六七八九"
_MYRIADS = ["", "万", "億", "兆", "京"]


def han_number(digits: str, *, point: str = "点", ones: bool = False, units: tuple[str, str, str] = ("十", "百", "千"), myriads: list[str] | None = None, zeros: bool = False) -> str:
    """A decimal number in Han numerals: ``ones`` writes 一 before ten, hundred and thousand, ``zeros`` a 零 for skipped
    places. Numbers beyond the names are read digit by digit."""
    myriads = _MYRIADS if myriads is None else myriads
    whole, _, fraction = digits.partition(".")
    tail = point + "".join(_HAN[int(d)] for d in fraction) if fraction else ""
    whole = whole.lstrip("0") or "0"
    if len(whole) > 4 * len(myriads):
        return "".join(_HAN[int(d)] for d in whole) + tail
    if whole == "0":
        return _HAN[0] + tail
    out, groups = "", [whole[max(0, i - 4) : i] for i in range(len(whole), 0, -4)]
    for at in range(len(groups) - 1, -1, -1):
        said, skipped = "", False
        group = groups[at].zfill(4) if at < len(groups) - 1 else groups[at]
        for place, d in zip(range(len(group) - 1, -1, -1), group, strict=True):
            if d == "0":
                skipped = skipped or bool(out or said)
                continue
            if skipped and zeros:
                said += _HAN[0]
            skipped = False
            said += ("" if d == "1" and place and not ones else _HAN[int(d)]) + ("" if not place else units[place - 1])
        if said:
            out += said + myriads[at]
    return out + tail


_KEEP_JA = re.compile(r"[^぀-ゟ゠-ヿ一-鿿㐀-䶿々０-９A-Za-zＡ-Ｚａ-ｚͰ-Ͽἀ-῿" + re.escape("!?.,'-") + r"]+")


#: Currency sign, digits with separators before groups of three, fraction.
_AMOUNT_JA = re.compile(r"([$¥£€])?([0-9]+(?:,[0-9]{3}[0-9]*)*(?:\.[0-9]+)?)")


def _amount_ja(m: re.Match) -> str:
    return han_number(m[2].replace(",", "")) + (CURRENCY_JA[m[1]] if m[1] else "")


def japanese(text: str | None) -> str:
    """Composed forms, numbers in numerals, wave dashes as long vowels, plain punctuation; only letters that can be
    read stay, without combining voice marks."""
    t = _AMOUNT_JA.sub(_amount_ja, unicodedata.normalize("NFKC", text or ""))
    t = re.sub("[~～〜]", "ー", t)
    return re.sub("[゙゚]", "", _KEEP_JA.sub("", _all_marks(t)))


def chinese(text: str | None) -> str:
    """Numbers in numerals and plain punctuation; only Han letters and marks stay."""
    t = re.sub(r"\d+(?:\.\d+)?", lambda m: re.sub("^一十", "十", han_number(m[0], ones=True, zeros=True, myriads=["", "万", "亿", "兆"])), text or "")
    t = _all_marks(t.replace("嗯", "恩").replace("呣", "母"))
    return re.sub(r"[^一-龥" + re.escape("!?.,'-") + r"]+", "", t)


def _batched(f: Callable[[str | None], str]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(f, na_action=None)

    return run


NORMALISERS: dict[str, Callable[[str | None], str]] = {"en": english, "ja": japanese, "zh": chinese}


def normalised(text: Column, language: str) -> Column:
    """The text as it is read aloud; null is empty."""
    return _batched(NORMALISERS[language])(text)
