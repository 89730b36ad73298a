"""Similarity of texts by characters, where no built-in expression exists: Arrow batches of the standard library's
sequence matcher."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTES = re.compile("[\"“”]")
_WORDS = "[가-힣A-Za-z0-9]+"
_LOOSE = re.compile(r"[\s.,!?~\"'`…]+")


def redundant(current: str | None, previous: str | None, least: int = 8, threshold: float = 0.86) -> bool:
    """Whether a turn repeats another but for punctuation and white space."""
    x, y = (_LOOSE.sub("", " ".join(_QUOTES.sub("", t or "").split())) for t in (current, previous))
    if len(x) < least or len(y) < least:
        return False
    return x in y or y in x or SequenceMatcher(None, x, y).ratio() >= threshold


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters' share of both texts; pairs with a null are not looked at."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def _redundant(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([redundant(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


def _loosened(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\"“”]", ""), r"(?U)\s+", " ")))


def _shared_words(x: Column, y: Column) -> Column:
    """Jaccard index of the words of two characters or more; 0 where a text has none."""
    u, v = (F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(f"({_WORDS})"), F.lit(1)), lambda w: F.length(w) >= 2)) for t in (x, y))
    return F.when((F.size(u) > 0) & (F.size(v) > 0), F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v))).otherwise(F.lit(0.0))


def _characters(x: Column, y: Column, least: Column) -> Column:
    """The character ratio where it could exceed ``least``, else 0: it is twice the shorter length over both at most, and
    only pairs that this leaves open go to Python."""
    open_still = (x != "") & (y != "") & (F.least(F.length(x), F.length(y)) * 2.0 > least * (F.length(x) + F.length(y)))
    return F.coalesce(_ratio(F.when(open_still, x), F.when(open_still, y)), F.lit(0.0))


def echo_ratio(a: Column, b: Column) -> Column:
    """The higher of the character ratio and the word sets' Jaccard; 0 if either is blank."""
    x, y = _loosened(a), _loosened(b)
    words = _shared_words(x, y)
    return F.greatest(words, _characters(x, y, words))


def is_echo(a: Column, b: Column, threshold: float = 0.78) -> Column:
    """Alike enough by words or characters, or, from 24 characters on, one within the other; false if either is blank."""
    x, y = _loosened(a), _loosened(b)
    told = ((F.length(x) >= 24) & (x.contains(y) | y.contains(x))) | (_shared_words(x, y) >= threshold)
    least = F.when(told, F.lit(1.0)).otherwise(F.lit(threshold - 1e-9))
    return (x != "") & (y != "") & (told | (_characters(x, y, least) >= threshold))


def is_redundant(current: Column, previous: Column) -> Column:
    return _redundant(current, previous)
