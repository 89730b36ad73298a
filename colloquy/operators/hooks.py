"""Models that stay outside, as functions that a caller gives: each works on a list of texts at a time, in Arrow batches.

A function must be such that executors can unpickle it, and give one value for each text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import strip


def _checked(found: Sequence, n: int) -> Sequence:
    if len(found) != n:
        raise ValueError(f"{len(found)} values for {n} texts")
    return found


def generated(prompt: Column, generate: Callable[[list[str]], Sequence[str | None]]) -> Column:
    """What ``generate`` makes of each prompt; null for null prompts, which it does not see."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        asked = texts[texts.notna()]
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if len(asked):
            out[asked.index] = pd.Series(list(_checked(generate(asked.tolist()), len(asked))), index=asked.index, dtype=object)
        return out

    return run(prompt)


def translated(line: Column, translate: Callable[[list[str]], Sequence[str | None]]) -> Column:
    """A translation of each line; blank lines become empty. A text or an answer of several lines is an error."""
    def single(c: Column, what: str) -> Column:
        return F.when(c.rlike(r"[\n\r]"), F.raise_error(F.lit(f"{what} of more than one line"))).otherwise(c)

    given = single(strip(line), "a text")
    return F.when(given == "", "").otherwise(single(strip(generated(F.nullif(given, F.lit("")), translate)), "a translation"))


def encoded(c: Column, encode: Callable[[list[str]], np.ndarray], dim: int = 768) -> Column:
    """A vector of length 1 for each text; zeros for null and blank texts, which ``encode`` does not see."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        plain = [(x or "").strip() for x in texts]
        at = [i for i, x in enumerate(plain) if x]
        out = np.zeros((len(plain), dim))
        if at:
            found = np.asarray(_checked(encode([plain[i] for i in at]), len(at)), dtype=float)
            size = np.linalg.norm(found, axis=1, keepdims=True)
            out[at] = np.divide(found, size, out=np.zeros_like(found), where=size > 0)
        return pd.Series(list(out))

    return run(F.coalesce(c, F.lit("")))


def staged(rows: DataFrame, *stages: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The rows through the stages that are given, in order; a stage that is None is left out."""
    return reduce(lambda df, stage: df.transform(stage), [s for s in stages if s is not None], rows)
