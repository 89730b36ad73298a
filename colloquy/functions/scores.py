"""Scores of memory candidates and of completions, as Columns and as a registry by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import lines, rough_tokens, strip, words
from colloquy.functions.vectors import ngram_overlap

# Weights and thresholds that scores depend on.
IMPORTANCE = {"promise": 1.0, "boundary": 0.95, "fact": 0.85, "relationship": 0.80, "plan": 0.75, "preference": 0.65, "emotion": 0.55}
OTHER_IMPORTANCE = 0.5
PARTS = {"importance": 0.30, "confidence": 0.20, "impact": 0.20, "emotion": 0.15, "recurrence": 0.10, "novelty": 0.05}
PROMOTE_FROM = 0.65
NOVEL_NEW, NOVEL_SAME, NOVEL_CHANGED = 1.0, 0.0, 0.4
ROLE_MARKS = ("SYSTEM:", "USER:", "ASSISTANT:")
QUOTE_LINE = r'"[^"\n]{2,300}"'
OLD_WEIGHTS = {"format": 0.28, "role_split": 0.22, "grounded": 0.12, "consistency": 0.18, "reference": 0.12, "length": 0.08}
IMAGE_WEIGHTS = {"format": 0.35, "role_split": 0.25, "grounded": 0.20, "length": 0.20}
WEIGHTS = {"format": 0.34, "role_split": 0.26, "length": 0.26, "consistency": 0.14}


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def importance(kind: Column) -> Column:
    out = F.lit(OTHER_IMPORTANCE)
    for k, v in IMPORTANCE.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def recurrence(earlier: Column) -> Column:
    """From how many candidates of the key came before."""
    return F.least(F.lit(1.0), earlier / 3.0)


def candidate_score(**parts: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in PARTS.items():
        out = out + weight * parts[name]
    return clamp(out)


def _has_mark(c: Column) -> Column:
    up = F.upper(c)
    out = F.lit(False)
    for m in ROLE_MARKS:
        out = out | up.contains(m)
    return out


def _shape(c: Column) -> tuple[Column, Column, Column]:
    """(visible lines, whether a line after the first is one quoted span, whether there are just two lines with it)."""
    ls = lines(F.coalesce(c, F.lit("")))
    quote = F.exists(F.slice(ls, 2, 1_000_000), lambda x: x.rlike(f"^{QUOTE_LINE}\\z"))
    return ls, quote, quote & (F.size(ls) == 2)


def format_reward(c: Column) -> Column:
    """Narration 0.30, quoted line 0.40, nothing else 0.30, and 0.60 less for text behind the quote."""
    ls, quote, strict = _shape(c)
    first = F.get(ls, F.lit(0))
    up = F.upper(first)
    narration = F.coalesce((first != "") & ~first.startswith('"') & ~up.contains("USER:") & ~up.contains("ASSISTANT:"), F.lit(False))
    second = F.coalesce(F.get(ls, F.lit(1)), F.lit(""))
    at = F.regexp_instr(second, F.lit(QUOTE_LINE))
    tail = (at > 0) & (strip(F.substring(second, at + F.length(F.regexp_substr(second, F.lit(QUOTE_LINE))), F.length(second))) != "")
    score = 0.30 * narration.cast("double") + 0.40 * quote.cast("double") + 0.30 * (strict & ~_has_mark(c)).cast("double") - 0.60 * F.coalesce(tail, F.lit(False)).cast("double")
    return clamp(score)


def length_reward(c: Column) -> Column:
    n = rough_tokens(c)
    band = F.when(n.between(40, 140), 1.0).when(n.between(20, 200), 0.70).when(n.between(201, 240), 0.35).otherwise(0.10)
    return clamp(band - 0.40 * F.coalesce(_has_mark(c), F.lit(False)).cast("double"))


def role_split_reward(c: Column, names: Sequence[str] = (), verbs: Sequence[str] = ()) -> Column:
    """1 less 0.45 for each role mark, 0.55 for a name as speaker and 0.45 for a name that is said to speak."""
    up, penalty = F.upper(c), F.lit(0.0)
    for m in ROLE_MARKS:
        penalty = penalty + 0.45 * up.contains(m).cast("double")
    if names:
        any_name = "|".join(f"\\Q{n}\\E" for n in names)
        penalty = penalty + 0.55 * c.rlike(rf"(?:^|\n)\s*(?:{any_name})\s*[:：]").cast("double")
        if verbs:
            penalty = penalty + 0.45 * c.rlike(rf"(?:^|\n)\s*(?:{any_name}).{{0,16}}(?:{'|'.join(verbs)})").cast("double")
    return F.greatest(F.lit(0.0), 1.0 - F.coalesce(penalty, F.lit(0.0)))


def consistency_reward(c: Column, protagonist: Column, style: Column, formal_endings: Sequence[str]) -> Column:
    """0 for a malformed completion; 0.35 less without the name in the narration, 0.45 less for the wrong style."""
    ls, _, strict = _shape(c)
    quote = F.coalesce(F.get(ls, F.lit(1)), F.lit(""))
    chunks = F.transform(F.split(quote, r"[.!?…\n]+"), lambda x: F.regexp_replace(strip(x), r"""["'“”‘’,\s]+$""", ""))
    ends = lambda x: F.lit(False) if not formal_endings else x.rlike("(?:" + "|".join(f"\\Q{e}\\E" for e in formal_endings) + r")\z")
    formal = F.exists(chunks, ends)
    name_ok = F.coalesce(protagonist == "", F.lit(True)) | F.coalesce(F.get(ls, F.lit(0)).contains(protagonist), F.lit(False))
    style_ok = F.when(style == "formal", formal).when(style == "informal", ~formal).otherwise(True)
    return F.when(F.coalesce(strict, F.lit(False)), clamp(1.0 - 0.35 * (~name_ok).cast("double") - 0.45 * (~style_ok).cast("double"))).otherwise(0.0)


def banded(value: Column, bands: Sequence[tuple[float, float]], otherwise: float) -> Column:
    """The score of the first (from, score) that the value reaches; bands from high to low."""
    out = None
    for low, score in bands:
        out = F.when(value >= low, score) if out is None else out.when(value >= low, score)
    return out.otherwise(otherwise)


def grounded_reward(user: Column, completion: Column) -> Column:
    """By the share of the user's two-word runs in the completion; 0 for a malformed completion or without a user text."""
    ls, _, strict = _shape(completion)
    overlap = ngram_overlap(words(user), words(F.array_join(ls, " ")), 2)
    good = F.coalesce(strict & (strip(user) != ""), F.lit(False))
    return F.when(good, banded(overlap, ((0.25, 1.0), (0.12, 0.7), (0.05, 0.4)), 0.1)).otherwise(0.0)


def embedded_grounded_reward(similarity: Column, overlap: Column, is_question: Column) -> Column:
    """By cosine similarity of user and completion, less for copying; 0 for an unrelated answer to a question."""
    score = banded(similarity, ((0.50, 1.0), (0.35, 0.75), (0.20, 0.45), (0.10, 0.20)), 0.05)
    copied = F.when(overlap > 0.70, 0.10).when(overlap > 0.55, 0.05).otherwise(0.0)
    return F.when(is_question & (similarity < 0.10), 0.0).otherwise(F.greatest(F.lit(0.0), score - copied))


def reference_reward(similarity: Column, valid: Column, has_reference: Column) -> Column:
    """By cosine similarity to the reference; 0.5 without one, 0 for a malformed completion."""
    score = banded(similarity, ((0.55, 1.0), (0.40, 0.8), (0.25, 0.55), (0.12, 0.30)), 0.10)
    return F.when(~valid, 0.0).when(~has_reference, 0.5).otherwise(score)


def total(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum of the parts that have a weight."""
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + w * parts[k]
    return out


#: Scores of a completion alone, by name.
REWARDS: dict[str, Callable[[Column], Column]] = {"format": format_reward, "length": length_reward, "role_split": role_split_reward}
