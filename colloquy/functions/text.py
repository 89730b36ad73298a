"""String functions as Columns, with the semantics of Unicode-aware trimming and code-point lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on.
TOKEN_SET = "[가-힣A-Za-z0-9_]{2,}"
ROUGH_TOKEN = r"[가-힣A-Za-z0-9]+|[^\s]"
WORD = "[가-힣A-Za-z0-9]+"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def one_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """Lines at \\n, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")


def one_line(c: Column) -> Column:
    return F.array_join(lines(c), " ")


def token_set(c: Column) -> Column:
    """Distinct lower-case words of two letters or more; a null text has none."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN_SET), 0)), F.array().cast("array<string>"))


def words(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), 0), F.array().cast("array<string>"))


def rough_tokens(c: Column) -> Column:
    """Runs of letters and digits, and every other visible character."""
    return F.coalesce(F.regexp_count(c, F.lit(ROUGH_TOKEN)), F.lit(0))


def normal_key(c: Column) -> Column:
    """MD5 of the text with white space made single spaces."""
    return F.md5(one_space(c))


def sentences(c: Column) -> Column:
    """Split behind . ! or ? and white space; blank parts go."""
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def quoted_spans(c: Column, most: int = 600) -> Column:
    return F.regexp_extract_all(c, F.lit(f'"([^"\\n]{{1,{most}}})"'), 1)


def split_turn(c: Column, most: int = 600) -> tuple[Column, Column]:
    """(narration, dialogue): the first quoted span is the dialogue and the last visible line before it the narration;
    without a span everything is dialogue. Blank and null texts give two empty strings."""
    text = strip(F.coalesce(c, F.lit("")))
    pattern = f'"[^"\\n]{{1,{most}}}"'
    at = F.regexp_instr(text, F.lit(pattern))
    before = lines(F.substring(text, F.lit(1), at - 1))
    narration = F.when((at > 0) & (F.size(before) > 0), F.element_at(before, -1)).otherwise("")
    span = F.regexp_substr(text, F.lit(pattern))
    dialogue = F.when(at > 0, strip(F.substring(span, F.lit(2), F.length(span) - 2))).otherwise(text)
    return narration, dialogue


def split_turn_strict(c: Column, most: int = 1200) -> tuple[Column, Column]:
    """Like ``split_turn`` with all text before the span as narration; both null if either is empty."""
    text = strip(F.coalesce(c, F.lit("")))
    pattern = f'"[^"\\n]{{1,{most}}}"'
    at = F.regexp_instr(text, F.lit(pattern))
    narration = strip(F.substring(text, F.lit(1), at - 1))
    span = F.regexp_substr(text, F.lit(pattern))
    dialogue = strip(F.substring(span, F.lit(2), F.length(span) - 2))
    good = (at > 0) & (narration != "") & (dialogue != "")
    return F.when(good, narration), F.when(good, dialogue)


def balanced_quotes(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) % 2 == 0


def keyword_any(c: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword occurs, literally."""
    out = F.lit(False)
    for k in keywords:
        out = out | c.contains(k)
    return F.coalesce(out, F.lit(False))


def keyword_hits(c: Column, keywords: Sequence[str]) -> Column:
    """How many different keywords occur."""
    out = F.lit(0)
    for k in keywords:
        out = out + F.coalesce(c.contains(k), F.lit(False)).cast("int")
    return out


def keyword_class(c: Column, lexicon: dict[str, Sequence[str]], order: Sequence[str], default: str) -> Column:
    """The class with most different keywords; ties go by ``order``; no hit gives ``default``."""
    hits = {k: keyword_hits(c, lexicon[k]) for k in order}
    most = F.greatest(*hits.values(), F.lit(0))
    out = F.when(most == 0, default)
    for k in order:
        out = out.when(hits[k] == most, k)
    return out.otherwise(default)


def one_hot_label(values: dict[str, Column], order: Sequence[str], default: str) -> Column:
    """The first class of ``order`` with a positive value, else ``default``."""
    out = None
    for k in order:
        good = F.coalesce(values[k] > 0, F.lit(False))
        out = F.when(good, k) if out is None else out.when(good, k)
    return out.otherwise(default)


def drop_lines(c: Column, *drop: Column | str, keep_blank: bool = False) -> Column:
    """Lines that match none of the patterns, joined again."""
    def kept(x: Column) -> Column:
        good = F.lit(True) if keep_blank else strip(x) != ""
        for p in drop:
            good = good & ~x.rlike(p)
        return good

    return F.array_join(F.filter(F.split(c, "\n", -1), kept), "\n")


def first_failure(rules: Sequence[tuple[str, Column]], passed: str = "") -> Column:
    """The code of the first rule whose condition holds, in the given order."""
    out = None
    for code, failed in rules:
        failed = F.coalesce(failed, F.lit(False))
        out = F.when(failed, code) if out is None else out.when(failed, code)
    return F.lit(passed) if out is None else out.otherwise(passed)


def intent(c: Column) -> Column:
    """question, decision, request, statement, or empty for a blank text; earlier kinds win."""
    low = F.lower(strip(c))
    return (
        F.when(F.coalesce(low, F.lit("")) == "", "")
        .when(low.contains("?"), "question")
        .when(low.rlike(r"(^|[^a-z])(decide|decided|will|must)([^a-z]|$)"), "decision")
        .when(low.rlike(r"(^|[^a-z])(please|let)([^a-z]|$)"), "request")
        .otherwise("statement")
    )


def signature(c: Column, length: int = 40) -> Column:
    """The first characters without punctuation and white space."""
    return F.substring(F.regexp_replace(F.lower(c), r"[\s.,!?\"'…:;()-]+", ""), 1, length)


def last_digits(c: Column) -> Column:
    """The last run of digits, or null."""
    found = F.regexp_extract_all(c, F.lit(r"\d+"), 0)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def after_marker(c: Column, marker: str) -> Column:
    """The text behind the first marker, or all of it."""
    at = F.instr(c, marker)
    return strip(F.when(at > 0, F.substring(c, at + len(marker), F.length(c))).otherwise(c))


def last_block(c: Column, marker: str, stops: Sequence[str]) -> Column:
    """What follows the last marker, up to the first of the stop marks."""
    out = F.substring_index(c, marker, -1)
    for s in stops:
        out = F.substring_index(out, s, 1)
    return strip(out)


def quote_if_needed(c: Column) -> Column:
    text = strip(c)
    return F.when(text.rlike(r'^".*"\z'), text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("")), F.lit('"')))


def guarded(original: Column, rewritten: Column, fine: Column) -> Column:
    """The rewrite where it keeps what it must, else the original."""
    return F.when(F.coalesce(fine, F.lit(False)), rewritten).otherwise(original)
