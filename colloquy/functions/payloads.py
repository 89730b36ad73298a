"""What texts of a model hold: JSON objects in them, the records therein, and the labels that a judge gives.

A text that cannot be read gives null; whoever wants an error filters for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.scores import clamp
from colloquy.functions.text import one_space, strip
from colloquy.functions.turns import bound, literal, visible_lines

# How long the texts of a candidate may be, and the fields of a payload.
CANDIDATE_TEXTS = {"type": 40, "subject": 24, "key": 120, "value": 400}
CANDIDATE_NUMBERS = ("confidence", "future_impact", "emotion_intensity")
PAYLOAD_FIELDS = ("assistant_raw", "scene", "user")
SCENE_BLOCKS = ("narration", "dialogue")
SCENE_LANGUAGES = ("ko", "jp")
SPEAKER = r"(?U)^\s*[^:\n]{1,20}\s*:\s*"
QUOTED_LINE = r'^"[^"\n]+"$'


def whole_json(c: Column) -> Column:
    """The text as one JSON value, as a variant; null if anything stands beside it."""
    boxed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return bound(F.try_variant_get(boxed, "$", "array<variant>"), lambda items: F.when(F.size(items) == 1, F.get(items, F.lit(0))))


def outermost_object(c: Column) -> Column:
    """From the first opening to the last closing brace, or null."""
    return F.nullif(F.regexp_extract(c, r"\{[\s\S]*\}", 0), F.lit(""))


def candidates(c: Column) -> Column:
    """The records under ``candidates`` of the outermost object: trimmed and cut texts, all of which must be there, and
    numbers clamped to 0 to 1, 0 where they are none. Nothing that can be read gives an empty array."""
    def text(x: Column, name: str) -> Column:
        return F.coalesce(strip(F.try_variant_get(x, f"$.{name}", "string")), F.lit(""))

    def number(x: Column, name: str) -> Column:
        return clamp(F.coalesce(F.try_variant_get(x, f"$.{name}", "double"), F.lit(0.0)))

    def record(x: Column) -> Column:
        return F.struct(
            *[F.substring(text(x, n), 1, most).alias(n) for n, most in CANDIDATE_TEXTS.items()],
            *[number(x, n).alias(n) for n in CANDIDATE_NUMBERS],
        )

    items = F.try_variant_get(whole_json(outermost_object(c)), "$.candidates", "array<variant>")
    records = F.transform(F.coalesce(items, F.array().cast("array<variant>")), record)
    return F.filter(records, lambda r: (r["type"] != "") & (r["subject"] != "") & (r["key"] != "") & (r["value"] != ""))


def first_object(c: Column) -> Column:
    """The first shortest span in braces that is an object, as it is or without commas before a closing sign, as a
    variant; null if there is none."""
    def parsed(x: Column) -> Column:
        return F.coalesce(whole_json(x), whole_json(F.regexp_replace(x, r"(?U),\s*([}\]])", "$1")))

    spans = F.regexp_extract_all(c, F.lit(r"(?s)\{.*?\}"), 0)
    return F.get(F.filter(F.transform(spans, parsed), lambda x: x.isNotNull()), F.lit(0))


def fenced_json(c: Column) -> Column:
    """What a fence marked json holds, unread; without one, the outermost object if it can be read; else null."""
    fence = r"```json\s*([\s\S]*?)\s*```"
    outer = outermost_object(c)
    return F.when(c.rlike(fence), strip(F.regexp_extract(c, fence, 1))).when(whole_json(outer).isNotNull(), outer)


def valid_payload(c: Column, player: Column, protagonist: Column, action_first: Column) -> Column:
    """Whether a JSON text is a payload: a user's text that does not name its speaker (with ``action_first``: whose last
    line does not hold the player's name, else: that does not begin with it), an answer of two lines that begins with the
    protagonist and ends in a quote, and a scene of that speaker with both blocks in both languages."""
    return bound(whole_json(c), lambda root: _valid_payload(root, player, protagonist, action_first))


def _valid_payload(root: Column, player: Column, protagonist: Column, action_first: Column) -> Column:
    def text(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(root, path, "variant"))
        return F.when(kind == "STRING", F.try_variant_get(root, path, "string"))

    user, answer = strip(text("$.user")), text("$.assistant_raw")
    asked, rows = visible_lines(user), visible_lines(answer)
    last = F.element_at(F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit(""))), -1)
    opening = F.rlike(user, F.concat(F.lit("(?U)^"), literal(player), F.lit(r"(?:[,\s]|$)")))
    good = (
        (F.array_sort(F.json_object_keys(F.to_json(root))) == F.array(*[F.lit(f) for f in PAYLOAD_FIELDS]))
        & (user != "") & ~user.rlike(SPEAKER) & ~F.when(action_first, last.contains(player)).otherwise(opening)
        & ~answer.contains("*") & (F.size(rows) == 2) & F.get(rows, F.lit(0)).startswith(protagonist) & F.get(rows, F.lit(1)).rlike(QUOTED_LINE)
        & (text("$.scene.speaker") == protagonist)
    )
    for block in SCENE_BLOCKS:
        for language in SCENE_LANGUAGES:
            good = good & (strip(text(f"$.scene.{block}.{language}")) != "")
    return F.coalesce(good, F.lit(False))


def _upper(c: Column) -> Column:
    return F.upper(one_space(F.coalesce(c, F.lit(""))))


def style_label(c: Column) -> Column:
    """informal, formal or unknown, from a judge's answer; English marks come before Korean ones."""
    up = _upper(c)
    return (
        F.when(up.contains("INFORMAL"), "informal").when(up.contains("FORMAL"), "formal")
        .when(up.contains("반말"), "informal").when(up.contains("존댓말"), "formal").otherwise("unknown")
    )


def style_mismatch(c: Column, formal: Column) -> Column:
    """Whether the judged style is not the wanted one; an unknown style is a mismatch, and without a wish none is."""
    return F.when(formal.isNull(), False).otherwise(style_label(c) != F.when(formal, "formal").otherwise("informal"))


def judged_bad(c: Column, *, unless: str | None = None, when: str | None = None) -> Column:
    """What a judge's answer says. With ``unless`` only that mark passes, so unclear answers are bad; with ``when`` only
    that mark is bad."""
    return ~_upper(c).contains(unless) if unless else _upper(c).contains(when)


def quality_failed(c: Column) -> Column:
    return judged_bad(c, unless="PASS")


def user_role_failed(c: Column) -> Column:
    return judged_bad(c, when="FAIL")


def stalled(c: Column) -> Column:
    """ADVANCE wins over STALL, and an unclear answer is an advance."""
    return judged_bad(c, when="STALL") & ~_upper(c).contains("ADVANCE")


def to_float(c: Column, default: float = 0.0) -> Column:
    """A number; the default where the text is none."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def to_int(c: Column, low: int, high: int, default: int) -> Column:
    """A whole number within bounds; the default where the text is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("bigint"), F.lit(default))))


def to_flag(c: Column) -> Column:
    """Whether a text is true, yes, y or 1, in either case; anything else is false."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "yes", "y", "1"), F.lit(False))
