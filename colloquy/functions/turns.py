"""Turns of a narration line and a quoted line: bringing texts into that form, and the first rule that a turn breaks.

White space and letters are those of Unicode. Null texts count as empty throughout; names are Columns, and an empty or
null name matches nothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import balanced_quotes, first_failure, one_space, strip

# Patterns, silent quotes, default lines and codes that results depend on. Patterns that are only looked
# for begin at the last character that decides, so that long lines take no quadratic time.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
QUOTE = r'"([^"]+)"'
SILENT = ("...", "…")
BREATH = "숨이 짧게 새어 나왔다."
PAUSE = "잠시 숨을 고른다."
PARENTHESIS_OR_STAR = r"[()*]"
COLON = r"[:：]"
COLON_HEAD = r"(?U)^\s*[:：]"
LABEL_HEAD = r"(?iU)^\s*(요구|선언|결정|선택|지시|조건|판정|명령)\s*[:：]\s*"
META = r"(?iU)(\*+|프롬프트|요청하신|요청된|시나리오북|헌법|검증|메타|role\s*check|system\s*check|langgraph|fsm|phase|노드|그래프|평가|json|prompt|instruction|guideline)"
META_BLOCK = r"(?iU)(장면\s*전환|다음\s*장면|다음\s*장면\s*전개|다음\s*행동|선택지|선택하세요|다음\s*전개|전개\s*요약|요약\s*:|결론\s*:|소마의\s*다음\s*행동|.의\s*선택\s*:)"
META_BLOCK_LINE = r"(?iU)^\s*(---+|장면\s*전환|다음\s*장면.*|다음\s*장면\s*전개:.*|선택지.*|선택하세요.*|.*의\s*선택\s*:.*|다음\s*행동.*)\s*$"
POLICY_LINE = (
    r"(?iU)^\s*(?:[-•·]\s*)?(?:\d+\.\s*)?(장르|관계\s*상태|관계\s*변화\s*의도|현재\s*상태|현재\s*국면|행위/사건\s*상태|응답\s*모드|성행위\s*허용|정서의존\s*허용도|정신\s*불안정|"
    r"친밀도|위협도|압박|탐색|시나리오북|주인공\s*이름|플레이어\s*이름|출력\s*규칙|형식\s*예시|단계별\s*힌트|이야기\s*방향과\s*시대|역할\s*선언|세계와\s*상황\s*설정|주인공\s*정의|"
    r"플레이어\s*정의|관계\s*및\s*변화\s*규칙|발화와\s*분위기\s*규칙|가장\s*최근\s*상호작용|관능적\s*묘사|수위|톤|허용|성행위\s*규칙)\s*[:：]"
)
POLICY_PHRASE = (
    r"(?iU)(장르와\s*행위/?상태\s*반영|형식\s*골격|판정\s*기준|말투\s*규칙|출력\s*규칙|단계\s*힌트|관계\s*상태|관계\s*변화\s*의도|현재\s*국면|FSM|"
    r"(적대|거리감|친밀|사랑)\s*단계|사랑의\s*관계|관계로\s*연결)"
)
FORMAL = r"(?U)(습니다|합니다|됩니|십니다|세요|이에요|예요|에요|니다)(?:[\s.!?…]|$)"
DANGLING = r"(?:[가-힣A-Za-z0-9](?:을|를|이|가|은|는|와|과|에게|한테|께)|그리고|하지만|그런데|그래서|그러니까|혹은|또는|만약)$"
TOLD = r"(?U)(했다|되었다|있었다|이었다|였다)\b"
BRACKET_LABEL = r"(?iU)^\s*[\[(].*?(서술|대사|행동|출력|정보|첫\s*번째|첫째|둘째).*?[\])]\s*$"
OWNED_LABEL = r"(?iU)^[^\s]{1,12}의\s*(서술|대사|행동|반응|대답|신체적\s*반응|행동/신체적\s*반응(?:\s*및\s*대사)?)"
LINE_LABEL = r"(?iU)^\s*[-•·]?\s*(서술|대사|행동|반응|대답|정보\s*공개|Action|Narration|Dialogue|Speech|Player'?s\s*Action)\s*[:：]\s*"
SPEAKER_LABEL = r'(?U)^\s*"?[^"\n:]{1,20}\s*:\s*'
PLAYER_WORDS = r"(?U)(?<!\{)(사용자|플레이어|유저)(?!\})"
PLAYER_NAMES = ("하야토", "카즈키", "소마")
TRUNCATED_FROM = 8
NARRATION_FROM = 6


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the expression has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(rows: Column, i: int) -> Column:
    """An element counted from 0, or from the end if below; empty where there is none."""
    return _given(F.try_element_at(rows, F.lit(i + 1 if i >= 0 else i)))


def visible_lines(c: Column) -> Column:
    """Trimmed lines at every line end that Unicode knows, without blank ones."""
    return F.filter(F.transform(F.split(_given(c), LINE_END, -1), strip), lambda x: x != "")


def quotes(c: Column) -> Column:
    """Texts between double quotes, trimmed, without blank ones."""
    return F.filter(F.transform(F.regexp_extract_all(_given(c), F.lit(QUOTE), 1), strip), lambda x: x != "")


def single_quote(c: Column) -> Column:
    """The quoted text if there is exactly one, else null."""
    return bound(quotes(c), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def unquoted(c: Column) -> Column:
    return strip(F.replace(_given(c), F.lit('"'), F.lit("")))


def literal(c: Column) -> Column:
    """A pattern that matches the text of a column as it is."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _named(c: Column, name: Column, before: str, after: str) -> Column:
    """Whether the text has the name between two patterns."""
    name = _given(name)
    return (name != "") & F.rlike(c, F.concat(F.lit("(?U)" + before), literal(name), F.lit(after)))


def speaker_label(c: Column, *names: Column) -> Column:
    """Whether the text begins with one of the names and a colon."""
    out = F.lit(False)
    for n in names:
        out = out | _named(c, n, r"^\s*(?:", r")\s*[:：]\s*")
    return out


def third_person(c: Column, name: Column) -> Column:
    """Whether the text speaks about the name, that is, has it with a particle of subject or object."""
    return _named(c, name, "", r"\s*(이|가|을|를|에게|한테|께)(?=[^가-힣]|$)")


def truncated(c: Column) -> Column:
    """Whether a quoted text of eight characters or more stops at a particle or a connective."""
    return bound(one_space(unquoted(c)), lambda plain: (F.length(plain) >= TRUNCATED_FROM) & plain.rlike(DANGLING))


def strip_label(c: Column) -> Column:
    """A line without the labels before it; one that is nothing but a label becomes empty."""
    def bare(whole: Column) -> Column:
        out = F.regexp_replace(whole, r"(?iU)^\s*ACT\s*\d+\s*[:：]\s*", "")
        for pattern in (r"(?U)^\s*\d+\s*[.)]\s*", OWNED_LABEL + r"\s*[:：]?\s*", r"(?U)^\s*[:：]+\s*"):
            out = F.regexp_replace(out, pattern, "")
        out = strip(F.regexp_replace(strip(out), LINE_LABEL, ""))
        return F.when(whole.rlike(BRACKET_LABEL), "").otherwise(F.regexp_replace(out, OWNED_LABEL + r"\z", ""))

    return bound(strip(_given(c)), bare)


def unlabelled_lines(c: Column) -> Column:
    return F.filter(F.transform(visible_lines(c), strip_label), lambda x: x != "")


def quoted_line(c: Column) -> Column:
    """One line in quotes: what is between the first and the last quote, or the whole text; dots if that is nothing."""
    def inner(text: Column) -> Column:
        return F.when(F.regexp_count(text, F.lit('"')) >= 2, strip(F.regexp_extract(text, r'(?s)"(.*)"', 1))).otherwise(text)

    return bound(bound(strip(_given(c)), inner), lambda said: F.concat(F.lit('"'), F.when(said == "", SILENT[0]).otherwise(said), F.lit('"')))


def two_lines(c: Column) -> Column:
    """A narration and a quoted line made of any text. The quote is the first line behind the narration that holds
    exactly one quoted text which says something, else the second line; missing narration is filled in."""
    def spoken(x: Column) -> Column:
        return bound(single_quote(x), lambda found: F.when(~found.isin(*SILENT), F.concat(F.lit('"'), found, F.lit('"'))))

    def made(rows: Column) -> Column:
        first = _at(rows, 0)
        said = F.filter(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), spoken), lambda x: x.isNotNull())
        told = bound(unquoted(first), lambda x: F.when(x == "", BREATH).otherwise(x))
        return F.when(F.size(rows) == 0, f'{BREATH}\n"..."').when(
            F.size(rows) == 1, F.concat(F.lit(BREATH + "\n"), F.coalesce(spoken(first), quoted_line(unquoted(first))))
        ).otherwise(F.concat(told, F.lit("\n"), F.coalesce(F.get(said, F.lit(0)), quoted_line(unquoted(_at(rows, 1))))))

    return bound(unlabelled_lines(c), made)


def first_sentence(c: Column) -> Column:
    return _given(F.get(F.filter(F.split(one_space(c), r"(?<=[.!?…])\s+", -1), lambda x: x != ""), F.lit(0)))


def two_sentences(c: Column, default: str = PAUSE) -> Column:
    """A narration and a quoted line of one sentence each, from the first and the last line."""
    def made(rows: Column) -> Column:
        last = _at(rows, -1)
        said = quoted_line(first_sentence(F.coalesce(single_quote(last), unquoted(last))))
        narration = F.when(F.size(rows) > 1, first_sentence(unquoted(_at(rows, 0)))).otherwise("")
        missing = F.when(F.size(rows) == 0, F.lit(default)).otherwise(first_sentence(F.lit(default)))
        return F.concat(bound(narration, lambda x: F.when(x != "", x).otherwise(missing)), F.lit("\n"), said)

    return bound(unlabelled_lines(c), made)


def quoted_turn(c: Column) -> Column:
    """A turn without stars: the first line, and the last without its speaker and in quotes; a single line is the
    quote. Blank texts become empty."""
    def quote(x: Column) -> Column:
        closed = F.concat(F.lit('"'), x, F.lit('"'))
        return F.when(x.startswith('"') & x.endswith('"') & (x != ""), x).otherwise(closed)

    def made(rows: Column) -> Column:
        said = bound(strip(F.regexp_replace(_at(rows, -1), SPEAKER_LABEL, "")), quote)
        return F.when(F.size(rows) == 0, "").when(F.size(rows) == 1, said).otherwise(F.concat(_at(rows, 0), F.lit("\n"), said))

    return bound(visible_lines(F.replace(_given(c), F.lit("*"), F.lit(""))), made)


def no_space_before_break(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t]+\n", "\n")


def chosen_name(key: Column, names: Sequence[str] = PLAYER_NAMES, seed: str = "") -> Column:
    """One of the names, by hash of a seed and a key."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") % len(names)
    return F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))


def fill_placeholder(c: Column, name: Column) -> Column:
    return F.replace(c, F.lit("{{user}}"), name)


def _healed(c: Column, name: Column) -> Column:
    """Names whose letters stand apart, closed up again."""
    letters = F.filter(F.split(name, ""), lambda x: x != "")
    pattern = F.concat(F.lit("(?U)"), F.array_join(F.transform(letters, literal), r"\s*"))
    return F.when(_given(name) == "", c).otherwise(F.regexp_replace(c, pattern, _replacement(name)))


def _replacement(name: Column) -> Column:
    return F.regexp_replace(name, r"([\\$])", r"\\$1")


def protagonist_named(c: Column, name: Column) -> Column:
    """The protagonist under the own name; without a name the text stays."""
    return F.when(_given(name) == "", _given(c)).otherwise(_healed(F.replace(_given(c), F.lit("주인공"), name), name))


def player_named(c: Column, name: Column, others: Sequence[str] = PLAYER_NAMES) -> Column:
    """The player under the own name, also where a placeholder, a general word or another usual name stands."""
    told = F.when(_given(name) == "", "플레이어").otherwise(name)
    out = F.replace(_given(c), F.lit("{{user}}"), told)
    for pattern in (r"(?i)(?<!\{)\{user\}(?!\})", PLAYER_WORDS, r"(?iU)(?<!\{)\buser\b(?!\})"):
        out = F.regexp_replace(out, F.lit(pattern), _replacement(told))
    out = _healed(out, name)
    for other in others:
        out = F.when(_given(name) == "", out).otherwise(F.replace(out, F.lit(other), _given(name)))
    return out


def without_square_brackets(c: Column) -> Column:
    return F.regexp_replace(_given(c), r"\[([^\[\]]+)\]", "$1")


def without_meta(c: Column) -> Column:
    """Without the lines that speak about the task instead of the scene, and without what is left of such words."""
    def kept(x: Column) -> Column:
        return bound(strip(x), lambda row: (row != "") & ~row.rlike(META_BLOCK_LINE) & ~row.rlike(META_BLOCK) & ~row.rlike(META) & ~row.rlike(POLICY_LINE))

    rows = F.split(F.regexp_replace(_given(c), r"\[\[|\]\]", ""), LINE_END, -1)
    out = F.regexp_replace(F.array_join(F.filter(rows, kept), "\n"), META, "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"(?iU)\bACT\s*\d+\b", ""), r"[ \t]+", " "))


def _silent(c: Column) -> Column:
    return c.isin(*SILENT)


def user_code(c: Column, player: Column, protagonist: Column) -> Column:
    """The first rule that a user's turn breaks, or empty. It holds one quote, on its last line, behind at most one line
    of action."""
    return bound(strip(_given(c)), lambda t: bound(
        F.struct(t.alias("text"), visible_lines(t).alias("rows"), quotes(t).alias("found")), lambda v: _user_code(v["text"], v["rows"], v["found"], player, protagonist)
    ))


def _user_code(t: Column, rows: Column, found: Column, player: Column, protagonist: Column) -> Column:
    first, last, said = _at(rows, 0), _at(rows, -1), _at(found, 0)
    leak = F.exists(rows, lambda x: x.rlike(POLICY_LINE)) | t.rlike(POLICY_PHRASE)
    return first_failure([
        ("user_empty", t == ""),
        ("user_forbidden_chars", t.rlike(PARENTHESIS_OR_STAR)),
        ("user_colon_char", t.rlike(COLON)),
        ("user_unbalanced_quotes", ~balanced_quotes(t)),
        ("user_requires_single_quote", F.size(found) != 1),
        ("user_quote_silent", _silent(said)),
        ("user_dialogue_colon_head", said.rlike(COLON_HEAD)),
        ("user_dialogue_label_prefix", said.rlike(LABEL_HEAD)),
        ("user_role_conflict", _named(first, protagonist, r"^\s*", r"\s*(?:이|가|은|는)\b")),
        ("user_policy_leak", leak),
        ("user_speaker_label", speaker_label(first, player, protagonist)),
        ("user_too_many_lines", F.size(rows) > 2),
        ("user_last_line_must_be_quote", single_quote(last).isNull()),
        ("user_dialogue_truncated", truncated(said)),
        ("user_action_formal", first.rlike(FORMAL)),
    ])


def assistant_code(c: Column, player: Column, protagonist: Column) -> Column:
    """The first rule that an assistant's turn breaks, or empty. Without labels it has two lines: a narration without
    quotes and one quoted line that is neither silent nor a narration itself."""
    return bound(strip(_given(c)), lambda t: bound(unlabelled_lines(t), lambda rows: bound(
        F.struct(t.alias("text"), rows.alias("rows"), quotes(_at(rows, 1)).alias("found")), lambda v: _assistant_code(v["text"], v["rows"], v["found"], player, protagonist)
    )))


def _assistant_code(t: Column, rows: Column, found: Column, player: Column, protagonist: Column) -> Column:
    told, dialogue, said = _at(rows, 0), _at(rows, 1), _at(found, 0)
    meta = t.rlike(META) | t.rlike(META_BLOCK) | F.exists(visible_lines(t), lambda x: x.rlike(META_BLOCK_LINE))
    leak = F.exists(rows, lambda x: x.rlike(POLICY_LINE)) | t.rlike(POLICY_PHRASE)
    return first_failure([
        ("asst_empty", t == ""),
        ("asst_forbidden_chars", t.rlike(PARENTHESIS_OR_STAR)),
        ("asst_colon_char", t.rlike(COLON)),
        ("asst_meta", meta),
        ("asst_unbalanced_quotes", ~balanced_quotes(t)),
        ("asst_requires_two_lines", F.size(rows) != 2),
        ("asst_policy_leak", leak),
        ("asst_speaker_label", speaker_label(told, protagonist, player) | speaker_label(dialogue, protagonist, player)),
        ("asst_narr_formal", told.rlike(FORMAL)),
        ("asst_narr_has_quote", told.contains('"')),
        ("asst_dia_requires_single_quote", F.size(found) != 1),
        ("asst_dia_silent", _silent(said)),
        ("asst_dia_colon_head", said.rlike(COLON_HEAD)),
        ("asst_dia_label_prefix", said.rlike(LABEL_HEAD)),
        ("asst_dialogue_numeric", said.rlike(r"(?U)^\s*\d+\s*\.?\s*\z")),
        ("asst_dialogue_truncated", truncated(said)),
        ("asst_player_third_person", third_person(said, player)),
        ("asst_dialogue_narration", (_given(protagonist) != "") & said.contains(_given(protagonist)) & said.rlike(TOLD)),
        ("asst_narr_too_short", F.length(one_space(told)) < NARRATION_FROM),
    ])


def crisis_code(c: Column, player: Column) -> Column:
    """The first rule that a turn at a crisis breaks, or empty."""
    return bound(strip(_given(c)), lambda t: bound(F.struct(t.alias("text"), visible_lines(t).alias("rows")), lambda v: _crisis_code(v["text"], v["rows"], player)))


def _crisis_code(t: Column, rows: Column, player: Column) -> Column:
    told, dialogue = _at(rows, 0), _at(rows, 1)
    return first_failure([
        ("crisis_empty", t == ""),
        ("crisis_forbidden_chars", t.rlike(PARENTHESIS_OR_STAR)),
        ("crisis_colon_char", t.rlike(COLON)),
        ("crisis_unbalanced_quotes", ~balanced_quotes(t)),
        ("crisis_requires_two_lines", F.size(rows) != 2),
        ("crisis_no_narr_line", told.startswith('"') & told.endswith('"')),
        ("crisis_requires_single_quote", ~(dialogue.startswith('"') & dialogue.endswith('"'))),
        ("crisis_player_third_person", third_person(unquoted(dialogue), player)),
    ])


# How dialogue ends in a narration, and the particles behind a pronoun.
SPOKEN_END = r"(?U)(요|죠|네요|군요|할게|줄게|가자|하자|해줘|알겠어|알았어|걱정\s*마)$"
PARTICLES = "은|는|이|가|을|를|의|에게|에서|으로|와|과|랑|한테|께|도|만|까지|부터|조차|마저|처럼|보다"


def told_as_dialogue(c: Column, *names: Column) -> Column:
    """Whether a narration sounds like speech: a question or exclamation mark, a name called, or a sentence that ends as
    speech does."""
    out = _given(c).rlike("[?!]")
    for n in names:
        out = out | _named(_given(c), n, r"\b", r"\s*,")
    return out | F.exists(F.transform(F.split(_given(c), r"(?U)[.…]\s*", -1), strip), lambda x: x.rlike(SPOKEN_END))


def replace_word(c: Column, word: Column, by: Column) -> Column:
    """A word replaced where no letter touches it; an empty or null word or replacement changes nothing."""
    pattern = F.concat(F.lit("(?<![가-힣A-Za-z])"), literal(word), F.lit("(?![가-힣A-Za-z])"))
    return F.when((_given(word) != "") & (_given(by) != ""), F.regexp_replace(c, pattern, _replacement(by))).otherwise(c)


def pronoun_for_protagonist(c: Column, female: Column) -> Column:
    """The general word for the protagonist as a pronoun, with the particle it has."""
    pronoun = F.when(F.coalesce(female, F.lit(False)), "그녀").otherwise("그")
    return F.regexp_replace(c, F.lit(rf"(?U)\b주인공({PARTICLES})?\b"), F.concat(pronoun, F.lit("$1")))
