"""Scenario texts in numbered sections: cleaning, fields, attributes told from the words around a keyword, and the first
rule that a text breaks.

White space and letters are those of Unicode; null texts count as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import first_failure, keyword_any, keyword_hits, one_space, strip
from colloquy.functions.turns import LINE_END, bound, literal

# Headings, labels, endings, names, default names and codes that results depend on.
PROTAGONISTS = ("사야", "마이", "코하루")
PLAYERS = ("하야토", "카즈키", "소마")
RELATIONS = ("적대", "거리감", "친밀", "사랑")
FORMAL, INFORMAL = "존댓말", "반말"
NO_PROTAGONIST, NO_PLAYER = "주인공", "플레이어"
MARKS = "*《》『』<>"
LEAST_LENGTH = 180
KEPT_LINES = 20
RECENT = r"(?U){}[^\n]{{0,20}}(?:최근|직전|마지막)[^\n]{{0,16}}(?:턴|대사|발화|선택)\b"
FORMAL_MARK = r"""(?U)(습니다|ㅂ니다|해요|이에요|예요|세요|주세요|할게요|고마워요|까요|죠)(?=[\s.!?…"”']|$)"""
INFORMAL_MARK = r"""(?U)(했어|할게|해볼게|해볼까|볼게|볼까|고마워|무서워|몰라|그래|맞아|거야|잖아)(?=[\s.!?…"”']|$)"""
FORMAL_END = r"""(?U)(습니다|ㅂ니다|해요|이에요|예요|세요|주세요|할게요|고마워요|까요|죠)\s*(["”']\s*)?$"""
INFORMAL_END = r"""(?U)(했어|할게|고마워|몰라|그래|맞아|야|냐|다|지)\s*(["”']\s*)?$"""
FORMAL_TAIL = r"""요\s*(["”']\s*)?$"""
INFORMAL_QUESTION = r"""(?U)까\??\s*(["”']\s*)?$"""
TURN_OF_PROTAGONIST = (r"주인공의\s*가장\s*최근\s*턴", r"주인공의\s*최근\s*턴", r"주인공의\s*턴")
FEMALE = r"(?U)(여주인공|성별\s*[:：]\s*여성|여성|여자|소녀|여전사|여사제)"
MALE = r"(?U)(남주인공|성별\s*[:：]\s*남성|남성|남자|소년|남전사|왕자)"
GENDER_KEYWORDS = ("주인공", "역할 선언", "성별")
NAME_LINE = r"(?U)이름\s*[:：]\s*([가-힣A-Za-z]{2,20})"
PROTAGONIST_CUES = ("주인공", "당신", "사야", "코하루", "마이")
PLAYER_CUES = ("플레이어", "카즈키", "하야토", "소마")
LEFTOVERS = (
    r"/[^/\n]{1,40}/",
    r"^\*\*[^*]{1,80}\*\*$",
    r"(?iU)^(\[Scene\s*Direction\]|Scene\s*Direction|Player'?s?\s+response\s+is\s+forced|must\s+choose|플레이어는\s+다음\s+중\s+하나를\s+선택)",
    r"(?iU)^(FSM|STATE|현재\s*상태|전환\s*됨|상태\s*[:=])",
    r"(?U)^(?:[(\[]?[A-C①②③④⑤]\)?[.)]|\d+[.)])\s",
    r"(?idU)(이제\s+.*(시작|진행)|아래는\s+.*(결과|출력)|다음은\s+.*(결과|출력)|본\s+출력은|위\s+기준을\s+충족)",
)


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _found(c: Column, pattern: str) -> Column:
    """What the group of the pattern has where it first matches, else null; for groups that are never empty."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def without_leftovers(c: Column) -> Column:
    """The lines that are not blank and bear no instruction, label, choice or state."""
    def kept(line: Column) -> Column:
        out = line != ""
        for pattern in LEFTOVERS:
            out = out & ~line.rlike(pattern)
        return out

    return F.array_join(F.filter(F.split(_given(c), "\n", -1), lambda x: bound(strip(x), kept)), "\n")


def cleaned(c: Column) -> Column:
    """Without stars and brackets of emphasis, and without runs of blanks and of empty lines."""
    blanks = F.regexp_replace(F.translate(_given(c), MARKS, ""), r"[ \t]+", " ")
    return strip(F.regexp_replace(blanks, r"\n{3,}", "\n\n"))


def until_section_7(c: Column) -> Column:
    """Up to section 7, of which the first line, which may be the break before it, and 20 further lines that are not
    blank stay."""
    heading = r"(?:^|\n)\s*7\.\s"

    def short(tail: Column) -> Column:
        rows = F.split(tail, LINE_END, -1)
        rest = F.slice(F.filter(F.slice(rows, 2, F.size(rows)), lambda x: strip(x) != ""), 1, KEPT_LINES)
        return F.array_join(F.concat(F.slice(rows, 1, 1), rest), "\n")

    def cut(text: Column) -> Column:
        head = F.regexp_extract(text, rf"(?sU)\A(.*?)(?={heading})", 1)
        whole = bound(head, lambda x: F.concat(x, bound(F.substring(text, F.length(x) + 1, F.length(text)), short)))
        return strip(F.when(text.rlike("(?U)" + heading), whole).otherwise(text))

    return bound(_given(c), cut)


def genre(c: Column) -> Column:
    return one_space(F.regexp_extract(_given(c), r"(?U)장르\s*:\s*([^\n]+)", 1))


def _bare(name: Column) -> Column:
    """A name without quotes and what stands in brackets; null if nothing is left."""
    plain = F.regexp_replace(name, "[「」『』《》\"']", "")
    return F.nullif(F.substring(strip(F.regexp_extract(plain, r"^([^(\[]*)", 1)), 1, 20), F.lit(""))


def _name_in(block: Column) -> Column:
    return _bare(strip(F.regexp_extract(block, r"(?U)이름\s*[:：]\s*([^\n]{1,24})", 1)))


def _unquoted_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(strip(name), "[「」『』《》\"']", ""), 1, 20)


def protagonist_name(c: Column) -> Column:
    """Who the reader is told to be, else the name in section 3, else any name, else the general word."""
    def told(t: Column) -> Column:
        own = F.regexp_extract(t, r"(?sU)3\.\s*주인공\s*정의(.*?)(?:\n\s*4\.\s*|$)", 1)
        bracketed = strip(_found(t, r"(?U)당신은\s*이제\s*「([^」]{1,20})」"))
        plain = strip(_found(t, r"""(?U)당신은\s*이제\s*([^\s.,:;"'“”]{1,20})\s*입니다"""))
        return F.coalesce(bracketed, plain, _name_in(own), _name_in(t), F.lit(NO_PROTAGONIST))

    return bound(_given(c), told)


def player_name(c: Column) -> Column:
    """The name in section 4, else one that a sentence or brackets give, else the general word."""
    def told(t: Column) -> Column:
        own = F.regexp_extract(t, r"(?sU)4\.\s*플레이어 정의(.*?)(?:\n\s*5\.\s*|$)", 1)
        named = _unquoted_name(_found(t, r"(?U)플레이어의\s*이름은\s*([^\s,.]{1,12})"))
        called = _unquoted_name(_found(t, r"""(?U)플레이어(?:인|는)\s*["'「]?([^\s,.]{1,12})"""))
        bracketed = _bare(strip(F.regexp_extract(t, r"(?U)플레이어\s*[(\[]\s*([^)\]\n]{1,20})\s*[)\]]", 1)))
        return F.coalesce(_name_in(own), named, called, bracketed, F.lit(NO_PLAYER))

    return bound(_given(c), told)


def relation_status(c: Column) -> Column:
    """The first known status on the status line of section 7, else on the first status line; empty without one."""
    def on_line(t: Column) -> Column:
        def known(line: Column) -> Column:
            out = F.when(line.contains(RELATIONS[0]), RELATIONS[0])
            for word in RELATIONS[1:]:
                out = out.when(line.contains(word), word)
            return out

        return bound(F.regexp_extract(t, r"(?U)관계\s*상태\s*[:：]\s*([^\n]{1,24})", 1), known)

    section = F.regexp_extract(_given(c), r"(?sU)(\n\s*7\.\s*가장\s*최근\s*상호작용.*?)(?=\n\s*\d+\.\s|\z)", 1)
    return F.coalesce(on_line(section), on_line(_given(c)), F.lit(""))


def formal_speech(c: Column) -> Column:
    """Whether section 6, or a text without one, asks for formal speech: by a labelled value, else by a word; null if
    neither is there."""
    def asked(block: Column) -> Column:
        label = r"(?U)(기본\s*말투|말투\s*범주|말투)\s*[:：]?\s*"
        return F.when(block.rlike(label + FORMAL), True).when(block.rlike(label + INFORMAL), False).when(block.contains(FORMAL), True).when(block.contains(INFORMAL), False)

    heading = r"(?sU)6\.\s*발화와\s*분위기\s*규칙"
    section = F.regexp_extract(_given(c), heading + r"(.*?)(?:\n\s*7\.\s*|$)", 1)
    return bound(F.when(_given(c).rlike(heading), section).otherwise(_given(c)), asked)


def _around(t: Column, keyword: str) -> Column:
    """200 characters before a keyword and 1200 from it on; empty without it."""
    at = F.instr(t, keyword)
    begin = F.greatest(at - 200, F.lit(1))
    return F.when(at > 0, F.substring(t, begin, at + 1200 - begin)).otherwise("")


def protagonist_gender(c: Column) -> Column:
    """'female', 'male' or null, by words near those that speak of the protagonist, then by pronouns there."""
    region = F.concat_ws("\n", *[_around(_given(c), k) for k in GENDER_KEYWORDS])
    return bound(
        region, lambda r: F.when(r.rlike(FEMALE), "female").when(r.rlike(MALE), "male").when(r.rlike(r"(?U)\b그녀\b"), "female").when(r.rlike(r"(?U)\b그\b"), "male")
    )


def told_names(c: Column) -> Column:
    """A struct (protagonist, player): names in sections 3 and 4; one that is not there is the first name, of those not
    taken as the other's, whose 120 characters before it speak of that person."""
    def told(t: Column) -> Column:
        own = _found(F.regexp_extract(t, r"(?sU)3\.\s*주인공\s*정의(.*?)(?:\n\s*4\.\s*플레이어\s*정의|\z)", 1), NAME_LINE)
        other = _found(F.regexp_extract(t, r"(?sU)4\.\s*플레이어\s*정의(.*?)(?:\n\s*5\.\s*관계|\z)", 1), NAME_LINE)
        places = F.zip_with(
            F.zip_with(F.regexp_extract_all(t, F.lit(NAME_LINE), 0), F.regexp_extract_all(t, F.lit(NAME_LINE), 1), lambda x, y: F.struct(x.alias("line"), y.alias("name"))),
            F.split(t, NAME_LINE, -1), lambda m, before: F.struct(before.alias("before"), m["line"].alias("line"), m["name"].alias("name")),
        )

        def seen(state: Column, place: Column) -> Column:
            near = F.right(F.concat(state["near"], place["before"]), F.lit(120))
            first = state["protagonist"].isNull() & keyword_any(near, PROTAGONIST_CUES)
            second = ~first & state["player"].isNull() & keyword_any(near, PLAYER_CUES)
            return F.struct(
                F.concat(near, _given(place["line"])).alias("near"), F.when(first, place["name"]).otherwise(state["protagonist"]).alias("protagonist"),
                F.when(second, place["name"]).otherwise(state["player"]).alias("player"),
            )

        start = F.struct(F.lit("").alias("near"), own.alias("protagonist"), other.alias("player"))
        return F.aggregate(places, start, seen, lambda s: F.struct(s["protagonist"].alias("protagonist"), s["player"].alias("player")))

    return bound(_given(c), told)


def asked_style(c: Column) -> Column:
    """The style of speech that section 6 sets; null if it sets none or both."""
    section = F.regexp_extract(_given(c), r"(?sU)(?:^|\n)\s*6\.\s*발화와 분위기 규칙\s*(.*?)(?=(?:\n\s*7\.\s*가장 최근 상호작용)|\z)", 1)
    value = F.regexp_extract(section, r"(?U)기본 말투(?:\s*범주)?\s*:\s*([^\n]+)", 1)
    return bound(value, lambda v: F.when(v.contains(FORMAL) & ~v.contains(INFORMAL), FORMAL).when(v.contains(INFORMAL) & ~v.contains(FORMAL), INFORMAL))


def recent_line(c: Column, names: Sequence[str] = PROTAGONISTS) -> Column:
    """What the protagonist last said by section 7, under the general word, the name in section 3 or a usual name."""
    def said(t: Column) -> Column:
        body = F.regexp_extract(t, r"(?sU)(?:^|\n)\s*7\.\s*가장 최근 상호작용\s*(.*)\z", 1)
        own = F.regexp_extract(t, r"(?sU)(?:^|\n)\s*3\.\s*주인공 정의\s*(.*?)(?=(?:\n\s*4\.\s*플레이어 정의)|\z)", 1)
        plain = F.regexp_replace(F.regexp_extract(own, r"(?U)이름\s*:\s*([^\n]+)", 1), "[「」『』\"']", "")
        name = F.nullif(strip(F.regexp_extract(strip(plain), r"^([^(\[]*)", 1)), F.lit(""))
        behind = r"[^\n:]*:\s*(.+)"
        heads = [F.lit(p) for p in TURN_OF_PROTAGONIST] + [F.concat(literal(n), F.lit(r"(?:의)?\s*(?:가장\s*)?(?:최근\s*)?턴")) for n in (name, *[F.lit(n) for n in names])]
        lines = [F.nullif(F.call_function("regexp_extract", body, F.concat(F.lit("(?dU)"), h, F.lit(behind)), F.lit(1)), F.lit("")) for h in heads]
        return F.regexp_replace(strip(F.coalesce(*lines)), "^[\"“”']+|[\"“”']+$", "")

    return bound(_given(c), said)


def line_style(c: Column) -> Column:
    """Formal or informal by endings inside a line, then by how its last sentence ends; null if both or neither."""
    def told(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"[.!?…\n]+", -1), strip), lambda x: x != "")
        last = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(strip(t))
        formal, informal = t.rlike(FORMAL_MARK), t.rlike(INFORMAL_MARK)
        by_end = bound(last, lambda x: F.when(x.rlike(FORMAL_END), FORMAL).when(x.rlike(INFORMAL_END), INFORMAL).when(x.rlike(FORMAL_TAIL), FORMAL).when(x.rlike(INFORMAL_QUESTION), INFORMAL))
        return F.when(t == "", None).when(formal & informal, None).when(formal, FORMAL).when(informal, INFORMAL).otherwise(by_end)

    return bound(_given(c), told)


def style_conflict(c: Column) -> Column:
    """Whether the protagonist's last line is not in the style that section 6 sets; a line without a style is not."""
    return bound(F.struct(asked_style(c).alias("asked"), recent_line(c).alias("line")), lambda x: F.when(x["asked"].isNull() | (_given(x["line"]) == ""), False).otherwise(
        F.coalesce(x["asked"] != line_style(x["line"]), F.lit(True))))


def scenario_code(c: Column) -> Column:
    """The first rule that a scenario text breaks; 'unknown' if none, and only then it is valid."""
    def checked(t: Column) -> Column:
        rules = [("too_short", F.length(t) < LEAST_LENGTH)]
        rules += [(f"section_missing_{i}", ~t.rlike(rf"(?mdU)^\s*{i}\.\s+")) for i in range(8)]
        rules += [("missing_recent_user", ~t.rlike(RECENT.format("플레이어"))), ("missing_recent_protagonist", ~t.rlike(RECENT.format("주인공")))]
        for who, names in (("protagonist", PROTAGONISTS), ("player", PLAYERS)):
            rules += [(f"{who}_count={n}", keyword_hits(t, names) == n) for n in range(len(names) + 1) if n != 1]
        return first_failure([*rules, ("speech_style_mismatch_sec6_sec7", style_conflict(t))], passed="unknown")

    return bound(strip(_given(c)), checked)


def valid_scenario(c: Column) -> Column:
    return scenario_code(c) == "unknown"
