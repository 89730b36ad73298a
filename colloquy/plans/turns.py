"""Queries over turns, rule codes, payloads and labels, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import payloads
from colloquy.functions import turns as rules
from colloquy.operators import rows
from colloquy.operators.gate import turn_gate
from colloquy.plans import read

# Shapes of test turns; the text of the turn stands for @, and the shape goes by conversation and turn.
SHAPES = (
    '@', '"@"', 'Bo nods slowly\n"@"', 'Bo nods (a bit)\n"@"', 'Ann: so\n"@"', 'Bo nods slowly\n"@', 'Bo nods slowly\n"..."', '판정 기준\n"@"', 'one\ntwo\n"@"',
    '"@"\nBo nods slowly', 'Bo nods slowly\n"나는 오늘 학교에서 너를"', '손을 들었습니다.\n"@"', 'Bo says "a"\n"@"', 'Bo\n"@"', '1. Bo nods slowly\n"@"', 'Bo nods slowly\n" 12. "',
    'Bo nods slowly\n"Ann가 왔다 @"', 'Bo nods slowly\n"Bo는 웃었다 했다."', 'Bo는 웃는다\n"@"', '[서술]\nBo nods slowly\n"@"', '선택지 하나\nBo nods slowly\n"@"', '   ',
)


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), ((F.col("conv_id") * 7 + F.col("turn") * 3) % len(SHAPES) + 1).cast("int"))
    return turns.select("conv_id", "turn", "role", F.replace(shape, F.lit("@"), F.coalesce("text", F.lit(""))).alias("text"), F.lit("Ann").alias("player"), F.lit("Bo").alias("protagonist"))


def turn_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, player, protagonist = F.col("text"), F.col("player"), F.col("protagonist")
    return _shaped(spark, sf_dir).select(
        "conv_id", "turn", rules.user_code(t, player, protagonist).alias("user_code"), rules.assistant_code(t, player, protagonist).alias("assistant_code"),
        rules.crisis_code(t, player).alias("crisis_code"),
    )


def turn_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _shaped(spark, sf_dir).select(
        "conv_id", "turn", F.md5(rules.quoted_turn(t)).alias("quoted_md5"), F.md5(rules.quoted_line(t)).alias("line_md5"),
        F.size(rules.quotes(t)).cast("long").alias("n_quotes"), F.md5(F.coalesce(rules.single_quote(t), F.lit(""))).alias("single_md5"),
        F.md5(rules.no_space_before_break(F.replace(t, F.lit("\n"), F.lit(" \t\n")))).alias("breaks_md5"), rules.truncated(t).alias("truncated"),
    )


def gated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turn_gate(_shaped(spark, sf_dir))
    return found.select("conv_id", "turn", F.md5("text").alias("text_md5"), "code")


def quoted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.quoted_span_rows(_shaped(spark, sf_dir), most=100_000)
    return found.select("conv_id", "turn", F.col("span").cast("long").alias("span"), F.md5("text").alias("text_md5"))


def chosen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    name = rules.chosen_name(F.col("conv_id"), ("Ann", "Bo", "Cy"), seed="5")
    said = rules.fill_placeholder(F.concat(F.lit("{{user}}, "), F.col("text")), name)
    return turns.select("conv_id", "turn", name.alias("name"), F.md5(said).alias("text_md5"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    given = F.when(F.col("role") == "user", F.col("text"))
    return turns.select(
        "conv_id", "turn", F.md5(rows.instruction_prompt(F.lit(" Answer. "), given)).alias("instruction_md5"), F.md5(rows.translation_prompt(F.lit("Translate."), given)).alias("translation_md5"),
        F.coalesce(F.size(rows.three_messages(F.lit("Be kind."), given, F.col("text"), strict=False)), F.lit(0)).cast("long").alias("n_messages"),
    )


def memory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON into a text and read from it again: every fourth text lacks a key, every ninth has broken
    JSON."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    key = F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.repeat(F.col("event_type"), 30))
    record = F.struct(
        F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("type"), F.col("user_id").cast("string").alias("subject"), key.alias("key"), F.col("event_id").alias("value"),
        ((F.col("event_id") % 30) / 10 - 1).alias("confidence"), F.lit("none").alias("future_impact"),
    )
    body = F.to_json(F.struct(F.array(record).alias("candidates")))
    said = F.concat(F.lit("Found: "), F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), body)).otherwise(body), F.lit(" That is all."))
    found = e.select("event_id", F.explode(payloads.candidates(said)).alias("c"))
    return found.select("event_id", "c.type", "c.subject", "c.key", "c.value", F.round("c.confidence", 6).alias("confidence"), F.col("c.future_impact").alias("future_impact"))


def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects behind broken ones, with commas too many, and in fences."""
    e = read(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id").cast("string")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('so {x} {"n": '), i, F.lit(', } {"n": 0}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('```json\n {"n": '), i, F.lit("} \n```"))).otherwise("nothing {")
    first = payloads.first_object(said)
    return e.select("event_id", F.try_variant_get(first, "$.n", "long").alias("n"), payloads.fenced_json(said).alias("fenced"))


def judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id")
    answers = ("It is Formal.", "informal", "반말", "존댓말", "unsure", "PASS", "fail, not pass", "advance", "stall", " yes ", "1", "2.5", "")
    said = F.element_at(F.array(*[F.lit(a) for a in answers]), (F.col("event_id") % len(answers) + 1).cast("int"))
    formal = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1)
    return e.select(
        "event_id", payloads.style_label(said).alias("style"), payloads.style_mismatch(said, formal).alias("mismatch"), payloads.quality_failed(said).alias("failed"),
        payloads.user_role_failed(said).alias("role_failed"), payloads.stalled(said).alias("stalled"), payloads.to_flag(said).alias("flag"),
        payloads.to_float(said, -1.0).alias("number"),
    )


QUERIES = {f.__name__: f for f in (turn_codes, turn_forms, gated_turns, quoted_spans, chosen_names, prompts, memory_candidates, first_objects, judge_labels)}

_S = "[" + ", ".join("'" + s.replace("\n", "§") + "'" for s in SHAPES) + "]"
_T = f"t AS (SELECT conv_id, turn, role, replace(replace({_S}[((conv_id * 7 + turn * 3) % {len(SHAPES)} + 1)::INT], '§', chr(10)), '@', coalesce(text, '')) AS x FROM conversations)"
_LINES = r"list_filter(list_transform(string_split({}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')"
_QUOTES = """list_filter(list_transform(regexp_extract_all({}, '"([^"]+)"', 1), lambda l: trim(l)), lambda l: l <> '')"""
_LEFT_OPEN = "(length({0}) >= 8 AND regexp_matches({0}, '([가-힣A-Za-z0-9]+(을|를|이|가|은|는|와|과|에게|한테|께)|그리고|하지만|그런데|그래서|그러니까|혹은|또는|만약)$'))"
_BALANCED = """(length(s) - length(replace(s, '"', ''))) % 2 = 0"""
_FORMAL = r"'(습니다|합니다|됩니|십니다|세요|이에요|예요|에요|니다)([\s.!?…]|$)'"

ORACLE_SQL = {
    "turn_codes": rf"""WITH {_T}, a AS (SELECT conv_id, turn, regexp_replace(x, '^\s+|\s+$', '', 'g') AS s FROM t),
        b AS (SELECT *, {_LINES.format('s')} AS ls, {_QUOTES.format('s')} AS q FROM a),
        c AS (SELECT *, list_filter(list_transform(ls, lambda l: CASE WHEN l = '[서술]' THEN '' ELSE regexp_replace(l, '^\s*\d+\s*[.)]\s*', '') END), lambda l: l <> '') AS bare FROM b),
        d AS (SELECT *, {_QUOTES.format("coalesce(bare[2], '')")} AS q2, {_BALANCED} AS even, regexp_matches(s, '판정 기준|말투 규칙') AS leak FROM c),
        e AS (SELECT *, coalesce(q[1], '') AS said, coalesce(q2[1], '') AS spoken FROM d)
        SELECT conv_id, turn, CASE WHEN s = '' THEN 'user_empty' WHEN regexp_matches(s, '[()*]') THEN 'user_forbidden_chars' WHEN s LIKE '%:%' THEN 'user_colon_char'
          WHEN NOT even THEN 'user_unbalanced_quotes' WHEN len(q) <> 1 THEN 'user_requires_single_quote' WHEN said = '...' THEN 'user_quote_silent'
          WHEN regexp_matches(ls[1], '^Bo\s*(이|가|은|는)([^가-힣A-Za-z0-9_]|$)') THEN 'user_role_conflict' WHEN leak THEN 'user_policy_leak' WHEN len(ls) > 2 THEN 'user_too_many_lines'
          WHEN len({_QUOTES.format('ls[-1]')}) <> 1 THEN 'user_last_line_must_be_quote' WHEN {_LEFT_OPEN.format('said')} THEN 'user_dialogue_truncated'
          WHEN regexp_matches(ls[1], {_FORMAL}) THEN 'user_action_formal' ELSE '' END AS user_code,
          CASE WHEN s = '' THEN 'asst_empty' WHEN regexp_matches(s, '[()*]') THEN 'asst_forbidden_chars' WHEN s LIKE '%:%' THEN 'asst_colon_char'
          WHEN regexp_matches(s, '(?i)선택지|json|prompt|phase|fsm|langgraph|instruction|guideline|role\s*check|system\s*check') THEN 'asst_meta' WHEN NOT even THEN 'asst_unbalanced_quotes'
          WHEN len(bare) <> 2 THEN 'asst_requires_two_lines' WHEN leak THEN 'asst_policy_leak' WHEN regexp_matches(bare[1], {_FORMAL}) THEN 'asst_narr_formal'
          WHEN bare[1] LIKE '%"%' THEN 'asst_narr_has_quote' WHEN len(q2) <> 1 THEN 'asst_dia_requires_single_quote' WHEN spoken = '...' THEN 'asst_dia_silent'
          WHEN regexp_matches(spoken, '^\s*\d+\s*\.?\s*$') THEN 'asst_dialogue_numeric' WHEN {_LEFT_OPEN.format('spoken')} THEN 'asst_dialogue_truncated'
          WHEN regexp_matches(spoken, 'Ann\s*(이|가|을|를|에게|한테|께)([^가-힣]|$)') THEN 'asst_player_third_person'
          WHEN spoken LIKE '%Bo%' AND regexp_matches(spoken, '(했다|되었다|있었다|이었다|였다)([^가-힣A-Za-z0-9_]|$)') THEN 'asst_dialogue_narration'
          WHEN length(bare[1]) < 6 THEN 'asst_narr_too_short' ELSE '' END AS assistant_code,
          CASE WHEN s = '' THEN 'crisis_empty' WHEN regexp_matches(s, '[()*]') THEN 'crisis_forbidden_chars' WHEN s LIKE '%:%' THEN 'crisis_colon_char' WHEN NOT even THEN 'crisis_unbalanced_quotes'
          WHEN len(ls) <> 2 THEN 'crisis_requires_two_lines' WHEN ls[1] LIKE '"%' AND ls[1] LIKE '%"' THEN 'crisis_no_narr_line' WHEN NOT (ls[2] LIKE '"%' AND ls[2] LIKE '%"') THEN 'crisis_requires_single_quote'
          WHEN regexp_matches(replace(ls[2], '"', ''), 'Ann\s*(이|가|을|를|에게|한테|께)([^가-힣]|$)') THEN 'crisis_player_third_person' ELSE '' END AS crisis_code FROM e""",
    "turn_forms": rf"""WITH {_T}, b AS (SELECT *, {_LINES.format("replace(x, '*', '')")} AS ls, {_QUOTES.format('x')} AS q, regexp_replace(x, '^\s+|\s+$', '', 'g') AS s FROM t),
        c AS (SELECT *, regexp_replace(coalesce(ls[-1], ''), '^\s*"?[^"\n:]{{1,20}}\s*:\s*', '') AS last, CASE WHEN length(s) - length(replace(s, '"', '')) >= 2 THEN trim(regexp_extract(s, '(?s)"(.*)"', 1)) ELSE s END AS inner_text,
          regexp_replace(regexp_replace(replace(x, '"', ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS plain FROM b),
        d AS (SELECT *, CASE WHEN last LIKE '"%' AND last LIKE '%"' THEN last ELSE '"' || last || '"' END AS quoted FROM c)
        SELECT conv_id, turn, md5(CASE len(ls) WHEN 0 THEN '' WHEN 1 THEN quoted ELSE ls[1] || chr(10) || quoted END) AS quoted_md5, md5('"' || CASE WHEN inner_text = '' THEN '...' ELSE inner_text END || '"') AS line_md5,
          len(q)::BIGINT AS n_quotes, md5(CASE WHEN len(q) = 1 THEN q[1] ELSE '' END) AS single_md5, md5(regexp_replace(x, '[ \t]+\n', chr(10), 'g')) AS breaks_md5, {_LEFT_OPEN.format('plain')} AS truncated FROM d""",
    "quoted_spans": f"""WITH {_T}, q AS (SELECT conv_id, turn, regexp_extract_all(x, '"([^"\\n]+)"', 1) AS q FROM t WHERE role = 'assistant'),
        u AS (SELECT conv_id, turn, q, unnest(range(len(q))) AS span FROM q) SELECT conv_id, turn, span::BIGINT AS span, md5(q[span + 1]) AS text_md5 FROM u""",
    "chosen_names": """WITH n AS (SELECT conv_id, turn, text, ['Ann', 'Bo', 'Cy'][(('0x' || substr(md5('5' || conv_id::VARCHAR), 1, 8))::BIGINT % 3 + 1)::INT] AS name FROM conversations)
        SELECT conv_id, turn, name, md5(name || ', ' || text) AS text_md5 FROM n""",
    "prompts": r"""WITH g AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN text END AS given, regexp_replace(CASE WHEN role = 'user' THEN text ELSE '' END, '^\s+|\s+$', '', 'g') AS s FROM conversations)
        SELECT conv_id, turn, md5('### Instruction:' || chr(10) || 'Answer.' || chr(10) || chr(10) || CASE WHEN s = '' THEN '' ELSE '### Input:' || chr(10) || s || chr(10) || chr(10) END || '### Response:' || chr(10)) AS instruction_md5,
          md5('### Instruction:' || chr(10) || 'Translate.' || chr(10) || chr(10) || '### Input:' || chr(10) || s || chr(10) || chr(10) || '### Output:' || chr(10)) AS translation_md5,
          CASE WHEN given <> '' AND text <> '' THEN 3 ELSE 0 END::BIGINT AS n_messages FROM g""",
    "memory_candidates": """SELECT event_id, event_type AS type, substr(user_id::VARCHAR, 1, 24) AS subject, substr(repeat(event_type, 30), 1, 120) AS key, event_id::VARCHAR AS value,
          round(greatest(0.0, least(1.0, (event_id % 30) / 10 - 1)), 6)::DOUBLE AS confidence, 0.0::DOUBLE AS future_impact FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0""",
    "first_objects": """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS n, CASE event_id % 3 WHEN 1 THEN '{"n": ' || event_id || '}' END AS fenced FROM events""",
    "judge_labels": """WITH s AS (SELECT event_id, ['It is Formal.', 'informal', '반말', '존댓말', 'unsure', 'PASS', 'fail, not pass', 'advance', 'stall', ' yes ', '1', '2.5', ''][(event_id % 13 + 1)::INT] AS said FROM events),
        l AS (SELECT *, CASE event_id % 13 WHEN 0 THEN 'formal' WHEN 1 THEN 'informal' WHEN 2 THEN 'informal' WHEN 3 THEN 'formal' ELSE 'unknown' END AS style FROM s)
        SELECT event_id, style, CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN style <> 'formal' ELSE style <> 'informal' END AS mismatch, upper(said) NOT LIKE '%PASS%' AS failed, upper(said) LIKE '%FAIL%' AS role_failed,
          said = 'stall' AS stalled, said IN (' yes ', '1') AS flag, coalesce(TRY_CAST(said AS DOUBLE), -1) AS number FROM l""",
}
