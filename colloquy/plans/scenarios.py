"""Queries over scenario texts made of conversations, similarities and hooks, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import scenario, vectors
from colloquy.operators import hooks, retrieval
from colloquy.plans import read

# Scenario texts by number of conversation; the words of the turn stand for @.
_WHOLE = (
    "0. 역할 선언\n당신은 이제 「유리」가 됩니다. @\n1. 장르: 연애물\n2. 상황\n3. 주인공 정의\n이름: 사야 (검사)\n성별: 여성\n4. 플레이어 정의\n이름: 소마\n5. 관계\n관계 상태: 거리감\n"
    "6. 발화와 분위기 규칙\n기본 말투: 반말\n7. 가장 최근 상호작용\n플레이어의 최근 턴: 가자\n주인공의 최근 턴: 나도 갈게. 할게\n" + "가나다라마바사아자차" * 20
)
BOOKS = (
    _WHOLE, _WHOLE.replace("5. 관계", "관계"), _WHOLE.replace("플레이어의 최근 턴", "최근 턴"), _WHOLE.replace("이름: 소마", "이름: 보리"), _WHOLE.replace("기본 말투: 반말", "기본 말투: 존댓말"),
    _WHOLE.replace("2. 상황", "2. 마이"), "**《@》**\n\n\n\n1. 간다",
)


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    shape = F.element_at(F.array(*[F.lit(b) for b in BOOKS]), ((F.col("conv_id") + F.col("turn")) % len(BOOKS) + 1).cast("int"))
    words = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")
    return turns.select("conv_id", "turn", F.replace(shape, F.lit("@"), words).alias("book"))


def scenario_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("book")
    return _books(spark, sf_dir).select(
        "conv_id", "turn", scenario.scenario_code(c).alias("code"), scenario.genre(c).alias("genre"), scenario.protagonist_name(c).alias("protagonist"), scenario.player_name(c).alias("player"),
        scenario.relation_status(c).alias("relation"), scenario.formal_speech(c).alias("formal"), scenario.protagonist_gender(c).alias("gender"), scenario.told_names(c)["player"].alias("told_player"),
    )


def scenario_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c: Column = F.col("book")
    return _books(spark, sf_dir).select(
        "conv_id", "turn", F.md5(scenario.cleaned(c)).alias("cleaned_md5"), F.length(scenario.until_section_7(c)).cast("long").alias("until_7"), F.md5(scenario.without_leftovers(c)).alias("kept_md5")
    )


def best_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all: odd labels by fused rankings of the other vectors, even ones by cosine alone."""
    items = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("item_vec"), "label")
    queries = items.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("item_vec").alias("query_vec"), F.col("label").alias("own"))
    odd = queries.filter("own % 2 = 1").select("query_id", "query_vec")
    first = items.groupBy("label").agg(F.min_by("item_vec", "item_id").alias("ref"))
    cosines = queries.join(first, queries["own"] == first["label"]).select("query_id", vectors.unit_cosine(F.col("query_vec"), F.col("ref")).alias("cosine"))
    found = retrieval.best_similarity(queries, retrieval.best_fused(odd, items), cosines)
    return found.select("query_id", F.round("similarity", 6).alias("similarity"), "kind", retrieval.idle_like(F.col("similarity"), F.lit(0.5)).alias("idle"))


def _reversed(texts: list[str]) -> list[str]:
    return [t[::-1] for t in texts]


def hooked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through a stand-in for a model that writes texts backwards."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    made = hooks.staged(turns, lambda df: df.withColumn("made", hooks.generated(F.col("text"), _reversed)), None, lambda df: df.withColumn("line", hooks.translated(line, _reversed)))
    return made.select("conv_id", "turn", F.md5("made").alias("made_md5"), F.md5("line").alias("line_md5"))


QUERIES = {f.__name__: f for f in (scenario_codes, scenario_cleaned, best_similarity, hooked_turns)}

_B = "[" + ", ".join("'" + b.replace("\n", "§") + "'" for b in BOOKS) + "]"
_T = rf"""t AS (SELECT conv_id, turn, ((conv_id + turn) % 7)::INT AS i, replace(replace({_B}[((conv_id + turn) % 7 + 1)::INT], '§', chr(10)), '@', regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS book FROM conversations)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"

ORACLE_SQL = {
    "scenario_codes": f"""WITH {_T} SELECT conv_id, turn, ['unknown', 'section_missing_5', 'missing_recent_user', 'player_count=0', 'speech_style_mismatch_sec6_sec7', 'protagonist_count=2',
          CASE WHEN length(regexp_replace(book, '^\\s+|\\s+$', '', 'g')) < 180 THEN 'too_short' ELSE 'section_missing_0' END][i + 1] AS code, CASE WHEN i < 6 THEN '연애물' ELSE '' END AS genre,
          CASE WHEN i < 6 THEN '유리' ELSE '주인공' END AS protagonist, CASE i WHEN 3 THEN '보리' WHEN 6 THEN '플레이어' ELSE '소마' END AS player, CASE WHEN i < 6 THEN '거리감' ELSE '' END AS relation,
          CASE WHEN i < 6 THEN i = 4 END AS formal, CASE WHEN i < 6 THEN 'female' END AS gender, CASE WHEN i = 3 THEN '보리' WHEN i < 6 THEN '소마' END AS told_player FROM t""",
    "scenario_cleaned": rf"""WITH {_T}, c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(book, '[*《》『』<>]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS clean FROM t)
        SELECT conv_id, turn, md5(regexp_replace(clean, '^\s+|\s+$', '', 'g')) AS cleaned_md5, length(regexp_replace(book, '^\s+|\s+$', '', 'g'))::BIGINT AS until_7,
          md5(array_to_string(list_filter(string_split(book, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '^\d+[.)]\s|^\*\*[^*]{{1,80}}\*\*$')), chr(10))) AS kept_md5 FROM c""",
    "best_similarity": f"""WITH e AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT item_id AS query_id, v AS qv, label AS own FROM e WHERE item_id % 100 = 0),
        d AS (SELECT query_id, item_id, round(sqrt(list_sum(list_transform(list_zip(v, qv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d, round({_DOT.format(a='v', b='qv')}, 9) AS c FROM e, q WHERE own % 2 = 1),
        r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS b FROM d),
        m AS (SELECT query_id, max(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b)) AS rrf FROM r WHERE item_id <> query_id GROUP BY 1), f AS (SELECT label, arg_min(v, item_id) AS f FROM e GROUP BY 1),
        s AS (SELECT query_id, coalesce(rrf, ({_DOT.format(a='qv', b='f')} / (sqrt({_DOT.format(a='qv', b='qv')}) * sqrt({_DOT.format(a='f', b='f')})) + 1) / 2) AS s, CASE WHEN rrf IS NULL THEN 'cosine' ELSE 'rrf' END AS kind
          FROM q JOIN f ON own = label LEFT JOIN m USING (query_id)) SELECT query_id, round(s, 6) AS similarity, kind, s + 0.005 <= 0.5 AS idle FROM s""",
    "hooked_turns": r"""SELECT conv_id, turn, md5(reverse(text)) AS made_md5, md5(reverse(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS line_md5 FROM conversations""",
}
