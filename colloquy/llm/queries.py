"""The registered queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.fingerprints import edited_neighbours
from colloquy.llm.html_text import main_text
from colloquy.llm.line_dedup import drop_boilerplate
from colloquy.llm.media import text_media
from colloquy.llm.mixing import mix, word_count
from colloquy.llm.ngram_join import similarity_components
from colloquy.llm.packing import pack, tokenize_pieces
from colloquy.llm.secret_scan import BASE_RULES, scan_secrets
from colloquy.llm.tool_calls import link_tool_calls, tool_items
from colloquy.llm.toxicity import is_held_out, learn, score


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary that the packing query is defined on."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_read(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize_pieces(_read(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path()))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_read(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


#: A score from here on counts as toxic.
TOXIC_FROM = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, _read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


#: Tools that the conversations are read as calls of: each field's type and whether it is required.
TOOL_SCHEMAS = {
    "ask": {"text": ("string", True), "turn": ("integer", True), "urgent": ("boolean", False)},
    "note": {"text": ("string", True)},
}


def conversation_calls(turns: DataFrame) -> DataFrame:
    """Conversations as messages with tool calls: a user's turn is a call that the next turn, if an assistant's, answers.

    Calls at turns 1 of 4 are notes with a field too many, at turns 2 of 4 their turn is a string, at turns 3 of 4 the
    tool has no schema; calls at turns 2 of 8 wait for the one two turns later. System turns stay messages."""
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    at = F.pmod("turn", F.lit(4))
    name = F.when(at == 3, "guess").when(at == 1, "note").otherwise("ask")
    body = F.concat(F.lit('{"turn":'), F.when(at == 2, F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))).otherwise(F.col("turn").cast("string")), F.lit(', "text":'), F.col("quoted"), F.lit("}"))
    after = F.when(F.pmod("turn", F.lit(8)) == 2, F.concat(F.lit(', "after": ["'), call_id(F.col("turn") + 2), F.lit('"]'))).otherwise(F.lit(""))
    call = F.concat(F.lit('{"tool_calls": [{"name":"'), name, F.lit('","id":"'), call_id(F.col("turn")), F.lit('"'), after, F.lit(', "arguments":'), body, F.lit("}]}"))
    answer = F.concat(F.lit('{"tool_call_id":"'), call_id(F.col("turn") - 1), F.lit('", "content":'), F.col("quoted"), F.lit("}"))
    quoted = F.expr("""left(substring(to_json(struct(coalesce(text, '') AS t)), 6), length(to_json(struct(coalesce(text, '') AS t))) - 6)""")
    return turns.withColumn("quoted", quoted).select(
        "conv_id", "turn", F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", answer).otherwise(F.col("text")).alias("text"),
    )


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tool_items(conversation_calls(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), TOOL_SCHEMAS)
    return link_tool_calls(items).select(
        "conv_id", "turn", "kind", "id", F.coalesce("linked", F.lit(False)).alias("linked"), F.array_join("errors", "; ").alias("errors"), F.col("after_turn").alias("after_turn"), "depth", "json"
    )


#: Quality weights of the mix: labelled good, labelled bad, not labelled.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.5


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    quality = _read(spark, sf_dir, "labels").filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("quality").alias("_quality"))
    sized = sizes.join(quality, F.col("doc_id") == F.col("_id"), "left")
    weight = F.coalesce(F.lit(BAD) + (GOOD - BAD) * F.col("_quality"), F.lit(UNKNOWN))
    return mix(sized, size=F.col("words"), weight=weight).select("doc_id", "size", "source_size", "target", "taken")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(_read(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(_read(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_main_text": op2_main_text,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_tool_calls": op7_tool_calls,
    "op8_mixing": op8_mixing,
    "op9_fingerprint": op9_fingerprint,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

_SIZES = r"""z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS total, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM z GROUP BY 1),
r AS (SELECT *, 3.0::DOUBLE * total AS most, 3.0::DOUBLE * total / w AS ratio FROM s),
lv AS (SELECT ratio, (sum(total) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (SELECT source, total, least(w * (SELECT arg_min(level, ratio) FROM lv WHERE level <= ratio), most) AS target FROM r),
e AS (SELECT *, CASE WHEN total > 0 THEN CAST(least(floor(target / total), 3) AS BIGINT) ELSE 0 END AS epochs FROM t),
q AS (SELECT doc_id AS id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
k AS (SELECT z.doc_id, z.source, z.size, -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / coalesce(0.25 + 0.75 * quality, 0.5) AS key FROM z LEFT JOIN q ON doc_id = id),
u AS (SELECT k.*, total, target, epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)"""

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": """WITH d AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL), n AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
        l AS (SELECT source, unnest(list_distinct(list_filter(str_split(text, chr(10)), lambda x: trim(x) <> ''))) AS line FROM d),
        b AS (SELECT l.source, line FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) > max(n) * 0.05),
        g AS (SELECT source, list(line) AS gone FROM b GROUP BY 1),
        x AS (SELECT doc_id, text, str_split(text, chr(10)) AS ls, list_filter(str_split(text, chr(10)), lambda z: trim(z) = '' OR NOT list_contains(coalesce(gone, []), z)) AS c
          FROM documents LEFT JOIN g ON documents.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, array_to_string(c, chr(10)) AS text, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(c), 0) AS n_dropped FROM x""",
    "op7_tool_calls": """WITH c AS (SELECT conv_id, turn, role, to_json(coalesce(text, ''))::VARCHAR AS quoted, 'call-' || conv_id || '-' AS stem FROM conversations),
        u AS (SELECT c.*, EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant') AS answered FROM c WHERE role = 'user'),
        w AS (SELECT u.*, v.turn AS on_turn, v.answered AS on_answered FROM u LEFT JOIN u v ON v.conv_id = u.conv_id AND u.turn % 8 = 2 AND v.turn = u.turn + 2),
        p AS (SELECT *, CASE WHEN on_turn IS NULL THEN turn WHEN on_answered THEN on_turn + 1 ELSE on_turn END AS after_turn, CASE WHEN on_turn IS NULL THEN 0 WHEN on_answered THEN 1 ELSE 2 END AS depth FROM w),
        calls AS (SELECT conv_id, turn, 'call' AS kind, stem || turn AS id, answered AS linked,
          CASE turn % 4 WHEN 3 THEN 'unknown tool' WHEN 1 THEN 'unknown turn' WHEN 2 THEN 'turn is not integer' ELSE '' END AS errors, after_turn, depth,
          '{' || CASE WHEN turn % 8 = 2 THEN '"after":["' || stem || (turn + 2) || '"],' ELSE '' END || '"arguments":{"text":' || quoted || ',"turn":' || CASE WHEN turn % 4 = 2 THEN '"' || turn || '"' ELSE turn::VARCHAR END
          || '},"id":"' || stem || turn || '","name":"' || CASE turn % 4 WHEN 3 THEN 'guess' WHEN 1 THEN 'note' ELSE 'ask' END || '"}' AS json FROM p),
        results AS (SELECT c.conv_id, c.turn, 'result' AS kind, c.stem || (c.turn - 1) AS id, p.turn IS NOT NULL AS linked, '' AS errors, greatest(c.turn, p.after_turn) AS after_turn,
          CASE WHEN p.turn IS NULL THEN 0 WHEN c.turn > p.after_turn THEN 0 ELSE p.depth + 1 END AS depth, '{"content":' || c.quoted || ',"tool_call_id":"' || c.stem || (c.turn - 1) || '"}' AS json
          FROM c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.role = 'assistant')
        SELECT * FROM calls UNION ALL SELECT * FROM results UNION ALL
        SELECT conv_id, turn, 'message', NULL, false, '', turn, 0, '{"content":' || quoted || ',"role":' || to_json(coalesce(role, ''))::VARCHAR || '}' FROM c WHERE role IS NULL OR role NOT IN ('user', 'assistant')""",
    "op8_mixing": f"""WITH {_SIZES} SELECT doc_id, size, total AS source_size, target, (epochs + CASE WHEN 2 * upto - sum(size) OVER (PARTITION BY source, key) <= 2 * (target - epochs * total) AND upto > 0 AND epochs < 3
        AND target - epochs * total > 0 THEN 1 ELSE 0 END) * size AS taken FROM u""",
}
