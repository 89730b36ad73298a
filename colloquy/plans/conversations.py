"""Queries over ``conversations`` and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import scores, text
from colloquy.functions.similarity import echo_ratio
from colloquy.functions.vectors import jaccard
from colloquy.operators import conversations as ops
from colloquy.operators import sampling
from colloquy.plans import read


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def prompt_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.prompt_samples(_turns(spark, sf_dir))
    return found.select("conv_id", "turn", "n_context", F.md5("prompt").alias("prompt_md5"), F.md5("reference").alias("reference_md5"))


def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return ops.sample_ids(ops.prompt_samples(turns, min_reference=200), turns, "conversations").select("conv_id", "turn", "id")


def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(ops.prompt_samples(_turns(spark, sf_dir)).select("conv_id", "turn"), "conv_id", "turn", ratio=0.05, seed="42")


def turn_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, and before every fifth of them a draft of the same role, which makes a run that the turn itself ends."""
    turns = _turns(spark, sf_dir)
    draft = turns.filter("turn % 5 = 3").withColumns({"turn": F.col("turn") * 2, "text": F.concat(F.lit("draft: "), F.col("text"))})
    found = ops.collapse_runs(turns.withColumn("turn", F.col("turn") * 2 + 1).unionByName(draft))
    return found.select("conv_id", "pos", F.floor(F.col("turn") / 2).alias("turn"), "role", F.md5("text").alias("text_md5"))


def budget_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trim_to_budget(_turns(spark, sf_dir), budget=400).select("conv_id", "turn", "role", "tokens")


def recent_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recent_digest(_turns(spark, sf_dir), pairs=2).select("conv_id", F.md5("digest").alias("digest_md5"))


def partner_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.partner_context(_turns(spark, sf_dir)).select("conv_id", "turn", F.md5("partner").alias("partner_md5"))


def last_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_by_role(_turns(spark, sf_dir)).select("conv_id", "role", F.md5("text").alias("text_md5"))


def hist_window6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.history(_turns(spark, sf_dir), size=6)
    return found.select("conv_id", "turn", F.size("history").cast("long").alias("n_history"), F.md5(F.array_join("history", "|")).alias("history_md5"))


def role_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    other = F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, "Human").otherwise("user")).when(F.col("role") == "assistant", F.when(F.col("turn") % 4 == 1, " gpt ").otherwise("bot"))
    named = turns.withColumn("role", F.coalesce(other, F.when(F.col("conv_id") % 3 == 0, "narrator").otherwise("system")))
    known = named.withColumn("role", ops.normal_role(F.col("role"))).filter(F.col("role").isNotNull())
    nested = ops.nest(known)
    return nested.select("conv_id", F.size("messages").cast("long").alias("n_messages"), ops.validate(F.col("messages")).alias("trainable"), F.md5(ops.flat_prompt(F.col("messages"))).alias("prompt_md5"))


def messages_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unnest(ops.nest(_turns(spark, sf_dir))).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def until_last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.until_last_user(_turns(spark, sf_dir)).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


def jaccard_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _turns(spark, sf_dir).select("conv_id", "turn", text.token_set(F.col("text")).alias("words"))
    before = F.lag("words").over(ops.by_turn())
    return words.withColumn("before", before).filter("before IS NOT NULL").select("conv_id", "turn", F.round(jaccard(F.col("words"), F.col("before")), 9).alias("jaccard"))


def echo_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character ratio and word overlap with the turn before: rows only, as SQL has no such ratio."""
    pairs = _turns(spark, sf_dir).withColumn("before", F.lag("text").over(ops.by_turn())).filter("before IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(echo_ratio(F.col("text"), F.col("before")), 9).alias("echo"))


def signature_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    signed = turns.select("conv_id", "turn", text.intent(F.col("text")).alias("intent"), text.signature(F.col("text")).alias("signature"))
    repeated = F.count("*").over(W.partitionBy("conv_id", "intent", "signature").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)) > 0
    return signed.select("conv_id", "turn", "intent", "signature", repeated.alias("repeated"))


def completions(turns: DataFrame) -> DataFrame:
    """Assistant turns as completions: the first sentence as narration and the rest in quotes; every fourth with text
    behind the quote, every seventh with a role mark."""
    at = F.regexp_instr("text", F.lit("[.]"))
    head, rest = F.substring("text", F.lit(1), at), F.regexp_replace(F.substring(F.col("text"), at + 1, F.length("text")), r"\s+", " ")
    body = F.concat(head, F.lit('\n"'), F.trim(rest), F.lit('"'))
    marked = F.when(F.col("conv_id") % 4 == 0, F.concat(body, F.lit(" tail"))).when(F.col("conv_id") % 7 == 0, F.concat(body, F.lit("\nUser: x"))).otherwise(body)
    return turns.filter("role = 'assistant' AND instr(text, '.') > 0").select("conv_id", "turn", marked.alias("completion"))


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = completions(_turns(spark, sf_dir))
    parts = {name: score(F.col("completion")) for name, score in scores.REWARDS.items()}
    weights = {k: scores.WEIGHTS[k] for k in parts}
    return found.select(
        "conv_id", "turn", text.rough_tokens(F.col("completion")).cast("long").alias("n_tokens"), *[F.round(c, 6).alias(k) for k, c in parts.items()],
        F.round(scores.total(parts, weights), 6).alias("total"),
    )


def quote_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    narration, dialogue = text.split_turn(F.col("completion"))
    return completions(_turns(spark, sf_dir)).select("conv_id", "turn", F.md5(narration).alias("narration_md5"), F.md5(dialogue).alias("dialogue_md5"))


def stall_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.streak(_turns(spark, sf_dir), F.length("text") < 400).select("conv_id", "turn", "streak")


def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words' lengths stand for token ids; the answer begins at the first assistant turn."""
    turns = _turns(spark, sf_dir)
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    parts = turns.groupBy("conv_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", ids.alias("ids")))), lambda x: x["ids"])).alias("ids"),
        F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("first"),
    )
    before = turns.join(parts.select("conv_id", "first"), "conv_id").filter("turn < first").groupBy("conv_id").agg(F.sum(F.size(ids)).alias("answer_from"))
    masked = parts.join(before, "conv_id", "left").withColumn("labels", ops.label_mask(F.col("ids"), F.coalesce("answer_from", F.lit(0)).cast("int")))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda s, x: s + x)
    return masked.select("conv_id", F.size("labels").cast("long").alias("n_labels"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("n_masked"), total.alias("label_sum"))


QUERIES = {
    f.__name__: f
    for f in (
        prompt_samples, sample_ids, seeded_split, turn_collapse, budget_trim, recent_digest, partner_context, last_by_role, hist_window6, role_alias, messages_roundtrip,
        until_last_user, jaccard_prev, echo_prev, signature_repeat, rewards, quote_split, stall_streak, label_mask,
    )
}

_SAMPLES = """
messages AS (SELECT conv_id, turn, lower(trim(role)) AS role, text FROM conversations WHERE lower(trim(role)) IN ('system', 'user', 'assistant') AND trim(text, ' ' || chr(10) || chr(9)) <> ''),
framed AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before,
  max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had_user,
  count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n_context,
  string_agg(upper(role) || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS prompt
  FROM messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
samples AS (SELECT conv_id, turn, n_context, prompt, trim(text, ' ' || chr(10) || chr(9)) AS reference FROM framed WHERE role = 'assistant' AND had_user = 1 AND before = 'user')"""
_COLLAPSED = """
dialogue AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {src} WHERE role IN ('user', 'assistant')),
lasts AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM dialogue WHERE next_role IS NULL OR next_role <> role),
kept AS (SELECT conv_id, turn, role, text FROM lasts WHERE NOT (prev IS NULL AND role = 'assistant') AND NOT (nxt IS NULL AND role = 'user')),
collapsed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM kept)"""
_COMPLETIONS = r"""
parts AS (SELECT conv_id, turn, substr(text, 1, instr(text, '.')) AS head, trim(regexp_replace(substr(text, instr(text, '.') + 1), '\s+', ' ', 'g')) AS rest
  FROM conversations WHERE role = 'assistant' AND instr(text, '.') > 0),
bodies AS (SELECT conv_id, turn, head || chr(10) || '"' || rest || '"' AS body FROM parts),
completions AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN body || ' tail' WHEN conv_id % 7 = 0 THEN body || chr(10) || 'User: x' ELSE body END AS completion FROM bodies)"""
_LINES = r"list_filter(list_transform(str_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

ORACLE_SQL = {
    "prompt_samples": f"WITH {_SAMPLES} SELECT conv_id, turn, n_context, md5(prompt) AS prompt_md5, md5(reference) AS reference_md5 FROM samples",
    "sample_ids": f"""WITH {_SAMPLES}, offsets AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o FROM conversations)
        SELECT conv_id, turn, 'conversations:' || conv_id || ':' || o || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id
        FROM samples JOIN offsets USING (conv_id, turn) WHERE length(reference) >= 200""",
    "seeded_split": f"""WITH {_SAMPLES}, n AS (SELECT count(*) AS n FROM samples),
        ranked AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42|' || conv_id || '|' || turn), conv_id, turn) AS r FROM samples)
        SELECT conv_id, turn, CASE WHEN r <= greatest(floor(n * 0.05), CASE WHEN n > 1 THEN 1 ELSE 0 END) THEN 'eval' ELSE 'train' END AS part FROM ranked, n""",
    "turn_collapse": f"WITH src AS (SELECT * FROM conversations), {_COLLAPSED.format(src='src')} SELECT conv_id, pos, turn, role, md5(text) AS text_md5 FROM collapsed",
    "budget_trim": f"""WITH {_COLLAPSED.format(src='conversations')},
        counted AS (SELECT *, len(regexp_extract_all(text, '[가-힣A-Za-z0-9]+|[^\\s]')) AS tokens, (pos + 1) // 2 AS pair FROM collapsed),
        fixed AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[가-힣A-Za-z0-9]+|[^\\s]')) AS tokens FROM conversations WHERE role = 'system'),
        sums AS (SELECT conv_id, sum(tokens) AS fixed FROM fixed GROUP BY 1),
        tails AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pair DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail FROM counted),
        chosen AS (SELECT conv_id, turn, role, tokens FROM tails LEFT JOIN sums USING (conv_id) WHERE tail + coalesce(fixed, 0) <= 400)
        SELECT * FROM chosen UNION ALL SELECT conv_id, turn, role, tokens FROM fixed WHERE conv_id IN (SELECT conv_id FROM chosen)""",
    "recent_digest": """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
        SELECT conv_id, md5(string_agg('- (' || turn || ') ' || CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END || ': ' || substr(text, 1, 220), chr(10) ORDER BY turn)) AS digest_md5
        FROM ranked WHERE n <= 4 GROUP BY 1""",
    "partner_context": """SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w
        WHEN role = 'assistant' THEN last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w END) AS partner_md5
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "last_by_role": "SELECT conv_id, role, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY 1, 2",
    "hist_window6": """SELECT conv_id, turn, count(*) OVER w AS n_history, md5(coalesce(string_agg(text, '|') OVER w, '')) AS history_md5
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    "role_alias": """WITH named AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' WHEN conv_id % 3 = 0 THEN NULL ELSE 'system' END AS role FROM conversations)
        SELECT conv_id, count(*) AS n_messages, bool_and(trim(text) <> '') AND bool_or(role = 'assistant') AS trainable, md5(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn)) AS prompt_md5
        FROM named WHERE role IS NOT NULL GROUP BY 1""",
    "messages_roundtrip": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(text) AS text_md5 FROM conversations",
    "until_last_user": """WITH l AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations)
        SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM l WHERE turn <= last GROUP BY 1""",
    "jaccard_prev": """WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9_]{2,}')) AS w FROM conversations),
        p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
        SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(w, b))) > 0 THEN len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) ELSE 0 END, 9) AS jaccard FROM p WHERE b IS NOT NULL""",
    "signature_repeat": r"""WITH s AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN '' WHEN contains(text, '?') THEN 'question'
        WHEN regexp_matches(lower(text), '(^|[^a-z])(decide|decided|will|must)([^a-z]|$)') THEN 'decision' WHEN regexp_matches(lower(text), '(^|[^a-z])(please|let)([^a-z]|$)') THEN 'request' ELSE 'statement' END AS intent,
        substr(regexp_replace(lower(text), '[\s.,!?"''…:;()-]+', '', 'g'), 1, 40) AS signature FROM conversations)
        SELECT conv_id, turn, intent, signature, count(*) OVER (PARTITION BY conv_id, intent, signature ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS repeated FROM s""",
    "rewards": rf"""WITH {_COMPLETIONS}, l AS (SELECT conv_id, turn, completion, {_LINES.format(c='completion')} AS ls, len(regexp_extract_all(completion, '[가-힣A-Za-z0-9]+|[^\s]')) AS n FROM completions),
        f AS (SELECT *, upper(completion) AS up, len(list_filter(ls[2:], lambda x: regexp_full_match(x, '"[^"\n]{{2,300}}"'))) > 0 AS quote,
          regexp_replace(ls[2], '^.*?"[^"\n]{{2,300}}"', '') AS tail, regexp_matches(ls[2], '"[^"\n]{{2,300}}"') AS spoken FROM l),
        g AS (SELECT *, (CASE WHEN contains(up, 'SYSTEM:') THEN 1 ELSE 0 END + CASE WHEN contains(up, 'USER:') THEN 1 ELSE 0 END + CASE WHEN contains(up, 'ASSISTANT:') THEN 1 ELSE 0 END) AS marks FROM f),
        p AS (SELECT conv_id, turn, n AS n_tokens,
          greatest(0, least(1, 0.30 * (CASE WHEN ls[1] NOT LIKE '"%' AND NOT contains(upper(ls[1]), 'USER:') AND NOT contains(upper(ls[1]), 'ASSISTANT:') THEN 1 ELSE 0 END) + 0.40 * quote::INT
            + 0.30 * (quote AND len(ls) = 2 AND marks = 0)::INT - 0.60 * (spoken AND trim(tail) <> '')::INT)) AS format,
          greatest(0, least(1, (CASE WHEN n BETWEEN 40 AND 140 THEN 1.0 WHEN n BETWEEN 20 AND 200 THEN 0.7 WHEN n BETWEEN 201 AND 240 THEN 0.35 ELSE 0.1 END) - 0.40 * (marks > 0)::INT)) AS length,
          greatest(0, 1 - 0.45 * marks) AS role_split FROM g)
        SELECT conv_id, turn, n_tokens, round(format::DOUBLE, 6) AS format, round(length::DOUBLE, 6) AS length, round(role_split::DOUBLE, 6) AS role_split,
          round((0.34 * format + 0.26 * length + 0.26 * role_split)::DOUBLE, 6) AS total FROM p""",
    "quote_split": rf"""WITH {_COMPLETIONS}, q AS (SELECT conv_id, turn, trim(completion) AS c, regexp_extract(completion, '"([^"\n]{{1,600}})"', 1) AS span FROM completions),
        b AS (SELECT *, CASE WHEN span <> '' THEN {_LINES.format(c="substr(c, 1, instr(c, '\"' || span || '\"') - 1)")} END AS before FROM q)
        SELECT conv_id, turn, md5(CASE WHEN span <> '' AND len(before) > 0 THEN before[-1] ELSE '' END) AS narration_md5, md5(CASE WHEN span <> '' THEN trim(span) ELSE c END) AS dialogue_md5 FROM b""",
    "stall_streak": """WITH f AS (SELECT *, (length(text) < 400)::INT AS flag FROM conversations),
        i AS (SELECT *, sum(1 - flag) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
        SELECT conv_id, turn, sum(flag) OVER (PARTITION BY conv_id, island ORDER BY turn) AS streak FROM i""",
    "label_mask": """WITH l AS (SELECT conv_id, turn, list_transform(str_split(text, ' '), lambda x: length(x)) AS ids, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM conversations)
        SELECT conv_id, sum(len(ids)) AS n_labels, coalesce(sum(CASE WHEN turn < first THEN len(ids) END), 0) AS n_masked,
        sum(CASE WHEN turn < first THEN -100 * len(ids) ELSE list_sum(ids) END) AS label_sum FROM l GROUP BY 1""",
}
