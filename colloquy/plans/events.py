"""Queries over ``events`` as memory candidates and signals, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import scores
from colloquy.operators import fsm, memory
from colloquy.plans import read

#: Event types as kinds of candidates.
KINDS = ("promise", "boundary", "fact", "relationship", "plan", "preference", "emotion", "other")
RULES = (
    fsm.Rule("calm", "alert", {"threat": ">=2"}),
    fsm.Rule("calm", "warm", {"closeness": ">=2", "threat": "<1"}),
    fsm.Rule("alert", "calm", {"threat": "==0"}),
    fsm.Rule("warm", "alert", {"threat": ">1"}),
    fsm.Rule("warm", "calm", {"closeness": "<=0"}),
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("event_id", F.lit(len(KINDS))) + 1).cast("int"))
    part = lambda n: F.pmod(F.floor(F.col("value") * n), F.lit(11)) / 10
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.floor(F.col("value") / 20).cast("string").alias("value"),
        part(1).alias("confidence"), part(3).alias("impact"), part(7).alias("emotion"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), F.pmod(F.floor("value"), F.lit(4)).cast("int").alias("threat"), F.pmod(F.floor(F.col("value") * 3), F.lit(4)).cast("int").alias("closeness"))


def mem_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as if every candidate were new: the part without the fold."""
    c = memory.with_recurrence(candidates(spark, sf_dir))
    score = scores.candidate_score(importance=scores.importance(F.col("kind")), confidence=F.col("confidence"), impact=F.col("impact"), emotion=F.col("emotion"), recurrence=F.col("recurrence"), novelty=F.lit(1.0))
    return c.select("session_id", "key", "seq", "earlier", F.round("recurrence", 6).alias("recurrence"), F.round(score, 6).alias("score"), (F.round(score, 9) >= scores.PROMOTE_FROM).alias("promoted"))


def mem_promote_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.promote(candidates(spark, sf_dir), threshold=scores.PROMOTE_FROM - 1e-9).select("session_id", "key", "seq", "novelty", F.round("score", 6).alias("score"), "promoted")


def mem_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    promoted = memory.promote(candidates(spark, sf_dir), threshold=scores.PROMOTE_FROM - 1e-9).filter("promoted")
    return memory.latest(promoted).select("session_id", "key", "seq", "value", F.round("score", 6).alias("score"))


def mem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"), (F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def fsm_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fsm.replay(signals(spark, sf_dir), RULES, initial="calm", signals=("threat", "closeness"))
    return found.select("session", "turn", "state", "moved")


def fsm_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    return s.select("session", "turn", fsm.status(F.col("threat"), F.col("closeness")).alias("status"))


def signal_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm.limited_signal(signals(spark, sf_dir), "threat", low=0, high=2)


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost object of a text around the props: how many fields it has, 0 if it is broken, and its length."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    said = F.concat(F.lit("here: "), F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(F.coalesce("props", F.lit("none"))), F.lit(" done"))
    found = F.regexp_extract(said, r"\{[\s\S]*\}", 0)
    parsed = F.from_json(F.when(found != "", found), "map<string, string>", {"mode": "PERMISSIVE"})
    return e.select("event_id", F.when(found != "", F.coalesce(F.size(F.map_keys(parsed)), F.lit(0))).cast("long").alias("n_fields"), F.length(found).cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (mem_score, mem_promote_fold, mem_upsert, mem_counts, fsm_replay, fsm_status, signal_limit, json_extract)}

_IMPORTANCE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.IMPORTANCE.items()) + f" ELSE {scores.OTHER_IMPORTANCE} END"
_CAND = f"""
c AS (SELECT user_id AS session_id, event_type AS key, event_id AS seq, [{', '.join(f"'{k}'" for k in KINDS)}][event_id % {len(KINDS)} + 1] AS kind, CAST(floor(value / 20) AS BIGINT)::VARCHAR AS value,
  (floor(value)::BIGINT % 11) / 10 AS confidence, (floor(value * 3)::BIGINT % 11) / 10 AS impact, (floor(value * 7)::BIGINT % 11) / 10 AS emotion FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY seq) - 1 AS earlier FROM c),
b AS (SELECT *, least(1.0::DOUBLE, earlier / 3) AS recurrence, (0.30 * {_IMPORTANCE} + 0.20 * confidence + 0.20 * impact + 0.15 * emotion + 0.10 * least(1.0::DOUBLE, earlier / 3))::DOUBLE AS base FROM r)"""
_FOLD = f"""{_CAND},
fold AS (SELECT session_id, key, seq, earlier, value, 1.0::DOUBLE AS novelty, base + 0.05 AS score, CASE WHEN base + 0.05 >= 0.65 - 1e-9 THEN value END AS held FROM b WHERE earlier = 0
  UNION ALL SELECT b.session_id, b.key, b.seq, b.earlier, b.value, CASE WHEN f.held IS NULL THEN 1.0 WHEN f.held = b.value THEN 0.0 ELSE 0.4 END,
  b.base + 0.05 * CASE WHEN f.held IS NULL THEN 1.0 WHEN f.held = b.value THEN 0.0 ELSE 0.4 END,
  CASE WHEN b.base + 0.05 * CASE WHEN f.held IS NULL THEN 1.0 WHEN f.held = b.value THEN 0.0 ELSE 0.4 END >= 0.65 - 1e-9 THEN b.value ELSE f.held END
  FROM fold f JOIN b ON b.session_id = f.session_id AND b.key = f.key AND b.earlier = f.earlier + 1)"""
_SIG = "s AS (SELECT user_id AS session, event_id AS turn, floor(value)::BIGINT % 4 AS threat, floor(value * 3)::BIGINT % 4 AS closeness, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
_STEP = "CASE {st} WHEN 'calm' THEN CASE WHEN threat >= 2 THEN 'alert' WHEN closeness >= 2 AND threat < 1 THEN 'warm' ELSE 'calm' END WHEN 'alert' THEN CASE WHEN threat = 0 THEN 'calm' ELSE 'alert' END ELSE CASE WHEN threat > 1 THEN 'alert' WHEN closeness <= 0 THEN 'calm' ELSE 'warm' END END"

ORACLE_SQL = {
    "mem_score": f"WITH {_CAND} SELECT session_id, key, seq, earlier, round(recurrence, 6) AS recurrence, round(least(1.0, base + 0.05), 6) AS score, round(least(1.0, base + 0.05), 9) >= 0.65 AS promoted FROM b",
    "mem_promote_fold": f"WITH RECURSIVE {_FOLD} SELECT session_id, key, seq, novelty::DOUBLE AS novelty, round(score, 6) AS score, score >= 0.65 - 1e-9 AS promoted FROM fold",
    "mem_upsert": f"""WITH RECURSIVE {_FOLD}, p AS (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY seq DESC) AS n FROM fold WHERE score >= 0.65 - 1e-9)
        SELECT session_id, key, seq, value, round(score, 6) AS score FROM p WHERE n = 1""",
    "mem_counts": "SELECT user_id AS session_id, count(*) AS n, count(DISTINCT event_type) AS n_keys, coalesce(max(event_id), 0) + 1 AS next_seq FROM events GROUP BY 1",
    "fsm_replay": f"""WITH RECURSIVE {_SIG}, f AS (SELECT session, turn, n, {_STEP.format(st="'calm'")} AS state, {_STEP.format(st="'calm'")} <> 'calm' AS moved FROM s WHERE n = 1
        UNION ALL SELECT s.session, s.turn, s.n, {_STEP.format(st='f.state')}, {_STEP.format(st='f.state')} <> f.state FROM f JOIN s ON s.session = f.session AND s.n = f.n + 1) SELECT session, turn, state, moved FROM f""",
    "fsm_status": f"WITH {_SIG} SELECT session, turn, CASE WHEN threat >= 2 AND closeness <= 1 THEN 'hostile' WHEN closeness >= 3 THEN 'devoted' WHEN closeness = 2 THEN 'close' ELSE 'distant' END AS status FROM s",
    "signal_limit": f"""WITH RECURSIVE {_SIG}, f AS (SELECT session, turn, n, greatest(0, least(2, greatest(-1, least(1, greatest(0, least(2, threat)))))) AS value FROM s WHERE n = 1
        UNION ALL SELECT s.session, s.turn, s.n, greatest(0, least(2, greatest(f.value - 1, least(f.value + 1, greatest(0, least(2, threat)))))) FROM f JOIN s ON s.session = f.session AND s.n = f.n + 1) SELECT session, turn, value FROM f""",
    "json_extract": r"""WITH t AS (SELECT event_id, 'here: ' || CASE WHEN event_id % 13 = 0 THEN '{broken' ELSE coalesce(props, 'none') END || ' done' AS said FROM events),
        f AS (SELECT event_id, regexp_extract(said, '\{[\s\S]*\}') AS found FROM t) SELECT event_id, CASE WHEN found <> '' THEN len(json_keys(found)) END AS n_fields, length(found) AS n_chars FROM f""",
}
