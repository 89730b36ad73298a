"""The session memory: candidates are scored in order, promoted from a threshold on, and promoted ones are the slots.

A candidate's novelty depends on the value last promoted for its key, and promotion on the score, so scoring is a fold
over each key's candidates in order; everything else is a window or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import scores

KEY = ("session_id", "key")
FEATURES = ("confidence", "impact", "emotion")


def with_recurrence(candidates: DataFrame) -> DataFrame:
    """``earlier`` and ``recurrence``: how many candidates of the key came before, whatever became of them."""
    before = W.partitionBy(*KEY).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    earlier = candidates.withColumn("earlier", F.count("*").over(before))
    return earlier.withColumn("recurrence", scores.recurrence(F.col("earlier")))


def novelty(promoted: Column, value: Column) -> Column:
    return F.when(promoted.isNull(), scores.NOVEL_NEW).when(promoted == value, scores.NOVEL_SAME).otherwise(scores.NOVEL_CHANGED)


def promote(candidates: DataFrame, *, threshold: float = scores.PROMOTE_FROM) -> DataFrame:
    """(session_id, key, seq, value, novelty, score, promoted) of candidates (session_id, key, seq, kind, value,
    confidence, impact, emotion): the fold over each key in the order of ``seq``. A key's candidates are one task's
    work; keys are small parts of sessions."""
    ready = with_recurrence(candidates).withColumn("importance", scores.importance(F.col("kind")))
    item = F.struct("seq", "value", "importance", *FEATURES, "recurrence")
    grouped = ready.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<seq: bigint, value: string, novelty: double, score: double, promoted: boolean>>"
    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast(kind).alias("out"))

    def step(state: Column, c: Column) -> Column:
        new = novelty(state["held"], c["value"])
        score = scores.candidate_score(importance=c["importance"], confidence=c["confidence"], impact=c["impact"], emotion=c["emotion"], recurrence=c["recurrence"], novelty=new)
        promoted = score >= threshold
        row = F.struct(c["seq"].alias("seq"), c["value"].alias("value"), new.alias("novelty"), score.alias("score"), promoted.alias("promoted"))
        return F.struct(F.when(promoted, c["value"]).otherwise(state["held"]).alias("held"), F.concat(state["out"], F.array(row)).alias("out"))

    return grouped.select(*KEY, F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("c")).select(*KEY, "c.*")


def latest(rows: DataFrame, *, keys: tuple[str, ...] = KEY, order: str = "seq") -> DataFrame:
    """The last row of each key: an upsert of all rows in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")


def context_text(slots: DataFrame, digest: DataFrame, *, limit: int = 8, chars: int = 700, titles: tuple[str, str] = ("Slots:", "Recent turns:")) -> DataFrame:
    """(session_id, context): a header and a line for each of a session's best slots, then its digest, cut to ``chars``
    without white space at the end. Slots need (kind, key, value, score, seq)."""
    best = slots.withColumn("_n", F.row_number().over(W.partitionBy("session_id").orderBy(F.col("score").desc(), F.col("seq").desc()))).filter(F.col("_n") <= limit)
    line = F.format_string("- [%s] %s = %s (score=%.2f, turn=%d)", "kind", "key", "value", "score", "seq")
    listed = best.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    both = listed.join(digest, "session_id", "full_outer")
    parts = F.concat_ws("\n\n", F.concat(F.lit(titles[0] + "\n"), F.col("lines")), F.concat(F.lit(titles[1] + "\n"), F.col("digest")))
    return both.select("session_id", F.regexp_replace(F.substring(parts, 1, chars), r"\s+\z", "").alias("context"))


def merge_dictionaries(existing: DataFrame, incoming: DataFrame, *, key: str, value: str, incoming_wins: bool = True) -> DataFrame:
    """One row for each key of either side; on a conflict the side that wins has its value."""
    a, b = existing.select(key, F.col(value).alias("_a")), incoming.select(key, F.col(value).alias("_b"))
    first, second = ("_b", "_a") if incoming_wins else ("_a", "_b")
    return a.join(b, key, "full_outer").select(key, F.coalesce(first, second).alias(value))
