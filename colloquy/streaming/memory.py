"""The session memory as a stream: the same scoring and promotion as the batch fold, one session's state at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.functions import scores

OUTPUT = "session_id bigint, key string, seq bigint, value string, novelty double, score double, promoted boolean"
#: Parallel arrays by key: how many candidates were seen, and the value last promoted.
STATE = "names array<string>, seen array<bigint>, held array<string>"


def score_one(kind: str, confidence: float, impact: float, emotion: float, earlier: int, held: str | None, value: str) -> tuple[float, float]:
    """(novelty, score) of a candidate."""
    novelty = scores.NOVEL_NEW if held is None else scores.NOVEL_SAME if held == value else scores.NOVEL_CHANGED
    parts = {"importance": scores.IMPORTANCE.get(kind, scores.OTHER_IMPORTANCE), "confidence": confidence, "impact": impact, "emotion": emotion, "recurrence": min(1.0, earlier / 3.0), "novelty": novelty}
    total = 0.0
    for name, weight in scores.PARTS.items():
        total = total + weight * parts[name]
    return novelty, max(0.0, min(1.0, total))


def promote_stream(candidates: DataFrame, *, threshold: float = scores.PROMOTE_FROM) -> DataFrame:
    """Scored candidates of a stream (session_id, key, seq, kind, value, confidence, impact, emotion). Within a batch a
    session's rows are taken in the order of ``seq``; across batches they must come in that order, as turns do."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        held: dict[str, str | None] = {}
        if state.exists:
            names, counts, values = state.get
            seen, held = dict(zip(names, counts, strict=True)), dict(zip(names, values, strict=True))
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            novelty, score = score_one(r.kind, r.confidence, r.impact, r.emotion, int(seen.get(r.key, 0)), held.get(r.key), r.value)
            promoted = score >= threshold
            seen[r.key] = int(seen.get(r.key, 0)) + 1
            held[r.key] = r.value if promoted else held.get(r.key)
            rows.append((key[0], r.key, r.seq, r.value, novelty, score, promoted))
        names = list(seen)
        state.update((names, [seen[n] for n in names], [held[n] for n in names]))
        yield pd.DataFrame(rows, columns=["session_id", "key", "seq", "value", "novelty", "score", "promoted"])

    return candidates.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def history_stream(turns: DataFrame, *, size: int = 6) -> DataFrame:
    """(conv_id, turn, history): each turn of a stream with the texts of up to ``size`` turns before it."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            rows.append((key[0], r.turn, list(held)))
            held = [*held, r.text][-size:]
        state.update((held,))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "history"])

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id bigint, turn bigint, history array<string>", "texts array<string>", "append", GroupStateTimeout.NoTimeout)


def every_nth(turns: DataFrame, n: int) -> DataFrame:
    """Only each n-th turn of a conversation since the stream began: when candidates are extracted."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        for rows in batches:
            at = [(count + i + 1) % max(1, n) == 0 for i in range(len(rows))]
            count += len(rows)
            yield rows[at]
        state.update((count,))

    return turns.groupBy("conv_id").applyInPandasWithState(update, turns.schema, "count bigint", "append", GroupStateTimeout.NoTimeout)
