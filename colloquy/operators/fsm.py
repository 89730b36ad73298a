"""State machines declared as tables of rules, and their replay over signals.

Rules of a state are tried in order; all conditions of a rule must hold; the first that does gives the next state. A
machine is compiled to one expression, and a replay is a fold over each session's turns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """From ``state`` to ``to`` when all of ``when`` hold: signal -> '>=2', '==1', '<3', 'true' or a plain string."""

    state: str
    to: str
    when: dict[str, str] = field(default_factory=dict)


def condition(value: Column, expression: str, kind: str = "int") -> Column:
    """One condition on a signal; a missing signal fails it."""
    if kind == "string":
        found = value == expression.removeprefix("==")
    elif kind == "boolean":
        found = value == (expression.lower() == "true")
    else:
        for op, make in (
            (">=", lambda v, n: v >= n), ("==", lambda v, n: v == n), ("<=", lambda v, n: v <= n), (">", lambda v, n: v > n), ("<", lambda v, n: v < n),
        ):
            if expression.startswith(op):
                found = make(value, int(expression[len(op) :]))
                break
        else:
            raise ValueError(f"no such condition: {expression}")
    return F.coalesce(found, F.lit(False))


def step(state: Column, signals: Column, rules: Sequence[Rule], kinds: dict[str, str] | None = None) -> Column:
    """The state after one turn; a state without a rule that holds stays."""
    out = None
    for r in rules:
        holds = state == r.state
        for name, expression in r.when.items():
            holds = holds & condition(signals[name], expression, (kinds or {}).get(name, "int"))
        out = F.when(holds, r.to) if out is None else out.when(holds, r.to)
    return state if out is None else out.otherwise(state)


def status(threat: Column, closeness: Column, names: tuple[str, str, str, str] = ("hostile", "distant", "close", "devoted")) -> Column:
    """The relation that two signals stand for."""
    return F.when((threat >= 2) & (closeness <= 1), names[0]).when(closeness >= 3, names[3]).when(closeness == 2, names[2]).otherwise(names[1])


def clamped(previous: Column, raw: Column, low: int, high: int, most: int = 1) -> Column:
    """A signal within its bounds and within ``most`` of the one before."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), raw))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.greatest(previous - most, F.least(previous + most, inside))))


def flags(of_state: Column, everywhere: Column) -> Column:
    """A state's flags, overridden by those that hold everywhere."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(of_state), lambda e: ~F.map_contains_key(everywhere, e["key"])), F.map_entries(everywhere)))


def replay(turns: DataFrame, rules: Sequence[Rule], *, initial: str, signals: Sequence[str], session: str = "session", order: str = "turn", dwell: int = 0, kinds: dict[str, str] | None = None) -> DataFrame:
    """(session, turn, state, moved): the state after each turn. With ``dwell``, a state is kept for so many turns at
    least before it may be left."""
    item = F.struct(F.col(order).alias("turn"), *signals)
    grouped = turns.groupBy(session).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "array<struct<turn: bigint, state: string, moved: boolean>>"
    start = F.struct(F.lit(initial).alias("state"), F.lit(0).alias("stay"), F.array().cast(kind).alias("out"))

    def fold(s: Column, x: Column) -> Column:
        wanted = step(s["state"], x, rules, kinds)
        new = F.when(s["stay"] >= dwell, wanted).otherwise(s["state"])
        moved = new != s["state"]
        row = F.struct(x["turn"].cast("long").alias("turn"), new.alias("state"), moved.alias("moved"))
        return F.struct(new.alias("state"), F.when(moved, 0).otherwise(s["stay"] + 1).alias("stay"), F.concat(s["out"], F.array(row)).alias("out"))

    return grouped.select(session, F.explode(F.aggregate("items", start, fold, lambda s: s["out"])).alias("x")).select(session, "x.*")


def limited_signal(turns: DataFrame, raw: str, *, low: int, high: int, start: int = 0, session: str = "session", order: str = "turn") -> DataFrame:
    """(session, turn, value): a signal that moves by one at most from its own limited value the turn before."""
    grouped = turns.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(raw).cast("int").alias("raw")))).alias("items"))
    kind = "array<struct<turn: bigint, value: int>>"
    begin = F.struct(F.lit(start).alias("value"), F.array().cast(kind).alias("out"))

    def fold(s: Column, x: Column) -> Column:
        new = clamped(s["value"], x["raw"], low, high)
        return F.struct(new.alias("value"), F.concat(s["out"], F.array(F.struct(x["turn"].cast("long").alias("turn"), new.alias("value")))).alias("out"))

    return grouped.select(session, F.explode(F.aggregate("items", begin, fold, lambda s: s["out"])).alias("x")).select(session, "x.*")


def retry_route(code: Column, attempt: Column, limits: dict[str, int], give_up: str = "give_up") -> Column:
    """Where a failed attempt goes: again while its code's limit allows, else away; no code goes on."""
    out = F.when(F.coalesce(code, F.lit("")) == "", "next")
    for name, most in limits.items():
        out = out.when(code == name, F.when(attempt < most, "retry").otherwise(give_up))
    return out.otherwise(give_up)
