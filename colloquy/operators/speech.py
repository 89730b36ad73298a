"""Speech corpora: transcript lines, speaker ids, symbol sequences and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_transcript(raw: DataFrame, *, column: str = "value", sep: str = "|") -> DataFrame:
    """(utt, speaker, language, text, error): lines of exactly four fields; any other has an error instead of fields.
    Blank lines are skipped."""
    parts = F.split(F.col(column), f"\\Q{sep}\\E", -1)
    fine = F.size(parts) == 4
    take = lambda i: F.when(fine, F.get(parts, F.lit(i)))
    lines = raw.filter(F.trim(column) != "")
    return lines.select(take(0).alias("utt"), take(1).alias("speaker"), take(2).alias("language"), take(3).alias("text"), F.when(~fine, F.concat(F.size(parts).cast("string"), F.lit(" fields"))).alias("error"))


def transcript_line(*fields: Column, sep: str = "|") -> Column:
    """Fields joined for writing; arrays of numbers go in as space-joined text."""
    return F.concat_ws(sep, *fields)


def packed_ints(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), " ")


def unpacked_ints(packed: Column) -> Column:
    return F.when(F.trim(packed) == "", F.array().cast("array<int>")).otherwise(F.split(F.trim(packed), " +").cast("array<int>"))


def route(parsed: DataFrame, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows); with ``raise`` the good rows fail on the first error, with ``use`` they hold all rows."""
    bad = parsed.filter("error IS NOT NULL")
    if policy == "use":
        return parsed, bad
    if policy == "raise":
        checked = parsed.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad line: "), F.col("error")))))
        return checked, bad
    return parsed.filter("error IS NULL"), bad


def dense_ids(rows: DataFrame, value: str, position: str) -> DataFrame:
    """(value, id, n): ids from 0 in the order in which values are first seen. Only one row for each value is ranked."""
    seen = rows.groupBy(value).agg(F.min(position).alias("_first"), F.count("*").alias("n"))
    return seen.select(value, (F.row_number().over(W.orderBy("_first")) - 1).cast("long").alias("id"), "n")


def first_existing(rows: DataFrame, files: DataFrame, *, path: str, position: str) -> DataFrame:
    """The first row of each path that has a file: a path without one never counts as seen."""
    there = rows.join(files.select(path).distinct(), path, "left_semi")
    return there.withColumn("_n", F.row_number().over(W.partitionBy(path).orderBy(position))).filter("_n = 1").drop("_n")


def with_blanks(ids: Column, blank: int = 0) -> Column:
    """A blank before, between and after: 2n + 1 entries."""
    return F.concat(F.flatten(F.transform(ids, lambda x: F.array(F.lit(blank).cast("int"), x))), F.array(F.lit(blank).cast("int")))


def blank_counts(counts: Column) -> Column:
    """Units a word for sequences with blanks: doubled, and one more for the first word."""
    return F.transform(counts, lambda x, i: x * 2 + F.when(i == 0, 1).otherwise(0))


def symbol_ids(symbols: Column, table: Sequence[str] | str, *, unknown: int) -> Column:
    """1-based places of symbols in a table; empty ones are left out."""
    known = F.create_map(*[F.lit(x) for i, s in enumerate(table, 1) for x in (s, i)])
    return F.transform(F.filter(symbols, lambda s: s != ""), lambda s: F.coalesce(F.try_element_at(known, s), F.lit(unknown)))


def clip(start_ms: Column, end_ms: Column, total_ms: Column, margin: int = 200) -> tuple[Column, Column]:
    """A segment with a margin at both ends, inside the recording."""
    return F.greatest(F.lit(0), start_ms - margin), F.least(total_ms, end_ms + margin)


def frames(n_bytes: Column, hop: int = 512) -> Column:
    return F.floor(n_bytes / (2 * hop)).cast("long")


def nearest_cost(cost: Column, costs: Sequence[int]) -> Column:
    """The 0-based place of the nearest of some costs; the first of equally near ones."""
    gaps = F.array(*[F.abs(cost - c) for c in costs])
    return F.array_position(gaps, F.array_min(gaps)) - 1


def mean_scores(rows: DataFrame, *, model: str, item: str, score: str, items: Sequence[str]) -> DataFrame:
    """A row for each model with its score of each item and their mean, best first."""
    wide = rows.groupBy(model).pivot(item, list(items)).agg(F.avg(score))
    total = sum((F.col(f"`{i}`") for i in items), F.lit(0.0))
    return wide.withColumn("mean", total / len(items)).orderBy(F.col("mean").desc(), model)
