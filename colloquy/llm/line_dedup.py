"""Site-relative line frequency: lines that recur over many pages of one host are boilerplate.

Lines are hashed; (host, line) is counted with map-side sums over distinct pages. What is over the ratio is a short
list per host: a host can have at most (mean lines of a page / ratio) such lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.naming import apart
from colloquy.session import cut


def boilerplate_lines(docs: DataFrame, *, text: str = "text", host: str = "source", max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of lines on more than ``max_ratio`` of a host's pages and on
    ``min_pages`` at least. Pages of a host with equal texts count as one, so that copies make no boilerplate.
    Blank lines and null texts count nothing; a null host is a host."""
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.trim(x) != "")
    pages = (
        docs.filter(F.col(text).isNotNull())
        .select(F.col(host).alias("host"), F.xxhash64(F.lit(1), F.col(text)).alias("page"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"))
        .groupBy("host", "page")
        .agg(F.first("lines").alias("lines"))
    )
    pages = cut(pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = pages.select("host", F.explode("lines").alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    return (
        counts.alias("c")
        .join(totals.alias("t"), F.expr("c.host <=> t.host"))
        .filter(F.col("n_pages") > F.col("host_pages") * F.lit(max_ratio))
        .select("c.host", "line_hash", "n_pages", "host_pages")
    )


def drop_boilerplate(
    docs: DataFrame, *, text: str = "text", host: str = "source", max_ratio: float = 0.05, min_pages: int = 5, broadcast_lines: int = 200_000
) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and ``n_lines`` and ``n_dropped``. Kept lines stay in
    order, blank lines too. A null text stays null with 0 lines; a text of boilerplate only becomes empty. Columns
    ``n_lines`` and ``n_dropped`` of ``docs`` are replaced, others stay whatever their names; an empty table stays empty.

    The list of lines is broadcast while it has ``broadcast_lines`` rows at most, and joined by a shuffle on the host
    beyond (Spark splits a hot host in that join, as every row is looked up by itself).
    """
    found = cut(boilerplate_lines(docs, text=text, host=host, max_ratio=max_ratio, min_pages=min_pages))
    at, drop, lines, clean = apart(docs, "host", "drop", "lines", "clean")
    per_host = found.groupBy(F.col("host").alias(at)).agg(F.collect_set("line_hash").alias(drop))
    if found.count() <= broadcast_lines:
        per_host = F.broadcast(per_host)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    kept = F.filter(F.col(lines), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), F.xxhash64(x)))
    known = F.col(text).isNotNull()
    return (
        docs.select(*[f"`{c}`" for c in names])
        .join(per_host, F.col(host).eqNullSafe(F.col(at)), "left")
        .withColumn(lines, F.split(F.col(text), "\n", -1))
        .withColumn(clean, F.when(F.col(drop).isNull(), F.col(lines)).otherwise(kept))
        .withColumn("n_lines", F.when(known, F.size(lines)).otherwise(0).cast("long"))
        .withColumn("n_dropped", F.when(known, F.size(lines) - F.size(clean)).otherwise(0).cast("long"))
        .withColumn(text, F.when(known, F.array_join(clean, "\n")))
        .select(*[f"`{c}`" for c in names], "n_lines", "n_dropped")
    )
