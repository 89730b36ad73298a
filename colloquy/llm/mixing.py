"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / weight`` from a hash, documents of a source are ordered by it, and
sizes are prefix-summed up to the source's token budget. Whole epochs come first; the fraction that remains is chosen
by the order of the keys. No source is ever sorted as one: sizes are summed in buckets of the key, and only the bucket
in which the budget ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.naming import apart
from colloquy.session import cut, materialise

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(identity: Column, weight: Column, seed: str) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 52 bits of an MD5, the same on every run and in any engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), identity)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(2.0**52)) / weight


def source_targets(sizes: DataFrame, shares: tuple[int, ...], cap: int) -> DataFrame:
    """(source, total, target) from (source, total): shares by code point order of the sources (null last, shares
    repeating) of the sum of all totals; none above ``cap`` times its total, the excess shared anew by weight.

    One row per source; each round of the sharing is one aggregation, and rounds are at most as many as distinct caps.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (F.col("rank") % len(shares) + 1).cast("int"))
    ranked = cut(ranked.select("source", "total", share.alias("w"), (F.col("total") * cap).cast("double").alias("most")))
    everything = float(ranked.agg(F.sum("total")).first()[0] or 0)
    # A source is capped when its weight times the level exceeds its cap; the level only rises, so this ends.
    level = 0.0
    while True:
        capped = F.col("w") * F.lit(level) > F.col("most")
        used, weight = ranked.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("w")))).first()
        if not weight:
            break
        new = (everything - (used or 0.0)) / weight
        if new <= level:
            break
        level = new
    return ranked.select("source", "total", F.least(F.col("w") * F.lit(level), F.col("most")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weight: Column | None = None,
    size: Column | None = None,
    shares: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    rows_per_bucket: int = 2000,
    broadcast_sources: int = 100_000,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (words, of its source), ``copies`` and ``taken`` (= copies *
    size). Columns of ``docs`` with these names are replaced.

    ``size``: the size of a row, if it is known already; else the words of ``text`` are counted.
    ``weight``: quality weight of a row, above 0; null or not positive counts as 1. The document that crosses a budget
    is taken if half of it or more fits. Sources: a null source is one of its own. A null or empty text has size 0 and
    takes nothing. Rows of equal doc_id and source share a key: they are taken or left together. An empty table gives
    an empty result. The plan per source has one row per source; it is broadcast up to ``broadcast_sources`` rows and
    joined by a shuffle beyond.
    """
    spark = docs.sparkSession
    size = word_count(F.col(text)) if size is None else size.cast("long")
    ours = ["size", "source_size", "target", "copies", "taken"]
    names = [c for c in docs.columns if c not in ours]
    of, whole, ends, last_key, own_key, place = apart(docs, "source", "epochs", "ends", "last_key", "key", "place")
    w = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1.0))
    identity = F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(source).cast("string"), F.lit("")))
    key = sampling_key(identity, w, seed)

    sized = materialise(docs.select(F.col(source).alias("source"), size.alias("size"), key.alias("key")), "mix-sizes")
    n = sized.count()
    buckets = min(65536, max(64, n // rows_per_bucket))
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * buckets).cast("long")
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("total")), shares, cap))
    # target = epochs whole passes and rest words of one more
    epochs = F.when(F.col("total") > 0, F.least(F.floor(F.col("target") / F.col("total")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("total"))
    # the bucket in which a source's rest ends: at most `buckets` rows of a source are put in order here
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    run_sums = sums.withColumn("upto", F.sum("size").over(run)).alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source"))
    crossing = (
        run_sums.filter("upto > rest")
        .groupBy(F.col("t.source").alias("source"), "rest")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before")), "bucket").alias("c"))
        .select("source", "rest", "c.bucket", "c.before")
    )
    inside = sized.withColumn("bucket", bucket).alias("d").join(crossing.alias("c"), F.expr("d.source <=> c.source AND d.bucket = c.bucket"))
    by_key = W.partitionBy("d.source").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("before") + F.sum("d.size").over(by_key)
    group = F.sum("d.size").over(W.partitionBy("d.source", "key"))
    last = (
        inside.select(F.col("d.source").alias("source"), "key", "rest", upto.alias("upto"), group.alias("group"))
        .filter("2 * upto - group <= 2 * rest")
        .groupBy("source")
        .agg(F.max("key").alias("last_key"))
    )
    plan = (
        targets.alias("t")
        .join(crossing.alias("c"), F.expr("t.source <=> c.source"), "left")
        .join(last.alias("l"), F.expr("t.source <=> l.source"), "left")
        .select(
            F.col("t.source").alias(of), F.col("t.total").alias("source_size"), F.col("t.target").alias("target"), F.col("t.epochs").alias(whole),
            F.col("c.bucket").alias(ends), F.col("l.last_key").alias(last_key),
        )
    )
    plan = cut(plan)
    if plan.count() <= broadcast_sources:
        plan = F.broadcast(plan)
    # a weight may be of columns that the result replaces: key and size are taken before
    marked = docs.select(*[F.col(f"`{c}`") for c in names], size.alias("size"), key.alias(own_key))
    marked = marked.withColumn(place, F.floor((F.lit(1.0) - F.exp(-F.col(own_key))) * buckets).cast("long"))
    joined = marked.join(plan, F.col(source).eqNullSafe(F.col(of)), "inner")
    chosen = (F.col(place) < F.col(ends)) | ((F.col(place) == F.col(ends)) & (F.col(own_key) <= F.col(last_key)))
    copies = F.col(whole) + F.coalesce(chosen, F.lit(False)).cast("long")
    return (
        joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[f"`{c}`" for c in names], *ours)
    )
