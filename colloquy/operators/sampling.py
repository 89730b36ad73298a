"""Splits, holdouts and choices that are random but the same on every run and in any engine: by MD5 of seed and id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded(seed: str, *ids: Column) -> Column:
    """A hex digest that orders rows at random."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[x.cast("string") for x in ids]))


def unit_interval(digest: Column) -> Column:
    """A digest's first 52 bits in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def eval_size(n: int, ratio: float) -> int:
    """int(n * ratio), but one of several rows at least; none without a ratio."""
    return 0 if ratio <= 0 or n == 0 else min(n, max(int(n * ratio), 1 if n > 1 else 0))


def smallest(df: DataFrame, digest: str, n: int, *, digits: int = 4, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``chosen``: whether a row's digest is among the n smallest. Digests are counted by their first hex
    digits; only the rows that share those where the n-th falls are ranked, so nothing is sorted as a whole."""
    lead = F.substring(digest, 1, digits)
    counts = df.groupBy(lead.alias("lead")).agg(F.count("*").alias("n"))  # 16**digits rows at most
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("lead").rowsBetween(W.unboundedPreceding, W.currentRow)))
    edge = upto.filter(F.col("upto") >= n).orderBy("lead").select("lead", (F.col("upto") - F.col("n")).alias("before")).first() if n > 0 else None
    if n <= 0:
        return df.withColumn("chosen", F.lit(False))
    if edge is None:
        return df.withColumn("chosen", F.lit(True))
    rank = F.row_number().over(W.partitionBy(lead).orderBy(digest, *ties))
    inside = df.filter(lead == edge["lead"]).withColumn("chosen", rank <= n - edge["before"])
    return df.filter(lead != edge["lead"]).withColumn("chosen", lead < edge["lead"]).unionByName(inside)


def first_of_groups(df: DataFrame, n: int, rank: str, *, group: str, order: Sequence[Column], shard: Column) -> tuple[DataFrame, DataFrame]:
    """(first, rest): the first ``n`` rows of each group, with their rank, and all others. Shards of a group are ranked
    by themselves and only the first n of each together, so a large group is no single task's work. Null groups are one."""
    dealt = df.withColumn(rank, F.row_number().over(W.partitionBy(group, shard).orderBy(*order)))
    last = dealt.filter(F.col(rank) <= n).withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return last.filter(F.col(rank) <= n), dealt.filter(F.col(rank) > n).unionByName(last.filter(F.col(rank) > n)).drop(rank)


def rank_in_group(df: DataFrame, rank: str, *, group: str, digest: str, ties: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """``df`` with the 0-based rank of each row of a group by digest: what the group has under smaller first hex digits,
    counted, and the rank among those of the same digits. Rows of a null group are left out."""
    lead = F.substring(digest, 1, digits)
    counts = df.groupBy(F.col(group).alias("_of"), lead.alias("_lead")).agg(F.count("*").alias("_n"))  # 16**digits rows a group at most
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("_of").orderBy("_lead")) - F.col("_n")).drop("_n")
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(group, lead).orderBy(digest, *ties)) - 1)
    joined = ranked.join(before, (F.col(group) == F.col("_of")) & (lead == F.col("_lead")))
    return joined.withColumn(rank, F.col(rank) + F.col("_before")).drop("_of", "_lead", "_before")


def split(df: DataFrame, *ids: str, ratio: float, seed: str) -> DataFrame:
    """``df`` with ``part``: eval for ``eval_size`` rows, train for the others."""
    n = eval_size(df.count(), ratio)
    marked = smallest(df.withColumn("_digest", seeded(seed, *[F.col(i) for i in ids])), "_digest", n, ties=ids)
    return marked.withColumn("part", F.when(F.col("chosen"), "eval").otherwise("train")).drop("_digest", "chosen")


def holdout_by_group(df: DataFrame, *, group: str, ids: Sequence[str], per_group: int, total: int, seed: str) -> DataFrame:
    """``df`` with ``part``: val for ``per_group`` rows of each group, but ``total`` at most, the rest train. Only the
    held-out rows, a few for each group, are ranked together."""
    digest = df.withColumn("_digest", seeded(seed, *[F.col(i) for i in ids]))
    first, rest = first_of_groups(digest, per_group, "_n", group=group, order=[F.col(c) for c in ("_digest", *ids)], shard=F.substring("_digest", 1, 2))
    held = smallest(first.drop("_n"), "_digest", total, ties=ids)
    out = held.withColumn("part", F.when(F.col("chosen"), "val").otherwise("train")).drop("chosen")
    return out.unionByName(rest.withColumn("part", F.lit("train"))).drop("_digest")


def weighted_choice(u: Column, choices: dict[str, float]) -> Column:
    """The choice in whose share of [0, 1) a number falls."""
    total, at, out = sum(choices.values()), 0.0, None
    for name, w in choices.items():
        at += w / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(list(choices)[-1])


def bank_choice(digest: Column, bank: Sequence[str]) -> Column:
    """One entry of a bank, by a digest."""
    return F.element_at(F.array(*map(F.lit, bank)), (F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(len(bank))) + 1).cast("int"))


def keep_newest(df: DataFrame, *, group: str, order: str, keep: int, spared: Column | None = None, shards: int = 64) -> DataFrame:
    """The rows beyond the newest ``keep`` of each group: what retention would delete. ``spared`` rows, such as the first
    checkpoint, are neither counted nor deleted."""
    rows = df if spared is None else df.filter(~F.coalesce(spared, F.lit(False)))
    shard = F.pmod(F.xxhash64(order), F.lit(shards))
    return first_of_groups(rows, keep, "_n", group=group, order=[F.col(order).desc()], shard=shard)[1]


def length_buckets(length: Column, bounds: Sequence[int]) -> Column:
    """The 0-based bucket (b_i, b_i+1] of a length, or null outside all of them."""
    out = None
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        inside = (length > low) & (length <= high)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def padded_buckets(df: DataFrame, bucket: str, *, multiple: int) -> DataFrame:
    """(bucket, n, padded): rows of each bucket and what repetition makes of them, a multiple of replicas * batch."""
    return df.filter(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count("*").alias("n")).withColumn("padded", (F.ceil(F.col("n") / multiple) * multiple).cast("long"))


def bucket_batches(df: DataFrame, bucket: str, *ids: str, replicas: int, batch: int, epoch: int = 0) -> DataFrame:
    """Rows of each bucket in a seeded order, repeated up to a multiple of replicas * batch and dealt to replicas in
    turn: (bucket, replica, step, ids). Within a bucket rows are ranked by digest, in parts by its first digits; ranks wrap
    round for the padding."""
    rows = df.filter(F.col(bucket).isNotNull()).withColumn("_digest", seeded(str(epoch), *[F.col(i) for i in ids]))
    ranked = rank_in_group(rows, "_at", group=bucket, digest="_digest", ties=ids)
    sizes = padded_buckets(df, bucket, multiple=replicas * batch).withColumnRenamed(bucket, "_bucket")
    times = F.ceil((F.col("padded") - F.col("_at")) / F.col("n")).cast("int")
    spread = ranked.join(sizes, F.col(bucket) == F.col("_bucket")).withColumn("_again", F.explode(F.sequence(F.lit(0), times - 1)))
    place = F.col("_at") + F.col("_again") * F.col("n")
    return spread.select(bucket, F.pmod(place, F.lit(replicas)).alias("replica"), F.floor(place / (replicas * batch)).alias("step"), *ids)
