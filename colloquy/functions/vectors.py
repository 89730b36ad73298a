"""Vector and similarity functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit_cosine(a: Column, b: Column) -> Column:
    """The cosine brought to 0 to 1."""
    return (F.greatest(F.least(cosine(a, b), F.lit(1.0)), F.lit(-1.0)) + 1.0) / 2.0


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(double(a), double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(double(a), lambda x: x / n)).otherwise(double(a))


def has_nan(a: Column) -> Column:
    return F.coalesce(F.exists(double(a), lambda x: F.isnan(x)), F.lit(False))


def _scaled(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def combine(*parts: tuple[float | Column, Column]) -> Column:
    """The weighted sum of vectors."""
    out = None
    for w, v in parts:
        now = _scaled(double(v), w if isinstance(w, Column) else F.lit(w))
        out = now if out is None else F.zip_with(out, now, lambda x, y: x + y)
    return out


def lerp(a: Column, b: Column, w: float) -> Column:
    return combine((1.0 - w, a), (w, b))


def add_difference(a: Column, b: Column, c: Column, w: float) -> Column:
    return combine((1.0, a), (w, b), (-w, c))


def slerp(a: Column, b: Column, w: float, straight_from: float = 0.998) -> Column:
    """On the sphere; in a straight line where the vectors almost coincide or oppose."""
    d = dot(unit(a), unit(b))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)))
    round_ = combine((F.sin((1.0 - w) * angle) / F.sin(angle), a), (F.sin(F.lit(w) * angle) / F.sin(angle), b))
    return F.when(F.abs(d) > straight_from, lerp(a, b, w)).otherwise(round_)


def intensity(mean: Column, v: Column, w: float) -> Column:
    """mean + (v - mean) * w."""
    return F.zip_with(double(mean), double(v), lambda m, x: m + (x - m) * w)


def jaccard(a: Column, b: Column) -> Column:
    """Of sets as arrays of distinct values; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def word_ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words; none where there are fewer."""
    # zipped from shifted copies: an expression inside a lambda would be worked out again for each run
    most = F.greatest(F.size(words) - n + 1, F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, j + 1, most) for j in range(n)])
    runs = F.transform(shifted, lambda x: F.concat_ws(" ", *[x[str(j)] for j in range(n)]))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def ngram_overlap(a: Column, b: Column, n: int) -> Column:
    """The share of a's word n-grams that b has; 0 where either has fewer than n words."""
    x, y = word_ngrams(a, n), word_ngrams(b, n)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0)


def hashed_embedding(words: Column, dim: int) -> Column:
    """Counts of one- and two-word runs in ``dim`` hash buckets, scaled to unit length. No words give zeros."""
    runs = F.concat(words, F.when(F.size(words) > 1, F.transform(F.arrays_zip(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1)), lambda x: F.concat_ws(" ", x["0"], x["1"]))).otherwise(F.array().cast("array<string>")))
    at = F.transform(runs, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    # one pass: the vector so far, with one entry raised by each run
    counts = F.aggregate(at, F.array_repeat(F.lit(0.0), dim), lambda v, i: F.concat(F.slice(v, F.lit(1), i), F.array(F.get(v, i) + 1), F.slice(v, i + 2, F.lit(dim))))
    return unit(counts)


def even_share(total: Column, parts: Column, index: Column) -> Column:
    """How many of ``total`` things the part at a 0-based index gets if earlier parts get the rest."""
    return F.floor(total / parts) + (index < total % parts).cast("long")
