"""Improbable-feature digests: the rarest byte windows of a text in chained Bloom filters.

The Shannon entropy of every 64-byte window is taken in steps; how often each step occurs over the whole corpus ranks
it, rarest first. In each run of 64 windows the leftmost of lowest rank scores, and windows that score often enough
are features. Their hashes go into 2048-bit filters, a new one each time the last is full. Short texts have filters of
all their small windows, and texts of a middle length both kinds, an empty filter between them: so a text that an edit
takes over the border still shares a kind with what it was. Two digests are compared filter by filter, in one kind that
both have, through shared bits, less what filters of that fill share by chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 64
STEPS = 1000
#: Windows under this entropy (of 6 bits) are runs and padding: never features.
WEAK = 100
POPULAR = 16
#: Texts under this many bytes are too short for rarity to choose from: all their windows of SMALL bytes are features.
SHORT = 256
SMALL = 12
#: Texts under this many bytes have their small windows too. Two thirds of a text's characters are a third of its bytes
#: at least, so a text from here on that keeps as many is not under SHORT.
BOTH = 3 * SHORT
BITS = 2048
PROBES = 5
PER_FILTER = 160
#: Of the bits that two filters could share beyond chance, the part that counts as none.
MARGIN = 0.1
_LOG = np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))])
_GAIN = np.append(np.diff(_LOG), 0.0)  # by count before a byte enters


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """Entropy of each window in steps from 0 to STEPS, for at least WINDOW bytes.

    A byte that enters changes the sum of c*log2(c) by a function of how many equal ones are in the window, and so does
    one that leaves; both counts come from its rank among equal bytes."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64 if n > 4_000_000 else np.int32) * (n + WINDOW) + order.astype(np.int32)
    # pairs of equal bytes under a window apart: the next one, the one after it, and so on until there are none
    earlier, later = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int8)
    for j in range(1, min(WINDOW, n)):
        near = (key[j:] - key[:-j]) < WINDOW
        if not near.any():
            break
        near = near.view(np.int8)
        earlier[j:] += near
        later[:-j] += near
    before, after = np.empty(n, dtype=np.int8), np.empty(n, dtype=np.int8)
    before[order], after[order] = earlier, later
    # The first window: each byte enters a window that began at 0.
    change = _GAIN[before]
    change[WINDOW:] -= _GAIN[after[: n - WINDOW]]
    entropy = 6.0 - np.cumsum(change)[WINDOW - 1 :] / WINDOW
    return np.clip(np.rint(entropy * (STEPS / 6.0)), 0, STEPS).astype(np.int32)


def steps_of_each(raws: list[bytes], chunk: int = 32_768) -> list[np.ndarray | None]:
    """``entropy_steps`` of each, None for those under a window; short ones are worked on together."""
    out: list[np.ndarray | None] = [None] * len(raws)
    held: list[int] = []
    size = 0
    for i, raw in enumerate(raws):
        if len(raw) >= WINDOW:
            held.append(i)
            size += len(raw)
        if held and (size >= chunk or i == len(raws) - 1):
            together = entropy_steps(np.frombuffer(b"".join(raws[k] for k in held), dtype=np.uint8))
            at = 0
            for k in held:
                out[k] = together[at : at + len(raws[k]) - WINDOW + 1]
                at += len(raws[k])
            held, size = [], 0
    return out


def _leftmost_lowest(ranks: np.ndarray) -> np.ndarray:
    """For each run of WINDOW positions (or the only shorter one), where its lowest rank stands first."""
    n = len(ranks)
    low = ranks.astype(np.int64 if n > 2_000_000 else np.int32) * n + np.arange(n, dtype=np.int32)
    if n <= WINDOW:
        return np.array([low.min() % n])
    width = 1
    while width < WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return low % n


_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(WINDOW // 8)], dtype=np.uint64)


def _hashes(windows: np.ndarray) -> list[int]:
    """64-bit hashes of rows of WINDOW bytes."""
    x = np.ascontiguousarray(windows).view("<u8")
    x = (x ^ x >> np.uint64(32)) * _MIX
    x = (x ^ x >> np.uint64(29)).sum(axis=1, dtype=np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).tolist()


def features(data: bytes, steps: np.ndarray | None, ranks: np.ndarray) -> list[int]:
    """Hashes of the windows selected by rarity in order, each once; none under SHORT bytes."""
    if steps is None or len(data) < SHORT:
        return []
    view = np.frombuffer(data, dtype=np.uint8)
    at = _leftmost_lowest(ranks[steps])
    votes = np.bincount(at)
    keep = np.flatnonzero(votes >= min(POPULAR, len(at)))
    keep = keep[steps[keep] >= WEAK]
    if len(keep) == 0:
        keep = at[:1]
    return list(dict.fromkeys(_hashes(np.lib.stride_tricks.sliding_window_view(view, WINDOW)[keep])))


def small_features(data: bytes) -> list[int]:
    """Hashes of all windows of SMALL bytes in order, each once; none from BOTH bytes on. A text under SMALL bytes is
    one feature."""
    if not data or len(data) >= BOTH:
        return []
    view = np.frombuffer(data, dtype=np.uint8)
    small = view if len(view) >= SMALL else np.pad(view, (0, SMALL - len(view)))
    small = np.lib.stride_tricks.sliding_window_view(small, SMALL)
    return list(dict.fromkeys(_hashes(np.pad(small, ((0, 0), (0, WINDOW - SMALL))))))


_SHIFTS = np.arange(PROBES, dtype=np.uint64) * np.uint64(11)


def filters(found: list[int]) -> np.ndarray:
    """The chained filters as rows of bits packed in bytes."""
    if not found:
        return np.zeros((0, BITS // 8), dtype=np.uint8)
    words = (np.array(found, dtype=np.uint64)[:, None] >> _SHIFTS) % np.uint64(BITS)
    bits = np.zeros((-(-len(found) // PER_FILTER), BITS), dtype=np.uint8)
    bits[np.repeat(np.arange(len(found)) // PER_FILTER, PROBES), words.ravel().astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def _kinds(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filters of ranked and of small windows; the empty filter between them is in neither."""
    empty = np.flatnonzero(~packed.any(axis=1))
    return (packed[: empty[0]], packed[empty[0] + 1 :]) if len(empty) else (packed, packed[:0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the mean, over the filters of the shorter digest, of the best match in the other, by small windows
    where both have them and by ranked ones elsewhere. Two empty digests are equal; an empty one is like no other."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    (ranked_a, small_a), (ranked_b, small_b) = _kinds(a), _kinds(b)
    a, b = (small_a, small_b) if len(small_a) and len(small_b) else (ranked_a, ranked_b)
    if len(a) == 0 or len(b) == 0:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    wide = np.unpackbits(b, axis=1).astype(np.float32)
    total = 0.0
    for at in range(0, len(a), 256):
        x = np.unpackbits(a[at : at + 256], axis=1).astype(np.float32)
        shared = x @ wide.T
        fill_a, fill_b = x.sum(axis=1)[:, None], wide.sum(axis=1)[None, :]
        most, chance = np.minimum(fill_a, fill_b), fill_a * fill_b / BITS
        least = chance + MARGIN * (most - chance)
        score = np.where(shared > least, (shared - least) / np.maximum(most - least, 1e-9), 0.0)
        total += float(np.clip(score, 0, 1).max(axis=1).sum())
    return round(total / len(a), 6)


def written(packed: np.ndarray, n_features: int) -> str:
    return f"sd:{WINDOW}:{BITS}:{len(packed)}:{n_features}:" + base64.b64encode(packed.tobytes()).decode()


def read(digest: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest.rsplit(":", 1)[1]), dtype=np.uint8).reshape(-1, BITS // 8)


def _portions(column: pa.Array, most_chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts of a column in lists of about so many characters; null is empty."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def rarity_ranks(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """The rank of each entropy step by how often it occurs over all windows of all texts, rarest first; steps of equal
    count, higher entropy first. STEPS + 1 counts come to the driver, whatever the size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS + 1, dtype=np.int64)
        for batch in batches:
            for texts in _portions(batch.column(0)):
                for steps in steps_of_each([t.encode("utf-8", "surrogatepass") for t in texts]):
                    if steps is not None:
                        counts += np.bincount(steps, minlength=STEPS + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["step", "n"])

    rows = docs.select(text).mapInArrow(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(STEPS + 1, dtype=np.int64)
    for r in rows:
        counts[r["step"]] = r["n"]
    out = np.empty(STEPS + 1, dtype=np.int32)
    out[np.lexsort((-np.arange(STEPS + 1), counts))] = np.arange(STEPS + 1)
    return out


class Fingerprint:
    """A text's digest, with what its edits can use again."""

    __slots__ = ("text", "raw", "steps", "packed", "digest")

    def __init__(self, text: str, raw: bytes, steps: np.ndarray | None, ranks: np.ndarray):
        self.text, self.raw, self.steps = text, raw, steps
        ranked, small = features(raw, steps, ranks), small_features(raw)
        self.packed = filters(ranked)
        if small:
            self.packed = np.concatenate([self.packed, np.zeros((1, BITS // 8), dtype=np.uint8), filters(small)])
        self.digest = written(self.packed, len(ranked) + len(small))


def fingerprint_each(texts: list[str], ranks: np.ndarray) -> list[Fingerprint]:
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    return [Fingerprint(t, r, s, ranks) for t, r, s in zip(texts, raws, steps_of_each(raws), strict=True)]


def edit_each(pairs: list[tuple[Fingerprint, Fingerprint]], ranks: np.ndarray) -> list[Fingerprint]:
    """For each (text, next text) the fingerprint of the edited text: its last third of code points replaced by the
    next one's first. Windows inside what stays of either have known entropies; only those across the joint are new."""
    parts = []
    for was, now in pairs:
        chars = len(was.text) // 3
        head, tail = was.text[: len(was.text) - chars], now.text[:chars]
        a, b = head.encode("utf-8", "surrogatepass"), tail.encode("utf-8", "surrogatepass")
        before = max(0, len(a) - WINDOW + 1) if was.steps is not None else 0
        behind = max(0, len(b) - WINDOW + 1) if now.steps is not None else 0
        raw = a + b
        parts.append((head + tail, raw, before, behind, raw[before : len(raw) - behind]))
    out = []
    for (was, now), (text, raw, before, behind, _), joint in zip(pairs, parts, steps_of_each([p[4] for p in parts]), strict=True):
        known = [x for x in (was.steps[:before] if before else None, joint, now.steps[:behind] if behind else None) if x is not None]
        out.append(Fingerprint(text, raw, np.concatenate(known) if len(raw) >= WINDOW else None, ranks))
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) of each row; a null or empty text has a digest without filters. ``ranks`` of one corpus
    make digests of others comparable with its own; without them they are taken from ``docs``."""
    ranks = rarity_ranks(docs, text=text) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [f.digest for texts in _portions(batch.column(1)) for f in fingerprint_each(texts, ranks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(doc_id, text).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fingerprint", T.StringType())]))


def in_order_of_ids(docs: DataFrame, *, doc_id: str, text: str, rows_per_bucket: int) -> DataFrame:
    """(doc_id, text, bucket, extra): rows in buckets of neighbouring ids, in descending order inside a partition, each
    bucket followed by copies of the row that comes next (extra = 1): so each row's successor is in its partition.

    Buckets end at ids that exist, so the row that follows a bucket is known by its id; the last is followed by the
    first. Null ids come last; equal ids go by their texts' hashes. Ids are ordered as their type is.
    """
    whole = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    column = F.col(doc_id).cast("long") if whole else F.col(doc_id)
    ids = docs.select(column.alias("id"))
    n = ids.count()
    buckets = max(1, min(65536, n // rows_per_bucket))
    if whole:
        found = ids.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [1.0], 10 * max(1000, buckets)).alias("q"), F.max("id").alias("most")).first()
        ends = sorted({*(found["q"] or []), *([found["most"]] if found["most"] is not None else [])})
    else:  # quantiles are of numbers: other ids are dealt out by ranges, and each range's last one is an end
        ranges = ids.filter("id IS NOT NULL").distinct().repartitionByRange(buckets, "id")
        ends = [r["most"] for r in ranges.groupBy(F.spark_partition_id().alias("at")).agg(F.max("id").alias("most")).orderBy("most").collect()]
    wide = max(1, int(len(ends) ** 0.5))
    groups = [ends[i : i + wide] for i in range(0, len(ends), wide)]
    below = lambda array: F.size(F.filter(array, lambda b: b < column))
    if groups:
        # two short searches: the group of buckets, then the bucket in it
        coarse = below(F.lit([g[-1] for g in groups]))
        nested = F.array(*[F.lit(g) for g in groups])
        bucket = F.when(column.isNull(), 0).otherwise(F.least(coarse, F.lit(len(groups) - 1)) * wide + below(F.element_at(nested, F.least(coarse, F.lit(len(groups) - 1)) + 1)))
    else:
        bucket = F.lit(0)
    last = max(0, len(ends) - 1)
    is_end = F.coalesce(F.array_contains(F.element_at(nested, F.least(coarse, F.lit(len(groups) - 1)) + 1), column), F.lit(False)) if groups else F.lit(False)
    places = F.when(is_end, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("x")), F.struct(F.when(F.col("bucket") == last, 0).otherwise(F.col("bucket") + 1).alias("b"), F.lit(1).alias("x"))))
    if not ends:  # ids are all null: the first of them follows the last
        places = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("x")), F.struct(F.col("bucket").alias("b"), F.lit(1).alias("x")))
    dealt = (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), bucket.cast("int").alias("bucket"))
        .withColumn("place", F.explode(F.coalesce(places, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("x"))))))
        .select("doc_id", "text", F.col("place.b").alias("bucket"), F.col("place.x").alias("extra"))
    )
    shuffled = dealt.repartition(max(1, len(ends)), "bucket")
    return shuffled.sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def edited_neighbours(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = 1000, ranks: np.ndarray | None = None) -> DataFrame:
    """For each row its digest, that of its edited text (the last third of its code points replaced by the first as
    many of the next row's, by descending id), and how alike the digest is to the edited text's and to the next row's:
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One shuffle of the texts; a task holds two texts at a time. A null text is empty; a null id comes after all others;
    equal ids are in the order of their texts' hashes; a single row is its own successor.
    """
    ranks = rarity_ranks(docs, text=text) if ranks is None else ranks
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (bucket, id, fingerprint) that waits for its successor
        for batch in batches:
            ids, buckets, extras, at = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
            for texts in _portions(batch.column(1)):
                pairs, owners = [], []
                for i, now in enumerate(fingerprint_each(texts, ranks), at):
                    if held is not None and held[0] == buckets[i]:
                        pairs.append((held[2], now))
                        owners.append(held[1])
                        held = None if extras[i] else (buckets[i], ids[i].as_py(), now)
                    elif not extras[i]:  # else a further copy of what follows a bucket
                        held = (buckets[i], ids[i].as_py(), now)
                at += len(texts)
                rows = [
                    (len(was.text), hashlib.sha256(edited.raw).hexdigest(), was.digest, edited.digest, likeness(was.packed, edited.packed), likeness(was.packed, now.packed))
                    for (was, now), edited in zip(pairs, edit_each(pairs, ranks), strict=True)
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(owners, ids.type), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return in_order_of_ids(docs, doc_id=doc_id, text=text, rows_per_bucket=rows_per_bucket).mapInArrow(run, schema)
