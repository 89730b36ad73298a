"""Jaccard join on word n-grams as a blocked, sparse product of the document by n-gram incidence with itself.

Two sets of given sizes that link differ in a bounded number of n-grams. So the columns of the incidence are dealt into
more blocks than that, by their hashes: in some of its blocks a document then has the very n-grams of any other that it
links with, and the bound tells how many blocks these are at least. Blocks that hold the same n-grams are counted for
each pair; a pair with fewer than its bound is discarded, and only for the others are overlaps accumulated, range by
range of n-grams, until a pair is sure to stay below what its sizes ask for, or has been counted to the end. Between the
two, pairs go whose 512-bit parity sketches differ in more bits than sets of their sizes may differ in n-grams: each
n-gram that only one has flips one bit.

A group of many copies never gives all its pairs: blocks are first paired with their best document alone, and two others
only while they are not known to be connected. No link between documents that are not otherwise connected is lost.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.memory import give_back
from colloquy.session import cut, materialise

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.ones(256, dtype=bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
#: A random number for each byte, and powers of an odd number for its place in a word.
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0xD1342543DE82EF95


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


_PLACE = _powers(4096)


def _word_hashes(raw: bytes, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``raw`` with A-Z lowered, and how many of them begin before each mark."""
    data = np.frombuffer(raw, dtype=np.uint8)
    ink = _INK[data]
    edge = np.flatnonzero(np.diff(ink.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    if len(begin) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(marks), dtype=np.int64)
    length = end - begin
    at = np.cumsum(length) - length
    place = np.arange(at[-1] + length[-1], dtype=np.int32) - np.repeat(at, length).astype(np.int32)
    powers = _PLACE if length.max() <= len(_PLACE) else _powers(int(length.max()))
    values = _BYTE[_LOWER[data[ink]]] * powers[place]
    return _mixed(np.add.reduceat(values, at) + length.astype(np.uint64)), np.searchsorted(begin, marks)


def word_hashes_of_each(texts: list[str], chunk: int = 262_144) -> list[np.ndarray]:
    """Word hashes of each text. Short texts are worked on together, a long one in parts that end at white space."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held, size = [], 0

    def flush() -> None:
        marks = np.cumsum([0] + [len(r) + 1 for _, r in held])
        words, upto = _word_hashes(b" ".join(r for _, r in held) + b" ", marks)
        for (i, _), a, b in zip(held, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            out[i].append(words[a:b])
        held.clear()

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        while len(raw) > 2 * chunk:
            stop = max(raw.rfind(x, 0, chunk) for x in (b" ", b"\n", b"\t"))
            if stop <= 0:
                stop = min((p for x in (b" ", b"\n", b"\t") if (p := raw.find(x, chunk)) >= 0), default=len(raw))
            held.append((i, raw[:stop]))
            flush()
            raw = raw[stop:]
        held.append((i, raw))
        size += len(raw)
        if size >= chunk:
            flush()
            size = 0
    if held:
        flush()
    return [np.concatenate(x) if len(x) > 1 else x[0] for x in out]


def _weights(k: int) -> np.ndarray:
    return np.array([pow(0xA0761D6478BD642F, 2 * j + 1, 1 << 64) | 1 for j in range(k)], dtype=np.uint64)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; fewer words are one run; none, an empty set."""
    if len(words) == 0:
        return words
    m = min(k, len(words))
    runs = np.full(len(words) - m + 1, m, dtype=np.uint64)
    for j, w in enumerate(_weights(m)):
        runs += words[j : len(words) - m + 1 + j] * w
    return np.unique(_mixed(runs))


def _portions(texts: Iterable[str], most_chars: int = 500_000) -> Iterator[list[str]]:
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sets(texts: Iterable[str], k: int) -> Iterator[np.ndarray]:
    for part in _portions(texts):
        for words in word_hashes_of_each(part):
            yield shingle_set(words, k)


def _node(found: np.ndarray) -> int:
    """An identity for a set: equal sets, equal numbers. Two sums of hashes are folded into 64 bits."""
    a, b = found.sum(dtype=np.uint64), (found * _M1 ^ found >> np.uint64(29)).sum(dtype=np.uint64)
    folded = (int(a) ^ int(b) * int(_M2) + len(found)) & 0xFFFFFFFFFFFFFFFF
    return int(_mixed(np.array([folded], dtype=np.uint64)).view(np.int64)[0])


#: Columns of a set's parity sketch.
PARITY = tuple(f"s{i}" for i in range(8))


def _parity(found: np.ndarray) -> np.ndarray:
    """Bit i tells whether the number of n-grams that fall on i is odd."""
    bits = 64 * len(PARITY)
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


class Blocks:
    """How the columns are dealt into blocks, by classes of set sizes.

    A pair counts under the class of its larger set, of sizes ``low`` to ``high``: it differs in ``most`` n-grams at most,
    so of ``most + 1 + spare`` blocks at least ``1 + spare`` are the same in both. A block of ``weak`` n-grams or fewer
    says little. Documents leave theirs out, unless they have more than ``spare`` of them: then they give all, empty ones
    too, and any two such documents meet in those. So ``spare`` goes by the least set that may be paired under the class,
    not by the least of the class."""

    RATIO = 1.5
    MOST = 1 << 44  # no text has more n-grams

    def __init__(self, percent: int):
        self.percent, self.low, self.plan = percent, [1], []
        while self.low[-1] < self.MOST:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * self.RATIO)))
            self.plan.append(self._planned(self.low[-2], self.low[-1] - 1))

    def _planned(self, low: int, high: int) -> tuple[int, int, int]:
        """(blocks, spare, weak) of a class; no blocks where only equal sets link."""
        most = (100 - self.percent) * 2 * high // (100 + self.percent)
        if most == 0:
            return 0, 0, 0
        least = -(-low * self.percent // 100)
        for weak in (1, 0):
            spare = 0
            for _ in range(30):
                blocks = most + 1 + spare
                fill = least / blocks
                share = np.exp(-fill) * (1 + fill * weak)
                deviation = np.sqrt(blocks * max(0.0, share * (1 - share) - fill ** (1 + 2 * weak) * np.exp(-2 * fill)))
                spare, was = int(np.ceil(blocks * share + 3 * deviation + 1)), spare
                if spare == was or spare > most + 8:
                    break
            if spare <= max(4, most * 0.35):
                break
        spare = min(spare, most + 8)
        return most + 1 + spare, spare, weak

    def first(self, n: int) -> int:
        return bisect_right(self.low, n) - 1

    def classes(self, n: int) -> range:
        """Those that a set of n may be paired under: its own, and those of larger sets that it could link with."""
        first = last = self.first(n)
        while self.low[last + 1] * self.percent <= n * 100:
            last += 1
        return range(first, last + 1)

    def signatures(self, found: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Of a sorted set: how many equal blocks a pair under each of its classes has at least as far as this set tells,
        or the negative of how many two sets have that leave out none of theirs, as this one does; and the hashes of its
        blocks, the class in the upper byte."""
        slack, out = [], []
        for c in self.classes(len(found)) if len(found) else ():
            blocks, spare, weak = self.plan[c]
            if blocks == 0:
                slack.append(1)
                continue
            at = (found >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)  # in order, as the set is
            size = np.bincount(at.astype(np.int64), minlength=blocks)
            sums, there = np.zeros(blocks, dtype=np.uint64), np.flatnonzero(size)
            sums[there] = np.add.reduceat(found, (np.cumsum(size) - size)[there])
            number = np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            # blocks equal by chance only add to what is counted, and 40 bits take less room
            hashes = _mixed(sums + number) >> np.uint64(24) | np.uint64(c << 56)
            little = size <= weak
            few = int(little.sum())
            slack.append(spare + 1 - few if few <= spare else -spare - 1)
            out.append(hashes[~little] if few <= spare else hashes)
        return slack, np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _packed(sig: np.ndarray, node: np.ndarray) -> bytes:
    """Entries of some blocks: signatures in order as differences, where their documents stand in a list, and the list
    as differences, each as planes of bytes, most of which are then zero, compressed."""
    import zstandard

    order = np.argsort(sig)
    names, at = np.unique(node[order], return_inverse=True)
    planes = lambda x: x.view(np.uint8).reshape(len(x), -1).T.tobytes()
    steps = lambda x: np.diff(x, prepend=np.uint64(0))
    parts = (planes(steps(sig[order])), planes(at.astype("<u4")), planes(steps(names.view(np.uint64))))
    return struct.pack("<II", len(sig), len(names)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, m = struct.unpack_from("<II", data)
    data = zstandard.ZstdDecompressor().decompress(data[8:])
    plane = lambda offset, width, k: np.frombuffer(data, np.uint8, k * width, offset).reshape(width, k).T.copy()
    sig, names = (np.cumsum(plane(offset, 8, k).view("<u8").ravel(), dtype=np.uint64) for offset, k in ((0, n), (12 * n, m)))
    return sig, names.view(np.int64)[plane(8 * n, 4, n).view("<u4").ravel()]


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Texts go to Python so many rows at a time: what JVM and Python hold of them stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def incidence(docs: DataFrame, *, k: int, percent: int, parts: int, most_entries: int = 500_000) -> DataFrame:
    """Of (doc_id, text): rows (doc_id, text_hash, n, node, kind, slack, signatures, s0..s7) of documents with their
    set's size, identity and parity sketch, and rows (part, entries) with the signatures of all blocks in parts by hash. Equal sets in one task
    give their entries once, so that copies are brought together before anything is shuffled."""
    fields = [("n", "bigint"), ("node", "bigint"), ("kind", "int"), ("slack", "array<int>"), ("signatures", "int"), *[(c, "bigint") for c in PARITY], ("part", "int"), ("entries", "binary")]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), *[T.StructField(c, T._parse_datatype_string(t)) for c, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen, held, size = Blocks(percent), set(), [], 0

        def entries(doc_id: pa.DataType) -> Iterator[pa.RecordBatch]:
            sig, node = np.concatenate([s for _, s in held]), np.repeat(np.array([n for n, _ in held], dtype=np.int64), [len(s) for _, s in held])
            part = (_mixed(sig) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            sig, node, part = sig[order], node[order], part[order]
            there, begin = np.unique(part, return_index=True)
            end = np.append(begin[1:], len(part))
            for i in range(0, len(there), 64):
                blobs = [_packed(sig[a:b], node[a:b]) for a, b in zip(begin[i : i + 64].tolist(), end[i : i + 64].tolist(), strict=True)]
                none = [pa.nulls(len(blobs), t) for t in (doc_id, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), *[pa.int64()] * len(PARITY))]
                yield pa.RecordBatch.from_arrays([*none, pa.array(there[i : i + 64], pa.int32()), pa.array(blobs, pa.binary())], names=schema.names)

        for batch in batches:
            sizes, nodes, firsts, slacks, counts, parities = [], [], [], [], [], []
            for found in _sets((x.as_py() or "" for x in batch.column(1)), k):
                node = _node(found) if len(found) else 0
                slack, sig = plan.signatures(found)
                sizes.append(len(found))
                nodes.append(node)
                firsts.append(plan.first(len(found)) if len(found) else 0)
                slacks.append(slack)
                counts.append(len(sig))
                parities.append(_parity(found))
                if len(sig) and node not in seen:
                    seen.add(node)
                    held.append((node, sig))
                    size += len(sig)
            kinds = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(firsts, pa.int32()), pa.array(slacks, pa.list_(pa.int32())), pa.array(counts, pa.int32())]
            bits = np.array(parities, dtype=np.int64).reshape(len(parities), len(PARITY))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *kinds, *[pa.array(bits[:, i]) for i in range(len(PARITY))], pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=schema.names)
            if size >= most_entries:
                yield from entries(batch.column(0).type)
                held, size = [], 0
        if held:
            yield from entries(batch.column(0).type)
        give_back()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


class _Meeting:
    """Entries of one part as they come: those whose signature has been seen with another node. Of each signature only
    its first node is kept, so that a signature of very many documents takes no more room than any other."""

    def __init__(self):
        self.sig, self.node, self.out = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def meet(self, sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sig, node = np.concatenate([self.sig, sig]), np.concatenate([self.node, node])
        old = np.arange(len(sig)) < len(self.sig)
        out = np.append(self.out, np.zeros(len(sig) - len(self.out), bool))
        order = np.lexsort((node, ~old, sig))
        sig, node, old, out = sig[order], node[order], old[order], out[order]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node, old, out = sig[fresh], node[fresh], old[fresh], out[fresh]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(sig)))
        several = np.minimum.reduceat(node, begin) != np.maximum.reduceat(node, begin) if len(begin) else np.zeros(0, bool)
        told = several | out[begin]
        give = np.repeat(told, count) & ~out
        self.sig, self.node, self.out = sig[begin], node[begin], told
        return sig[give], node[give]


def shared_blocks(entries: DataFrame, *, most_entries: int = 1_000_000) -> DataFrame:
    """(sig, node) of the blocks that more than one node has; from ``entries`` (part, entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, size = None, _Meeting(), [], 0

        def met() -> Iterator[pa.RecordBatch]:
            sig, node = state.meet(np.concatenate([s for s, _ in held]), np.concatenate([n for _, n in held]))
            for i in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[i : i + 100_000].view(np.int64)), pa.array(node[i : i + 100_000])], names=["sig", "node"])

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (part != now or size >= most_entries):
                    yield from met()
                    held, size = [], 0
                if part != now:
                    now, state = part, _Meeting()
                held.append(_unpacked(data.as_py()))
                size += len(held[-1][0])
        if held:
            yield from met()
        give_back()

    return entries.select("part", "entries").repartition("part").sortWithinPartitions("part").mapInArrow(run, "sig bigint, node bigint")


def _could_link(x: str, y: str, percent: int) -> Column:
    """Whether two sets are near enough in size."""
    return F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent


def _may_differ(x: str, y: str, percent: int) -> Column:
    """Whether two sets' sketches differ in no more bits than sets of their sizes that link may in n-grams."""
    bits = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITY), F.lit(0))
    return bits * (100 + percent) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - percent)


def _need(x: str, y: str) -> Column:
    """How many equal blocks a pair has at least. Negative numbers are of sets that give all their blocks."""
    more = F.greatest(f"{x}.slack", f"{y}.slack")
    return F.when(more > 0, more).otherwise(-more)


def _texts(docs: DataFrame, wanted: DataFrame, broadcast_docs: int) -> DataFrame:
    """(node, packed) of the ``wanted`` (node, rep: the doc_id and text_hash of one of its rows): texts, compressed."""
    names = wanted.select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash"))
    names = _small(names, broadcast_docs)
    rows = docs.join(names, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = [squeeze.compress(x.as_py().encode("utf-8", "surrogatepass")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "packed"])
        give_back()

    # rows that repeat in every respect give a text more than once
    return materialise(rows.mapInArrow(run, "node bigint, packed binary").groupBy("node").agg(F.first("packed").alias("packed")), "ngram-texts")


def overlaps(head: np.ndarray, sets: list[np.ndarray], percent: int, ranges: int = 8) -> np.ndarray:
    """Which of the ``sets`` link with ``head``: a row of the incidence times a block of others. Counts are accumulated
    range by range of n-grams, and a set is discarded once what is left cannot bring it to what its size asks for."""
    size = np.array([len(s) for s in sets])
    need = -(-percent * (len(head) + size) // (100 + percent))
    edges = [np.uint64((r << 64) // ranges) for r in range(1, ranges)]
    cuts = np.array([[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]).reshape(len(sets), ranges + 1)
    own = [0, *np.searchsorted(head, edges).tolist(), len(head)]
    count, alive = np.zeros(len(sets), dtype=np.int64), np.flatnonzero(np.minimum(size, len(head)) >= need)
    for r in range(ranges):
        part = head[own[r] : own[r + 1]]
        if len(alive) and len(part):
            grams = np.concatenate([sets[i][cuts[i, r] : cuts[i, r + 1]] for i in alive.tolist()])
            owner = np.repeat(alive, cuts[alive, r + 1] - cuts[alive, r])
            at = np.searchsorted(part, grams)
            at[at == len(part)] = 0
            count += np.bincount(owner[part[at] == grams], minlength=len(sets))
        left = np.minimum(len(head) - own[r + 1], size - cuts[:, r + 1])
        alive = alive[count[alive] + left[alive] >= need[alive]]
    linked = np.zeros(len(sets), dtype=bool)
    linked[alive] = True
    return linked


def verify(pairs: DataFrame, texts: DataFrame, *, k: int, percent: int, broadcast_docs: int, block: int = 256) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are alike; ``texts`` (node, packed) has both. The pairs of one a are dealt out
    in blocks, each with a copy of a's text; a task holds a's set and some of the others at a time."""
    per_a = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = _small(pairs, broadcast_docs).join(texts.withColumnRenamed("node", "b"), "b").join(_small(per_a, broadcast_docs), "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("blk"), "b", "packed")
    heads = _small(per_a, broadcast_docs).join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), F.lit(None).cast("long").alias("b"), "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loosen, key, head, held, size = zstandard.ZstdDecompressor(), None, None, [], 0

        def linked() -> list[tuple[int, int]]:
            found = overlaps(head, [s for _, s in held], percent)
            return [(key[0], b) for (b, _), yes in zip(held, found.tolist(), strict=True) if yes]

        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(3)]
            at = 0
            for texts in _portions(loosen.decompress(x.as_py()).decode("utf-8", "surrogatepass") for x in batch.column(3)):
                for i, found in enumerate(_sets(texts, k), at):
                    a, blk, b = (c[i] for c in columns)
                    if b is None or size >= 1_000_000:
                        out += linked() if held else []
                        held, size = [], 0
                    if b is None:
                        key, head = (a, blk), found
                        continue
                    if key != (a, blk):
                        raise ValueError("a block without its head")
                    held.append((b, found))
                    size += len(found)
                at += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if held:
            out = linked()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        give_back()

    dealt = heads.unionByName(members).repartition("a", "blk").sortWithinPartitions("a", "blk", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, broadcast_docs: int = 100_000, salts: int = 32) -> DataFrame:
    """(node, label) of every end of ``links`` (a, b): the least node that links lead to. Each round takes the least
    label among neighbours and then that label's own; it ends when nothing changes. Labels are broadcast while they are
    few; beyond, the labels of labels are copied ``salts`` times, so that a label of very many nodes is dealt out."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    few = labels.count() <= broadcast_docs
    spread = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
    while True:
        known = labels.select(F.col("node").alias("_b"), "label")
        near = both.join(F.broadcast(known) if few else known, both["b"] == known["_b"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(F.broadcast(near) if few else near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("_to"), F.col("label").alias("_far"))
        if few:
            new = stepped.join(F.broadcast(far), stepped["label"] == far["_to"], "left")
        else:
            far = far.join(stepped.select(F.col("label").alias("_to")).distinct(), "_to", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            stepped = stepped.withColumn("_own", spread)
            new = stepped.join(far, (stepped["label"] == far["_to"]) & (stepped["_own"] == far["_salt"]), "left")
        new = cut(new.select("node", "old", F.least("label", "_far").alias("label")))
        labels = new.select("node", "label")
        if new.filter("label < old").isEmpty():
            return labels


def _small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast where it has so many rows at most; ``df`` is a written table, so counting is cheap."""
    return F.broadcast(df) if df.count() <= most else df


def _labelled(rows: DataFrame, labels: DataFrame | None, broadcast_docs: int) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    known = _small(labels.select(F.col("node").alias("_n"), F.col("label").alias("_label")), broadcast_docs)
    return rows.join(known, rows["node"] == known["_n"], "left").withColumn("label", F.coalesce("_label", "node")).drop("_n", "_label")


def similarity_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, rounds: int = 2, broadcast_docs: int = 100_000, docs_per_part: int = 2000, crowd: int = 64
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the size of its set of distinct k-word runs, and the least
    doc_id that links lead to, itself included. Two rows link when 100 * shared >= percent * united.

    Words are runs of anything but ASCII white space, A-Z lowered; a text with fewer than k words is one run; a null
    text, or one without words, has an empty set and links with nothing, not even its like. Rows of equal sets are one
    node. Null ids: the row takes part, and a component of such rows alone has a null id; equal ids may be in several
    components. An empty table gives an empty result; other columns of ``docs`` play no part. Sets are told apart by
    64-bit hashes. ``rounds``: how often blocks are paired with a best document before the rest; tables of up to
    ``broadcast_docs`` rows of a few numbers are broadcast; blocks that more than ``crowd`` unconnected documents share
    are left to documents that have too few others. None of these changes results.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = max(16, min(1 << 20, docs.count() // docs_per_part))
    spark = docs.sparkSession
    with _batches_of(spark, 1000):
        written = materialise(incidence(docs, k=k, percent=percent, parts=parts), "ngram-incidence")
    rows = written.filter("part IS NULL").select("doc_id", "text_hash", "n", "node", "kind", "slack", "signatures", *PARITY)
    met = materialise(shared_blocks(written.filter("part IS NOT NULL")), "ngram-blocks")
    # one node for each distinct set that shares a block
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), *[F.first(c).alias(c) for c in ("n", "kind", "slack", "signatures", *PARITY)])
    class_of = F.shiftrightunsigned("sig", 56).cast("int")
    per_class = met.groupBy("node", class_of.alias("class")).agg(F.count("*").alias("commons"))
    # a pair has as many equal blocks as either of its sets tells: a set that shares fewer with all others has no link
    told = F.element_at("slack", F.col("class") - F.col("kind") + 1)
    info = nodes.join(per_class, "node").withColumn("slack", told).filter(F.col("commons") >= F.greatest("slack", F.lit(1)))
    info = materialise(info.select("node", "rep", "n", "class", "slack", (F.col("commons") / F.col("signatures")).alias("share"), *PARITY), "ngram-nodes")
    about = info.select(F.col("node").alias("_node"), F.col("class").alias("_class"), "n", "slack", "share")
    blocks = met.join(_small(about, broadcast_docs), (met["node"] == F.col("_node")) & (class_of == F.col("_class"))).select("sig", "node", "n", "slack", "share")
    # a block's head is the document that shares most of its blocks with others: what copies are copies of
    best = F.max(F.struct("share", "n", "node", "slack")).over(W.partitionBy("sig"))
    blocks = materialise(blocks.withColumn("h", best).select("sig", "node", "n", "slack", "share", "h"), "ngram-headed")
    single = info.withColumn("first", F.min("class").over(W.partitionBy("node"))).filter("class = first")
    sketches = materialise(single.select("node", "rep", "n", *PARITY), "ngram-sketches")
    with _batches_of(spark, 1000):
        texts = _texts(docs, sketches.select("node", "rep"), broadcast_docs)

    links: DataFrame | None = None
    labels: DataFrame | None = None

    def link(pairs: DataFrame) -> None:
        """Accumulates the overlaps of pairs (a, b) and takes in what links."""
        nonlocal links, labels
        few = _small(sketches.drop("rep"), broadcast_docs)
        pairs = cut(pairs.join(few.alias("p"), F.col("a") == F.col("p.node")).join(few.alias("q"), F.col("b") == F.col("q.node")).filter(_may_differ("p", "q", percent)).select("a", "b"))
        if pairs.isEmpty():
            return
        with _batches_of(spark, 1000):
            found = cut(verify(pairs, texts, k=k, percent=percent, broadcast_docs=broadcast_docs))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links, broadcast_docs)

    def stars(heads: DataFrame) -> DataFrame:
        """For each node the head with which it has most equal blocks, if they are half of what a link takes."""
        near = heads.filter("node <> h.node").select("node", "h", F.struct("n", "slack").alias("x")).filter(_could_link("x", "h", percent))
        counted = near.select(F.col("h.node").alias("a"), F.col("node").alias("b"), _need("x", "h").alias("need")).repartition("b").groupBy("b", "a").agg(F.count("*").alias("c"), F.min("need").alias("need"))
        return counted.filter("2 * c >= need").groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select("m.a", "b")

    link(stars(blocks))
    # then, in blocks that hold more than one component, with the best of those not connected to the head
    live = blocks
    for done in range(1, rounds + 1):
        marked = _labelled(live.select("sig", "node", "n", "slack", "share", "h"), labels, broadcast_docs)
        by_sig = W.partitionBy("sig")
        own = F.max(F.when(F.col("node") == F.col("h.node"), F.col("label"))).over(by_sig)
        marked = marked.withColumn("own", own).withColumn("hi", F.max("label").over(by_sig)).withColumn("lo", F.min("label").over(by_sig))
        live = materialise(marked.filter("lo <> hi").select("sig", "node", "n", "slack", "share", "h", "label", (F.col("label") != F.col("own")).alias("out")), "ngram-live")
        if live.isEmpty() or done == rounds:
            break
        second = F.max(F.when(F.col("out"), F.struct("share", "n", "node", "slack", "label"))).over(by_sig)
        tried = live.withColumn("g", second).filter("label <> g.label").select("node", "n", "slack", F.col("g").alias("h"))
        link(stars(tried))
    # and last every pair of components in such a block, for documents that have too few blocks without a crowd
    crowded = F.sum(F.col("out").cast("int")).over(W.partitionBy("sig")) > crowd
    seen = live.withColumn("crowded", crowded).select("sig", "node", "n", "slack", "label", "out", "crowded", F.shiftrightunsigned("sig", 56).alias("class"))
    in_crowds = F.sum(F.col("crowded").cast("int")).over(W.partitionBy("node", "class"))
    seen = seen.withColumn("crowds", in_crowds).filter("NOT crowded OR crowds >= greatest(slack, 1)").withColumn("left_out", F.when(F.col("crowds") < F.greatest("slack", F.lit(1)), F.col("crowds")).otherwise(0))
    seen = materialise(seen.join(_small(sketches.select(F.col("node").alias("_node"), *PARITY), broadcast_docs), seen["node"] == F.col("_node")).drop("_node"), "ngram-rest")
    # sizes and sketches are conditions of the join itself: it gives no pair that they rule out
    x, y = seen.filter("out").alias("x"), seen.alias("y")
    apart = F.expr("x.label <> y.label AND (NOT y.out OR x.node < y.node)")
    counted = (
        x.join(y, (F.col("x.sig") == F.col("y.sig")) & apart & _could_link("x", "y", percent) & _may_differ("x", "y", percent))
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.col("x.class").alias("class"), _need("x", "y").alias("need"), F.greatest("x.left_out", "y.left_out").alias("left_out"))
        .groupBy("a", "b", "class")
        .agg(F.count("*").alias("c"), F.max("need").alias("need"), F.max("left_out").alias("left_out"))
    )
    link(counted.filter("c + left_out >= need").select("a", "b").distinct())

    # nodes of several rows, and those that links lead from, have a component to look up
    least = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    if labels is None:
        shared = least.filter("rows > 1").select(F.col("node").alias("_node"), F.col("least").alias("component_id"))
    else:
        ends = _small(labels.select(F.col("node").alias("_n"), "label"), broadcast_docs)
        known = cut(least.join(ends, least["node"] == ends["_n"], "left").filter("rows > 1 OR _n IS NOT NULL").select("node", "least", F.coalesce("label", "node").alias("label")))
        per_label = cut(known.groupBy("label").agg(F.min("least").alias("component_id")))
        shared = known.join(_small(per_label, broadcast_docs), "label").select(F.col("node").alias("_node"), "component_id")
    shared = cut(shared)
    return rows.join(_small(shared, broadcast_docs), (rows["node"] == F.col("_node")) & (rows["n"] > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
