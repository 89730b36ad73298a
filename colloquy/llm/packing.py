"""Packing token sequences by the sum-of-squares rule.

Documents are tokenized where they lie; only lengths are shuffled. A piece that fills a sequence needs no packing. The
others are dealt to shards of bounded size, and each shard is packed by itself: the next piece, longest first, goes
where the sum over all gaps of (number of open sequences with that gap) squared becomes smallest.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.memory import give_back
from colloquy.session import materialise

#: Splits only at what every Unicode-aware expression takes for white space.
_SPACE = re.compile(r"[\x09-\x0D\x20]+")
#: White space for str.split() alone.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Latin letters whose lower case is one letter and which are in composed form: such a word is one unit.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]+")
_SIGNS = frozenset(".,")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _PlainWords:
    """Ids of words of Latin letters by the same merges, on raw bytes. The last byte of a word, which carries the
    word-end mark, is written as a byte that no letter uses, so that plain byte merges keep the mark."""

    def __init__(self, model: dict, end_mark: str):
        import tiktoken

        letters = _byte_letters()
        last = {b: i for i, b in enumerate([*range(97, 123), *range(128, 192)])}
        inner = {*range(97, 123), *range(128, 248)}
        self.last = last

        def raw(token: str) -> bytes | None:
            ended = token.endswith(end_mark)
            got = [letters[x] for x in (token[: -len(end_mark)] if ended else token)]
            if not got or not inner.issuperset(got) or ended and got[-1] not in last:
                return None
            return bytes(got[:-1] + [last[got[-1]]]) if ended else bytes(got)

        ranks, self.ids = {bytes([b]): b for b in range(256)}, np.zeros(256 + len(model["merges"]), dtype="<u4")
        vocab = model["vocab"]
        for token, i in vocab.items():
            if (r := raw(token)) is not None and len(r) == 1:
                self.ids[r[0]] = i
        for n, merge in enumerate(model["merges"], 256):
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            if (r := raw(token)) is not None:
                ranks[r], self.ids[n] = n, vocab[token]
        self.raw = [x.tobytes() for x in self.ids]
        self.piece = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, word: str) -> bytes:
        raw = bytearray(word.encode())
        raw[-1] = self.last[raw[-1]]
        return b"".join(map(self.raw.__getitem__, self.piece(bytes(raw))))


class _Known(dict):
    """Ids by word, worked out where they are missing."""

    def __init__(self, tokenizer, plain: _PlainWords):
        self.tokenizer, self.plain = tokenizer, plain
        self.signs = {x: self.direct(x) for x in _SIGNS}

    def direct(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        sign = self.signs.get(word[-1])
        head = word if sign is None else word[:-1]
        if not _PLAIN.fullmatch(head):
            self[word] = out = self.direct(word)
            return out
        low = head.lower()
        out = self.get(low)
        if out is None:
            self[low] = out = self.plain.encode(low)
            return out if sign is None else out + sign
        if low is not word:  # a variant of a word seen before is kept too
            self[word] = out = out if sign is None else out + sign
        return out


class WordTokenizer:
    """Ids of a byte-pair tokenizer that lower-cases, drops white space and never joins across it, remembered by word.

    Words of Latin letters, with a full stop or comma or without, take their merges directly on bytes; any other word
    goes through the tokenizer itself.
    """

    def __init__(self, path: str, end_mark: str = "</w>", most_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.most = most_words
        with open(path, encoding="utf-8") as f:
            self.known = _Known(Tokenizer.from_file(path), _PlainWords(json.load(f)["model"], end_mark))

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        words = [x for x in _SPACE.split(text) if x] if any(s in text for s in _SEPARATORS) else text.split()
        if len(self.known) > self.most:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, words))

    def forget(self) -> None:
        """Drop the remembered words; the tokenizer itself stays."""
        self.known.clear()


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each path and worker process."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def tokenize_pieces(
    docs: DataFrame, *, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of at most ``capacity`` tokens of each row; a
    row's tokens are its text's ids and ``end_id``. A null or empty text is one piece of ``end_id`` alone. Repeated
    rows give repeated pieces; a null doc_id stays null."""
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    last = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path)
        for batch in batches:
            rows, piece, start, length, crc, out = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = tok.encode(text.as_py() or "") + last
                for n, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        out.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])
        tok.forget()  # else an idle worker holds its words while another stage runs
        give_back()

    return docs.select(doc_id, text).mapInArrow(run, T.StructType(fields))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, all from 1 to ``capacity`` - 1, placed longest first. Ties go to the
    smallest gap, so equal input gives equal output."""
    open_with: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (sequence, used)
    count = np.zeros(capacity + 1, dtype=np.int64)
    sequence, offset, n = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    closed = np.int64(1) << 40
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        # what the sum grows by: a new sequence, an exact fit, or a larger gap that shrinks
        best, gap = 2 * int(count[capacity - size]) + 1, 0
        if size + 1 <= capacity - 1:
            grow = 2 * (count[1 : capacity - size] - count[size + 1 : capacity]) + 2
            grow = np.where(count[size + 1 : capacity] > 0, grow, closed)
            j = int(grow.argmin())
            if grow[j] < best:
                best, gap = int(grow[j]), size + 1 + j
        if count[size] > 0 and 1 - 2 * int(count[size]) <= best:
            gap = size
        if gap:
            where, used = open_with[gap].pop()
            count[gap] -= 1
        else:
            where, used, gap, n = n, 0, capacity, n + 1
        sequence[i], offset[i] = where, used
        if gap > size:
            open_with[gap - size].append((where, used + size))
            count[gap - size] += 1
    return sequence, offset


def pack(pieces: DataFrame, *, capacity: int = 4096, shard_rows: int = 60_000, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    The number of shards follows the number of pieces, so a task's work is bounded and the loss (the last open
    sequences of a shard) is a constant share. Equal rows may trade places. An empty table gives an empty result.
    """
    pieces = materialise(pieces, "pieces")
    part = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_rows))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="_shard").sort_values(list(order), kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

    packed = part.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(shards))).groupBy("_shard").applyInPandas(place, schema)
    full = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
