"""Secret scanning through trigram postings.

Each rule's expression is parsed, and from its tree a Boolean query over trigrams is derived that every match must
satisfy. Documents are taken in segments; a segment's inverted index holds postings of the trigrams that any query
names, the queries are answered by intersecting and uniting postings, and only what they leave is verified with the
expression itself. A rule from which no trigram follows is matched against every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and non-overlapping; then those whose ``group`` has under ``least`` characters go."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 1


#: The three base kinds, in the order that breaks ties.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a whole run or nothing, as [0-9a-f]+ with 16 characters at least
)
#: Publicly documented token formats.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

# A query is ("all",) - no condition -, ("none",), ("has", trigram), ("and", ...) or ("or", ...).
ALL: tuple = ("all",)
NONE: tuple = ("none",)


def both(*parts: tuple) -> tuple:
    flat = {q for p in parts for q in (p[1:] if p[0] == "and" else (p,))} - {ALL}
    return NONE if NONE in flat else ALL if not flat else flat.pop() if len(flat) == 1 else ("and", *sorted(flat, key=repr))


def either(*parts: tuple) -> tuple:
    flat = {q for p in parts for q in (p[1:] if p[0] == "or" else (p,))} - {NONE}
    terms = {q: set(q[1:]) if q[0] == "and" else {q} for q in flat}
    flat -= {q for q in flat if any(terms[o] < terms[q] for o in flat)}  # asks more than another that suffices
    return ALL if ALL in flat else NONE if not flat else flat.pop() if len(flat) == 1 else ("or", *sorted(flat, key=repr))


def _trigrams(literals: frozenset[bytes]) -> tuple:
    """One of the literals occurs; those under three bytes say nothing."""
    return either(*[both(*[("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in literals])


@dataclass
class _Info:
    """What is known of the texts a node matches: all of them (``exact``), or how they begin and end, and a query."""

    exact: frozenset[bytes] | None
    starts: frozenset[bytes] = frozenset([b""])
    ends: frozenset[bytes] = frozenset([b""])
    query: tuple = field(default=ALL)


_MOST = 64


def _inexact(x: _Info) -> _Info:
    if x.exact is None:
        return x
    return _Info(None, frozenset(s[:2] for s in x.exact), frozenset(s[-2:] for s in x.exact), _trigrams(x.exact))


def _concat(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= _MOST:
        return _Info(frozenset(a + b for a in x.exact for b in y.exact))
    ends = x.exact if x.exact is not None else x.ends
    starts = y.exact if y.exact is not None else y.starts
    over = ALL
    if len(ends) * len(starts) <= _MOST * 4:
        over = _trigrams(frozenset(a[-2:] + b[:2] for a in ends for b in starts))
    begin = frozenset((a + b)[:2] for a in x.exact for b in starts) if x.exact is not None else x.starts
    finish = frozenset((a + b)[-2:] for a in ends for b in y.exact) if y.exact is not None else y.ends
    few = lambda s: s if len(s) <= _MOST else frozenset([b""])
    return _Info(None, few(begin), few(finish), both(_inexact(x).query, _inexact(y).query, over))


def _alternate(parts: list[_Info]) -> _Info:
    if all(p.exact is not None for p in parts) and len(union := frozenset().union(*[p.exact for p in parts])) <= _MOST:
        return _Info(union)
    parts = [_inexact(p) for p in parts]
    return _Info(None, frozenset().union(*[p.starts for p in parts]), frozenset().union(*[p.ends for p in parts]), either(*[p.query for p in parts]))


def _fold(code: int) -> bytes:
    return chr(code).encode("utf-8", "surrogatepass").lower()


def _walk(nodes) -> _Info:
    out = _Info(frozenset([b""]))
    for op, arg in nodes:
        if op is sre.LITERAL:
            # a non-ASCII letter may have case variants that bytes do not show
            node = _Info(frozenset([_fold(arg)])) if arg < 128 else _Info(None)
        elif op is sre.IN:
            codes: set[int] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    codes.add(x)
                elif kind is sre.RANGE and x[1] - x[0] < _MOST:
                    codes.update(range(x[0], x[1] + 1))
                else:
                    codes.update(range(256))
            small = len(codes) <= 16 and all(c < 128 for c in codes)
            node = _Info(frozenset(_fold(c) for c in codes)) if small else _Info(None)
        elif op is sre.SUBPATTERN:
            node = _walk(arg[-1]) if not arg[1] and not arg[2] else _Info(None)
        elif op is sre.BRANCH:
            node = _alternate([_walk(x) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            one = _walk(body)
            if low == 0 and high == 1:
                node = _alternate([one, _Info(frozenset([b""]))])
            elif low == 0:
                node = _Info(None)
            else:
                node = one
                for _ in range(min(low, 4) - 1):
                    node = _concat(node, one)
                if high != low or low > 4:
                    node = _concat(_inexact(node), _Info(None))
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue  # of no width; to ask less of a text is safe
        else:
            node = _Info(None)
        out = _concat(out, node)
    return out


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """The Boolean query, over ASCII-lower-cased bytes, that any text with a match of ``pattern`` satisfies."""
    return _inexact(_walk(sre_parser.parse(pattern, flags))).query


def _named(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*[_named(q) for q in query[1:]]) if query[0] in ("and", "or") else set()


class Segment:
    """Postings of the wanted trigrams over some texts, as sorted arrays of row numbers."""

    def __init__(self, texts: list[str], wanted: list[bytes]):
        self.n = len(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        joined = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8) if raw else np.zeros(0, dtype=np.uint8)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        low = lower[joined].astype(np.uint32)
        number = np.zeros(1 << 24, dtype=np.uint8 if len(wanted) < 256 else np.uint32)
        for i, g in enumerate(wanted, 1):
            number[g[0] << 16 | g[1] << 8 | g[2]] = i
        hit = number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else number[:0]
        at = np.flatnonzero(hit)
        rows, which = np.searchsorted(ends, at, side="right"), hit[at]
        self.postings = {g: np.unique(rows[which == i]) for i, g in enumerate(wanted, 1)}

    def rows(self, query: tuple) -> np.ndarray:
        """Row numbers that satisfy a query."""
        if query[0] == "has":
            return self.postings[query[1]]
        if query[0] in ("all", "none"):
            return np.arange(self.n if query == ALL else 0)
        found = sorted((self.rows(q) for q in query[1:]), key=len)
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


def _spans(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, segment_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end)) for every row, by start, then in the order of ``rules``; offsets
    are code points, ends exclusive. A null or empty text has no spans; repeated rows repeat; a text longer than a
    segment is a segment of its own, never cut."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        queries = [trigram_query(r.pattern, r.flags) for r in rules]
        wanted = sorted(set().union(*map(_named, queries)))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans: list[list] = [[] for _ in texts]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= segment_chars):
                    size += len(texts[end])
                    end += 1
                segment = Segment(texts[begin:end], wanted)
                for rank, (rule, rx, query) in enumerate(zip(rules, compiled, queries, strict=True)):
                    for i in segment.rows(query).tolist():
                        if found := _spans(rule, rx, texts[begin + i]):
                            spans[begin + i] += [(a, rank, b) for a, b in found]
                begin = end
            rows = [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow)], names=["doc_id", "spans"])

    return docs.select(doc_id, text).mapInArrow(run, schema)


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
