"""Toxicity by a small bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding, if it is in the vocabulary, beside the sum of the embeddings of its character
n-grams. Two gated recurrent units read a window of words in either direction, attention pools their states, and a
logistic unit gives the window's logit. A text is scored by the highest of all its overlapping windows; training uses
the same maximum, as labels are of whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.memory import give_back

WINDOW, STRIDE = 48, 24
HIDDEN, ATTEND, WORD_DIM, CHAR_DIM = 8, 8, 8, 8
CHAR_BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all character n-grams, where each word's begin); a word is marked at both ends. Words have one
    n-gram at least: the marks and one letter are three bytes."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    length = np.array([len(r) for r in raw])
    end = np.repeat(np.cumsum(length), length)
    owner, bucket = [], []
    numbers = np.repeat(np.arange(len(words)), length)
    for n in GRAMS:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, dtype=np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | data[j : len(data) - n + 1 + j]
        inside = np.arange(len(code)) + n <= end[: len(code)]
        x = (code[inside] + np.uint64(n << 48)) * np.uint64(0x9E3779B97F4A7C15)
        bucket.append((x >> np.uint64(50)).astype(np.int64))
        owner.append(numbers[: len(code)][inside])
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words)))


def many_grams(words: list[str], portion: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """``char_grams`` of any number of words, in portions: buckets take two bytes, and what is worked out on the way to
    them, tens of times as much, is held for one portion alone."""
    buckets, begins, size = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], 0
    for i in range(0, len(words), portion):
        bucket, begin = char_grams(words[i : i + portion])
        buckets.append(bucket.astype(np.uint16))
        begins.append(begin + size)
        size += len(bucket)
    return np.concatenate(buckets), np.concatenate(begins)


@dataclass
class Model:
    """Weights; ``vocabulary`` numbers known words from 1, and 0 stands for none."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def new(vocabulary: dict[str, int], seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        put = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        p = {"words": put(len(vocabulary) + 1, WORD_DIM, s=0.05), "chars": put(CHAR_BUCKETS, CHAR_DIM, s=0.05)}
        p["words"][0] = 0
        for way in "fb":
            p |= {f"W{way}": put(d, 3 * HIDDEN), f"U{way}": put(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        return Model(vocabulary, p | {"A": put(2 * HIDDEN, ATTEND), "a0": np.zeros(ATTEND, np.float32), "v": put(ATTEND), "o": put(2 * HIDDEN), "o0": np.zeros(1, np.float32)})

    def embed(self, ids: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["words"][ids], np.add.reduceat(self.p["chars"][grams], begins, axis=0)], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _states(at: np.ndarray, inputs: np.ndarray, U: np.ndarray, reverse: bool, keep: list | None = None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction; ``inputs`` holds each word's projected input."""
    n, steps = at.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        x, y = inputs[at[:, t]], h @ U
        gates = _unit(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        fresh = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, fresh, y[:, 2 * HIDDEN :]))
        h = fresh + z * (h - fresh)
        out[t] = h
    return out


def _pool(both: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits, pooled states, attention and its hidden layer; ``both``: (time, window, 2 * HIDDEN)."""
    u = np.tanh(both @ p["A"] + p["a0"])
    e = np.where(mask, u @ p["v"], np.float32(-1e4))
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", w, both)
    return pooled @ p["o"] + p["o0"], pooled, w, u


def window_logits(at: np.ndarray, inputs_f: np.ndarray, inputs_b: np.ndarray, p: dict, most: int = 1024) -> np.ndarray:
    """Logit of each window (rows of word numbers; 0 is padding)."""
    out = []
    for i in range(0, len(at), most):
        part = at[i : i + most]
        both = np.concatenate([_states(part, inputs_f, p["Uf"], False), _states(part, inputs_b, p["Ub"], True)], axis=2)
        mask = part.T > 0
        mask[0] |= ~mask.any(axis=0)
        out.append(_pool(both, mask, p)[0])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def windows(n: int) -> list[int]:
    """Where the overlapping windows of n words begin: all words are in one, and the last ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _cut(ids: np.ndarray) -> np.ndarray:
    if len(ids) <= WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None]
    return np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[windows(len(ids))]


class Scorer:
    """Scores texts; keeps the projected inputs of words it has seen, up to a number of words."""

    def __init__(self, model: Model, most_words: int = 50_000):
        self.m, self.most = model, most_words
        self.numbers: dict[str, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.numbers.clear()
        pad = np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
        self.tables = [np.concatenate([pad @ self.m.p[f"W{w}"] + self.m.p[f"c{w}"], np.zeros((4096, 3 * HIDDEN), np.float32)]) for w in "fb"]

    def _learn(self, words: list[str]) -> None:
        grams, begins = char_grams(words)
        x = self.m.embed(np.array([self.m.vocabulary.get(w, 0) for w in words]), grams, begins)
        first = len(self.numbers) + 1
        need = first + len(words)
        for k, way in enumerate("fb"):
            if len(self.tables[k]) < need:
                self.tables[k] = np.concatenate([self.tables[k], np.zeros((max(need, 2 * len(self.tables[k])) - len(self.tables[k]), 3 * HIDDEN), np.float32)])
            self.tables[k][first:need] = x @ self.m.p[f"W{way}"] + self.m.p[f"c{way}"]
        self.numbers.update(zip(words, range(first, need), strict=True))

    def logits(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.numbers) > self.most:
            self._empty()
        known = self.numbers
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in known))
        if new:
            self._learn(new)
        cuts = [_cut(np.array([known[w] for w in ws], dtype=np.int32)) for ws in split]
        found = window_logits(np.concatenate(cuts), *self.tables, self.m.p)
        return np.maximum.reduceat(found, np.cumsum([0] + [len(c) for c in cuts[:-1]]))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities; a text without words says nothing and scores 0."""
        a, b = self.m.scale
        said = np.array([_WORD.search(t) is not None for t in texts])
        return np.where(said, 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts).astype(np.float64) * a + b, -30, 30))), 0.0)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of rows of ``values`` by where they go, in n rows."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        place = at[order]
        begins = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        out[place[begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


def _gradients(m: Model, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the mean logistic loss over windows ``at`` of inputs ``x``; of weights, of inputs, and logits."""
    p, g = m.p, {}
    n, mask = len(at), at.T > 0
    mask[0] |= ~mask.any(axis=0)
    kept: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([_states(at, x @ p[f"W{w}"] + p[f"c{w}"], p[f"U{w}"], w == "b", kept[w]) for w in "fb"], axis=2)
    logit, pooled, w, u = _pool(both, mask, p)
    d = ((_unit(logit) - y) / n).astype(np.float32)
    g["o"], g["o0"] = pooled.T @ d, np.array([d.sum()])
    dpool = d[:, None] * p["o"]
    dboth = w[:, :, None] * dpool[None]
    dw = np.einsum("tnh,nh->tn", both, dpool)
    de = w * (dw - (w * dw).sum(axis=0))
    du = de[:, :, None] * p["v"] * (1 - u * u)
    g["v"], g["A"], g["a0"] = np.einsum("tn,tna->a", de, u), np.einsum("tnh,tna->ha", both, du), du.sum(axis=(0, 1))
    dboth += du @ p["A"].T
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        U, dh = p[f"U{way}"], np.zeros((n, HIDDEN), np.float32)
        dU, steps = np.zeros_like(U), np.zeros((at.shape[1], n, 3 * HIDDEN), np.float32)
        for t, h, z, r, fresh, yn in reversed(kept[way]):
            dh = dh + dboth[t, :, k * HIDDEN : (k + 1) * HIDDEN]
            dn = dh * (1 - z) * (1 - fresh * fresh)
            dz, dr = dh * (h - fresh) * z * (1 - z), dn * yn * r * (1 - r)
            dy = np.concatenate([dz, dr, dn * r], axis=1)
            steps[t] = np.concatenate([dz, dr, dn], axis=1)
            dU += h.T @ dy
            dh = dh * z + dy @ U.T
        dproj = _summed(at.T.ravel(), steps.reshape(-1, 3 * HIDDEN), len(x))
        g[f"U{way}"], g[f"W{way}"], g[f"c{way}"] = dU, x.T @ dproj, dproj.sum(axis=0)
        dx += dproj @ p[f"W{way}"].T
    return g, dx, logit


def _log_odds(seen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a text being toxic for each row of ``seen``, the numbers of clean and toxic texts with it."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    odds = np.log((seen[:, 1] + 0.5) / (n1 + 1)) - np.log((seen[:, 0] + 0.5) / (n0 + 1))
    return np.where(seen.sum(axis=1) > 0, odds * np.minimum(1.0, seen.sum(axis=1) / 4), 0.0)


def _numbered(texts: Iterable[str]) -> tuple[list[str], list[np.ndarray]]:
    """All words in order, and each text as numbers of its words from 1: texts are not held as words."""
    first: dict[str, int] = {}
    found = [np.array([first.setdefault(w, len(first)) for w in words_of(t)], dtype=np.int32) for t in texts]
    words = sorted(first)
    place = np.empty(len(words), dtype=np.int32)
    place[[first[w] for w in words]] = np.arange(1, len(words) + 1, dtype=np.int32)
    return words, [place[ids] for ids in found]


def train(texts: Iterable[str], toxic: np.ndarray, *, prior: float, most_words: int = 8000, epochs: int = 5, batch: int = 64, seed: int = 7, tries: int = 4) -> Model:
    """A model from labelled texts; ``prior``: the share of toxic texts where it will be used, for calibration. The
    first dimension of each embedding starts from how its word or n-gram goes with the label. A toxic text trains by its
    strongest window, a clean one by the strongest of ``tries`` of its windows, new ones each epoch: all are clean. Every
    fifth text of each kind only calibrates, so that scores mean the same for texts that were not learned from."""
    toxic = np.asarray(toxic, dtype=np.int64)
    if len(set(toxic.tolist())) < 2:  # nothing to learn: everything has the prior
        m = Model.new({})
        m.scale = (0.0, float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))))
        return m
    rank = np.where(toxic == 1, np.cumsum(toxic), np.cumsum(1 - toxic))
    apart = (rank % 5 == 0) & (min(toxic.sum(), (1 - toxic).sum()) >= 25)
    all_words, split = _numbered(texts)
    grams, begins = many_grams(all_words)
    ends = np.append(begins[1:], len(grams)) if all_words else begins

    def grams_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of words numbered from 0, and which of these words has them."""
        size = (ends - begins)[words]
        at = np.repeat(begins[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return grams[at], np.repeat(np.arange(len(words)), size)

    with_word, with_gram = np.zeros((len(all_words) + 1, 2), np.int64), np.zeros((CHAR_BUCKETS, 2), np.int64)
    for ids, y, aside in zip(split, toxic.tolist(), apart.tolist(), strict=True):
        if aside:
            continue
        distinct = np.unique(ids)
        with_word[distinct, y] += 1
        with_gram[np.unique(grams_of(distinct - 1)[0]), y] += 1
    by_word, by_gram = _log_odds(with_word, toxic[~apart]), _log_odds(with_gram, toxic[~apart])
    chosen = np.sort(np.argsort(-np.abs(by_word[1:]), kind="stable")[:most_words])
    m = Model.new({all_words[w]: i for i, w in enumerate(chosen.tolist(), 1)}, seed)
    word_ids = np.zeros(len(all_words) + 1, dtype=np.int32)
    word_ids[chosen + 1] = np.arange(1, len(chosen) + 1)
    m.p["words"][1:, 0] = 0.3 * by_word[chosen + 1]
    m.p["chars"][:, 0] = np.where(with_gram.sum(axis=1) > 0, 0.15 * by_gram, m.p["chars"][:, 0])

    def inputs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of some words (row 0 is padding), with their n-grams and whose these are."""
        which, owner = grams_of(rows[rows > 0] - 1)
        owner = np.flatnonzero(rows > 0)[owner]
        chars = np.zeros((len(rows), CHAR_DIM), np.float32)
        if len(owner):  # n-grams of a word stand together, and each word has one
            begins_of = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            chars[owner[begins_of]] = np.add.reduceat(m.p["chars"][which], begins_of, axis=0)
        x = np.concatenate([m.p["words"][word_ids[rows]], chars], axis=1)
        x[rows == 0] = 0
        return x, which, owner

    cuts = [_cut(ids) for ids in split]
    rows, owners = np.concatenate(cuts), np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    begin = np.cumsum([0] + [len(c) for c in cuts[:-1]])
    size = np.array([len(c) for c in cuts])
    del cuts, split
    rng, moment, square, step = np.random.default_rng(seed), {k: np.zeros_like(v) for k, v in m.p.items()}, {k: np.zeros_like(v) for k, v in m.p.items()}, 0

    def logits(of: np.ndarray, portion: int = 1024) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(of), portion):  # the words of a portion alone have inputs, however many there are in all
            part = rows[of[i : i + portion]]
            used, at = np.unique(np.append(0, part.ravel()), return_inverse=True)
            x = inputs(used)[0]
            out.append(window_logits(at[1:].reshape(part.shape), *[x @ m.p[f"W{w}"] + m.p[f"c{w}"] for w in "fb"], m.p))
        return np.concatenate(out)

    # before the network knows anything: the window with the strongest association
    parts = [(begins[i : i + 8192], ends[i : i + 8192]) for i in range(0, len(begins), 8192)]
    totals = np.concatenate([np.zeros(0), *[np.add.reduceat(by_gram[grams[a[0] : b[-1]]], a - a[0]) / 4 for a, b in parts]])
    lean = np.append(0.0, by_word[1:] + totals)
    strength = np.concatenate([np.sort(lean[rows[i : i + 8192]], axis=1)[:, -3:].sum(axis=1) for i in range(0, len(rows), 8192)])
    clean, bad = np.flatnonzero((toxic == 0) & ~apart), np.flatnonzero((toxic == 1) & ~apart)
    toxic_windows = np.flatnonzero((toxic[owners] == 1) & ~apart[owners])
    for epoch in range(epochs):
        tried = (begin[clean] + (rng.random((tries, len(clean))) * size[clean]).astype(np.int64)).ravel()
        if epoch:
            looked = np.concatenate([toxic_windows, tried])
            strength[looked] = logits(looked)
        top = np.array([b + int(strength[b : b + n].argmax()) for b, n in zip(begin[bad].tolist(), size[bad].tolist(), strict=True)])
        hard = tried.reshape(tries, -1)[strength[tried].reshape(tries, -1).argmax(axis=0), np.arange(len(clean))]
        chosen_rows = np.concatenate([top, hard, rng.choice(tried, size=min(len(tried), (len(top) + len(hard)) // 2), replace=False)])
        rng.shuffle(chosen_rows)
        for i in range(0, len(chosen_rows), batch):
            part = chosen_rows[i : i + batch]
            used, at = np.unique(np.append(0, rows[part].ravel()), return_inverse=True)
            at = at[1:].reshape(len(part), WINDOW)
            x, which, owner = inputs(used)
            g, dx, _ = _gradients(m, at, x, toxic[owners[part]].astype(np.float32))
            dx[0] = 0
            g["words"], g["chars"] = _summed(word_ids[used], dx[:, :WORD_DIM], len(m.p["words"])), _summed(which, dx[owner, WORD_DIM:], CHAR_BUCKETS)
            g["words"][0] = 0
            step, pace = step + 1, 0.012 * (1 - (epoch + i / len(chosen_rows)) / epochs)
            for k, v in g.items():
                v = np.clip(v, -1, 1).astype(np.float32)
                moment[k] += 0.1 * (v - moment[k])
                square[k] += 0.001 * (v * v - square[k])
                m.p[k] -= (pace * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    judged = apart if apart.any() else np.ones(len(toxic), dtype=bool)
    of = np.flatnonzero(judged[owners])
    best = np.maximum.reduceat(logits(of), np.cumsum(size[judged]) - size[judged]).astype(np.float64)
    m.scale = _calibrated(best, toxic[judged], prior)
    return m


def _calibrated(logit: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit, rows weighted to the prior."""
    w = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    centre = logit.mean()
    x = np.stack([logit - centre, np.ones_like(logit)], axis=1)
    beta = np.array([1.0, np.log(prior / (1 - prior))])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        # a little pull to slope 1 keeps separable data finite
        grad = x.T @ (w * (q - y)) + 0.002 * np.array([beta[0] - 1.0, 0.0])
        hess = (x * (w * q * (1 - q))[:, None]).T @ x + np.diag([0.002, 1e-6])
        beta = beta - np.linalg.solve(hess, grad).clip(-1, 1)
    slope = max(float(beta[0]), 0.05)
    return slope, float(beta[1] - slope * centre)


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from; a null id is not one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: A model as rows: weights by name, the words of the vocabulary in their order, and the scale.
_PARTS = "name string, shape array<bigint>, data binary"


def _as_rows(m: Model) -> Iterator[tuple[str, list[int], bytes]]:
    for name, x in m.p.items():
        yield name, list(x.shape), x.astype("<f4").tobytes()
    yield "vocabulary", [len(m.vocabulary)], "\n".join(m.vocabulary).encode("utf-8", "surrogatepass")
    yield "scale", [2], np.array(m.scale, dtype="<f8").tobytes()


def _from_rows(rows: Iterable[tuple[str, list[int], bytes]]) -> Model:
    found = {name: (shape, data) for name, shape, data in rows}
    shape, words = found.pop("vocabulary")
    scale = np.frombuffer(found.pop("scale")[1], dtype="<f8").tolist()
    vocabulary = {w: i for i, w in enumerate(words.decode("utf-8", "surrogatepass").split("\n") if shape[0] else [], 1)}
    return Model(vocabulary, {k: np.frombuffer(data, dtype="<f4").reshape(shape).copy() for k, (shape, data) in found.items()}, (scale[0], scale[1]))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = 4000, train_chars: int = 20_000) -> Model:
    """A model from the labels that are not held out. At most ``train_docs`` labelled texts of at most ``train_chars``
    characters are used, a third of them toxic if there are as many, chosen by a hash of the id. One task of an executor
    trains on them; the driver gets the weights alone, about a megabyte. Of an id with several labels the highest counts;
    labels without a text are skipped; without labels of both kinds, as in empty tables, every score is the share of
    toxic labels."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    n, n1 = known.agg(F.count("*"), F.sum("y")).first()
    prior = min(0.5, max(0.01, (n1 or 0) / max(1, n)))
    pick = lambda y, most: known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = F.broadcast(pick(1, train_docs // 3).union(pick(0, train_docs - train_docs // 3)))
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .filter((F.length("text") > 0) & (F.length("text") <= train_chars))
        .join(chosen, F.col("doc_id") == F.col("id"))
        .select("doc_id", "text", "y")
        .orderBy("doc_id", "text")
        .limit(2 * train_docs)
        .select("text", "y")
        .coalesce(1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: list[int] = []

        def texts() -> Iterator[str]:
            for batch in batches:
                toxic.extend(batch.column(1).to_pylist())
                for x in batch.column(0):
                    yield x.as_py()

        held = deque(texts())
        given = (held.popleft() for _ in range(len(held)))  # a text that has been numbered is held no longer
        names, shapes, parts = zip(*_as_rows(train(given, np.array(toxic, dtype=np.int64), prior=prior)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(shapes, pa.list_(pa.int64())), pa.array(parts, pa.binary())], names=["name", "shape", "data"])
        give_back()

    found = rows.mapInArrow(run, _PARTS).toArrow().to_pylist()
    return _from_rows((r["name"], r["shape"], r["data"]) for r in found) if found else train([], np.zeros(0, dtype=np.int64), prior=prior)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, batch_rows: int = 1000, portion_chars: int = 500_000) -> DataFrame:
    """``docs`` (columns ``keep``, or all) and ``score``, the probability that a text is toxic. A null or empty text, or
    one without words, scores 0; a text of any length is scored over all its windows. An empty table stays empty. A column
    ``score`` of ``docs`` is replaced; one ``_text`` stays as it is. Texts go to Python ``batch_rows`` at a time from here
    on, for the rest of the session, unless it already takes fewer: a batch of whole texts is held more than once."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(limit)) <= batch_rows:
        docs.sparkSession.conf.set(limit, str(batch_rows))
    names = [c for c in (keep or docs.columns) if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out, held, size = [], [], 0
            for x in batch.column(names.index(text) if text in names else len(names)):
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size >= portion_chars:
                    out.append(scorer.scores(held))
                    held, size = [], 0
            if held:
                out.append(scorer.scores(held))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=schema.names)
        give_back()

    extra = [] if text in names else [F.col(text).alias("_text")]
    return docs.select(*[F.col(f"`{c}`") for c in names], *extra).mapInArrow(run, schema)


def crc_held_out(doc_id: object) -> bool:
    """``is_held_out`` in Python."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2
