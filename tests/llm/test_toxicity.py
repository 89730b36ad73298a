import random

import numpy as np
import pytest

from colloquy.llm import toxicity as tox


def corpus(n, seed):
    rng = random.Random(seed)
    stems, texts, labels = ["lo", "mi", "ra", "te", "su", "no", "ka"], [], []
    for _ in range(n):
        words = ["".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 260))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["stupid", "moron"]) if rng.random() < 0.5 else "vrix" + rng.choice(stems) + rng.choice(stems)
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return tox.train(*corpus(500, 1), prior=0.3, epochs=4)


def test_held_out_accuracy(model):
    texts, labels = corpus(300, 2)
    scores = tox.Scorer(model).scores(texts)
    right = ((scores >= 0.3) == labels).mean()
    assert right > 0.95
    unseen = tox.Scorer(model).scores(["lo mi vrixkakano ra te", "lo mi ra te", ""])
    assert unseen[0] > 0.3 > unseen[1] and 0 <= unseen[2] < 0.3


def test_any_window_counts(model):
    clean = "lo mi ra te su no ka " * 300
    scores = tox.Scorer(model).scores([clean, clean + "stupid moron", "stupid moron " + clean, clean + "stupid moron " + clean])
    assert scores[0] < 0.3 and all(s > 0.3 for s in scores[1:])


def test_windows_cover_and_overlap():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        begins = tox.windows(n)
        assert begins == sorted(set(begins))
        covered = set().union(*[range(b, min(n, b + tox.WINDOW)) for b in begins])
        assert covered == set(range(n))
        assert all(b - a < tox.WINDOW for a, b in zip(begins, begins[1:], strict=False))


def test_scores_do_not_depend_on_the_batch(model):
    texts, _ = corpus(40, 3)
    together = tox.Scorer(model).scores(texts)
    alone = np.concatenate([tox.Scorer(model, most_words=3).scores([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_gradients():
    m = tox.Model.new({}, 1)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, tox.WORD_DIM + tox.CHAR_DIM))
    at = rng.integers(0, 6, size=(5, 7))
    y = np.array([0, 1, 1, 0, 1])

    def loss():
        z = tox._gradients(m, at, x, y)[2].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, dx, _ = tox._gradients(m, at, x, y)
    for k in ("Wf", "Ub", "cb", "A", "v", "o", "Uf"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = m.p[k][i]
        m.p[k][i] = keep + 1e-2
        up = loss()
        m.p[k][i] = keep - 1e-2
        down = loss()
        m.p[k][i] = keep
        assert abs((up - down) / 2e-2 - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-4, k
    keep = x[1, 2]
    x[1, 2] = keep + 1e-2
    up = loss()
    x[1, 2] = keep - 1e-2
    down = loss()
    assert abs((up - down) / 2e-2 - dx[1, 2]) < 0.05 * abs(dx[1, 2]) + 1e-4


def test_learning_and_scoring_tables(spark):
    texts, labels = corpus(300, 5)
    docs = spark.createDataFrame([*enumerate(texts), (None, "stupid moron"), (999, None), (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS score", "'de' AS lang")
    table = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(5, None), (None, 1), (4000, 1), (7, int(labels[7]))], "doc_id long, toxic int")
    model = tox.learn(docs, table)
    rows = tox.score(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == len(texts) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 300 and tox.crc_held_out(r["doc_id"])]
    assert np.mean([(r["score"] >= 0.3) == labels[r["doc_id"]] for r in held]) > 0.85
    marked = {r["doc_id"]: r["h"] for r in docs.select("doc_id", tox.is_held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(marked[i] == tox.crc_held_out(i) for i in marked)
    assert "score" in tox.score(docs, model).columns and tox.score(docs.limit(0), model).count() == 0
    blank = tox.learn(docs, table.limit(0))
    assert tox.score(docs, blank, keep=["doc_id"]).count() == len(rows)


def test_held_out_labels_change_nothing(spark):
    texts, labels = corpus(120, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    wrong = spark.createDataFrame([(i, 1 - int(y) if tox.crc_held_out(i) else int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    a, b = tox.learn(docs, real), tox.learn(docs, wrong)
    assert a.vocabulary == b.vocabulary and all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def plain_logit(m, words):
    """One window read word by word with scalars alone."""
    import math

    sig = lambda x: 1 / (1 + math.exp(-x))
    p = {k: v.astype(float).tolist() for k, v in m.p.items()}
    inputs = []
    for w in words:
        grams, _ = tox.char_grams([w])
        chars = [sum(p["chars"][g][j] for g in grams.tolist()) for j in range(tox.CHAR_DIM)]
        inputs.append(p["words"][m.vocabulary.get(w, 0)] + chars)
    inputs += [[0.0] * (tox.WORD_DIM + tox.CHAR_DIM)] * (tox.WINDOW - len(words))
    h3, states = 3 * tox.HIDDEN, []
    for way in "fb":
        h, out = [0.0] * tox.HIDDEN, [None] * tox.WINDOW
        for t in range(tox.WINDOW) if way == "f" else range(tox.WINDOW - 1, -1, -1):
            x = [sum(inputs[t][i] * p[f"W{way}"][i][j] for i in range(len(inputs[t]))) + p[f"c{way}"][j] for j in range(h3)]
            y = [sum(h[i] * p[f"U{way}"][i][j] for i in range(tox.HIDDEN)) for j in range(h3)]
            z = [sig(x[j] + y[j]) for j in range(tox.HIDDEN)]
            r = [sig(x[tox.HIDDEN + j] + y[tox.HIDDEN + j]) for j in range(tox.HIDDEN)]
            fresh = [math.tanh(x[2 * tox.HIDDEN + j] + r[j] * y[2 * tox.HIDDEN + j]) for j in range(tox.HIDDEN)]
            h = [(1 - z[j]) * fresh[j] + z[j] * h[j] for j in range(tox.HIDDEN)]
            out[t] = h
        states.append(out)
    both = [f + b for f, b in zip(*states, strict=True)][: max(1, len(words))]
    e = [sum(math.tanh(sum(s[i] * p["A"][i][a] for i in range(len(s))) + p["a0"][a]) * p["v"][a] for a in range(tox.ATTEND)) for s in both]
    w = [math.exp(x - max(e)) for x in e]
    pooled = [sum(w[t] * both[t][i] for t in range(len(both))) / sum(w) for i in range(2 * tox.HIDDEN)]
    return sum(a * b for a, b in zip(pooled, p["o"], strict=True)) + p["o0"][0]


def test_plain_forward_pass(model):
    texts = corpus(6, 9)[0] + ["", "stupid", "no word of this is known"]
    for text in texts:
        words = tox.words_of(text)
        plain = max(plain_logit(model, words[b : b + tox.WINDOW]) for b in tox.windows(len(words)))
        assert abs(plain - float(tox.Scorer(model).logits([text])[0])) < 1e-3


def test_model_as_rows(model):
    back = tox._from_rows(tox._as_rows(model))
    texts = corpus(20, 5)[0]
    assert back.vocabulary == model.vocabulary and np.array_equal(tox.Scorer(back).scores(texts), tox.Scorer(model).scores(texts))


def test_learn_trains_in_a_task(spark):
    texts, labels = corpus(120, 6)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
    found = tox.learn(docs, known)
    ids = [i for i in range(120) if not tox.crc_held_out(i)]
    here = tox.train([texts[i] for i in ids], labels[ids], prior=float(labels[ids].mean()))
    assert np.allclose(tox.Scorer(found).scores(texts), tox.Scorer(here).scores(texts), atol=1e-4)
    empty = tox.learn(docs.limit(0), known)
    assert np.allclose(tox.Scorer(empty).scores(["", "lo mi"]), [0, labels[ids].mean()], atol=1e-6)
    assert tox.score(docs.limit(0), found).count() == 0


def test_very_long_text(model):
    long = "lo mi ra te su no ka " * 60_000
    scores = tox.Scorer(model).scores([long, long + "stupid moron"])
    assert scores[0] < 0.3 < scores[1]


def test_grams_in_portions():
    words = ["".join(random.Random(i).choices("abcdefgé中", k=i % 7 + 1)) for i in range(50)]
    whole, begins = tox.char_grams(words)
    for portion in (1, 7, 49, 50, 51):
        parts, at = tox.many_grams(words, portion)
        assert np.array_equal(parts, whole) and np.array_equal(at, begins)
    assert [len(x) for x in tox.many_grams([])] == [0, 0]


def test_training_takes_little_memory():
    import tracemalloc

    rng = random.Random(4)
    labels = np.array([i % 3 == 0 for i in range(120)], dtype=np.int64)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=9)) for _ in range(500)) for _ in labels]
    tracemalloc.start()
    try:
        tox.train(iter(texts), labels, prior=0.3, epochs=2)
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert most < 65, most  # 46 MB; 91 when all words were worked out at once
