import numpy as np

from colloquy.llm.fingerprints import BOTH, SHORT, STEPS, _kinds, fingerprint_each, likeness

RANKS = np.arange(STEPS + 1, dtype=np.int32)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), size=rng.integers(2, 9))) for _ in range(n // 2))[:n]


def test_near_texts_on_both_sides_of_a_border_are_alike():
    for border, least in ((SHORT, 0.8), (BOTH, 0.3)):
        for seed in range(6):
            below, above, other = fingerprint_each([words(seed, border - 6), words(seed, border + 6), words(seed + 100, border + 6)], RANKS)
            assert likeness(below.packed, above.packed) > least and likeness(below.packed, other.packed) < 0.1


def test_an_edit_over_the_border_still_reads():
    for seed in range(6):
        text = words(seed, 300)
        was, now = fingerprint_each([text, text[:200]], RANKS)
        assert likeness(was.packed, now.packed) > 0.4


def test_two_thirds_of_a_longer_text_share_a_kind():
    text = "a b" * 100 + "\U0001f600" * 150
    was, now = fingerprint_each([text, text[:300]], RANKS)
    assert len(was.raw) > BOTH and len(now.raw) >= SHORT
    assert all(len(_kinds(p.packed)[0]) for p in (was, now))
