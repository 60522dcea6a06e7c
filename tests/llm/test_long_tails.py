"""Finding on op2_language_model's CPU time: the same scores with less work."""

import numpy as np
import pytest

from tidemark.llm import gru, language_model
from tidemark.llm import words as W


def _net(scale=1.0, words=40):
    counts = np.random.default_rng(3).integers(1, 90, words).astype(float)
    order, starts = gru.classes(counts, 6)
    net = gru.new(counts[order], starts, 5, 4)
    net.p = {k: (v * np.float32(scale)) for k, v in net.p.items()}
    return net


def test_a_long_text_is_looked_up_in_large_numbers(monkeypatch):
    """The steps of one text that outlasts all others are not looked up in windows of 256."""
    calls, own = [], gru.log_probs
    monkeypatch.setattr(gru, "log_probs", lambda *a: calls.append(len(a[2])) or own(*a))
    words = np.random.default_rng(4).integers(0, 40, 4010)
    got = gru.score(_net(), words, np.array([10, 4000]))
    assert len(calls) <= 3 and sum(calls) == 4010 and (got < 0).all()


@pytest.mark.parametrize("scale", [1.0, 30.0, 3000.0])
def test_probabilities_equal_a_full_softmax(scale):
    """Also with weights so large that one number for all rows would lose some."""
    net = _net(scale)
    rng = np.random.default_rng(5)
    states, words = rng.uniform(-1, 1, (300, 5)).astype(np.float32), rng.integers(0, 40, 300)
    p, soft = {k: v.astype(np.float64) for k, v in net.p.items()}, lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    kind = np.searchsorted(net.starts, words, "right") - 1
    want = []
    for s, w, k in zip(states.astype(np.float64), words, kind):
        i, j = net.starts[k], net.starts[k + 1]
        want.append(soft(s @ p["wc"] + p["bc"])[k] + soft(p["ww"][i:j] @ s + p["bw"][i:j])[w - i])
    got = gru.log_probs(net, states, words)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4 * scale)


def test_words_that_share_their_first_bits_are_found():
    rng = np.random.default_rng(6)
    near = (W.U(77) << W.U(50)) + np.arange(50, dtype=W.U) * W.U(3)
    known = np.unique(np.concatenate((rng.integers(0, 2**64, 1000, W.U), near, np.array([0, 2**64 - 1], W.U))))
    none = np.zeros(0, np.int64)
    lex = language_model.Lexicon(0, 0, known, none, none, none, none, none, none, none)
    asked = np.concatenate((known, near + W.U(1), rng.integers(0, 2**64, 5000, W.U)))
    place = {int(h): i for i, h in enumerate(known)}
    assert lex.find(asked).tolist() == [place.get(int(h), -1) for h in asked]
