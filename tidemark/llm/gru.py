"""A gated recurrent language model with a class-factored softmax, in numpy.

Output words are sorted by class; the probability of a word is that of its
class times that of the word within the class.  Training is truncated
backpropagation over windows of parallel streams, the state carried from
window to window; scoring runs many texts at once, each with its own state
from its first token to its last."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN, EMBED, CLASSES = 16, 16, 48
STREAMS, STEPS, RATE = 64, 24, 0.01
#: Rows whose words are looked up together, those whose classes are, and most steps of them.
ROWS, CACHED, MOST_STEPS = 1 << 15, 1 << 12, 1 << 12


def classes(counts: np.ndarray, n: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """An order of the words, frequent first, and the first place of each class:
    classes hold about the same share of the tokens, and none is too large."""
    order = np.argsort(-counts, kind="stable")
    share = np.cumsum(counts[order] + 1e-9) / (counts.sum() + 1e-9 * len(counts))
    number = np.minimum((share * n * 0.999999).astype(np.int64), n - 1)
    starts = [0]
    most = max(1, 6 * len(counts) // n)
    for i in range(1, len(order)):
        if number[i] != number[i - 1] or i - starts[-1] >= most:
            starts.append(i)
    return order, np.array(starts + [len(order)], np.int64)


@dataclass
class Net:
    starts: np.ndarray  # first output word of each class, and the end
    p: dict[str, np.ndarray]

    @property
    def words(self) -> int:
        return int(self.starts[-1])


def new(counts: np.ndarray, starts: np.ndarray, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 1) -> Net:
    """Weights that begin as the unigram model; ``counts`` in class order."""
    rng = np.random.default_rng(seed)
    v, c = len(counts), len(starts) - 1
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    mass = np.add.reduceat(counts + 0.5, starts[:-1])
    return Net(starts, {
        "embed": draw(v + 1, embed), "wx": draw(embed, 3 * hidden), "wh": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
        "wc": draw(hidden, c), "bc": np.log(mass / mass.sum()).astype(np.float32),
        "ww": draw(v, hidden), "bw": np.log(counts + 0.5).astype(np.float32)})


def _sigmoid(x):
    """In place, of the negated argument."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _gates(p):
    """Tables of the input words and matrices of the state, one of each gate, so
    that all work on a gate is on whole arrays.  Those of the two sigmoids are negated."""
    n = p["wh"].shape[0]
    sign = np.repeat(np.array([-1, -1, 1], np.float32), n)
    cut = lambda x: [np.ascontiguousarray(x[:, k:k + n]) for k in (0, n, 2 * n)]
    return cut((p["embed"] @ p["wx"] + p["b"]) * sign), cut(p["wh"] * sign)


def _step(words, h, tables, matrices):
    """Both sigmoids, the new part, its part from the state, and the next state."""
    z, r = (_sigmoid(np.add(h @ m, t.take(words, axis=0))) for t, m in zip(tables[:2], matrices))
    own = h @ matrices[2]
    new = r * own
    new += tables[2].take(words, axis=0)
    np.tanh(new, out=new)
    h = h - new
    h *= z
    h += new
    return z, r, new, own, h


def _logits(states, w, b):
    """Logits of words with weights ``w``, less a number per row after which none
    is far above 0 and not all are far below.  States lie between -1 and 1, so
    that one number does for all rows unless the weights are very large."""
    size = np.abs(w).sum(axis=1)
    high = (b + size).max()
    x = states @ w.T
    if high - (b - size).max() < 80:
        x += b - high
    else:
        x += b
        x -= x.max(axis=1, keepdims=True)
    return x


def _sums(x):
    """Row sums; a product, as numpy's own sum is slow over short rows."""
    return x @ np.ones(x.shape[1], x.dtype)


def log_probs(net: Net, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log probability of each word after its state."""
    p, starts = net.p, net.starts
    kind = np.repeat(np.arange(len(starts) - 1, dtype=np.int16), np.diff(starts))[words]
    order = np.argsort(kind, kind="stable")
    states, words, kind = states.take(order, axis=0), words[order], kind[order]
    cuts = np.searchsorted(kind, np.arange(len(starts)))
    found = np.empty(len(words), np.float32)
    for i in range(0, len(words), CACHED):
        found[i:i + CACHED] = _picked(_logits(states[i:i + CACHED], p["wc"].T, p["bc"]), kind[i:i + CACHED])
    for c in range(len(starts) - 1):
        own, at = slice(starts[c], starts[c + 1]), slice(cuts[c], cuts[c + 1])
        if cuts[c + 1] > cuts[c] and starts[c + 1] - starts[c] > 1:
            found[at] += _picked(_logits(states[at], p["ww"][own], p["bw"][own]), words[at] - starts[c])
    out = np.empty(len(words))
    out[order] = found
    return out


def _picked(x, at):
    """Log probability of one word a row; the logits are used up."""
    one = x[np.arange(len(x)), at]
    return one - np.log(_sums(np.exp(x, out=x)))


def score(net: Net, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each text; ``counts`` are words per text, the
    texts lie end to end.  Longest texts come first, so those still running are
    a front slice; states are carried over windows to the end of each text."""
    p, n = net.p, net.p["wh"].shape[0]
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    lengths, base = counts[order], first[order]
    total = np.zeros(len(counts))
    tables, matrices = _gates(p)
    state = np.zeros((len(counts), n), np.float32)
    t, steps = 0, int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(steps), "left")
    last = np.full(len(counts), net.words, np.int64)
    while t < steps:
        # Few texts are left for many steps; their rows are still looked up in large numbers.
        window = int(np.clip(ROWS // max(1, live[t]), 4, MOST_STEPS))
        states, tokens, owners = [], [], []
        for u in range(t, min(steps, t + window)):
            k = live[u]
            state = state[:k]
            state = _step(last[:k], state, tables, matrices)[-1]
            last = words[base[:k] + u]
            states.append(state)
            tokens.append(last)
            owners.append(k)
        got = log_probs(net, np.concatenate(states), np.concatenate(tokens))
        at = 0
        for k in owners:
            total[order[:k]] += got[at:at + k]
            at += k
        t += window
    return total


def train(net: Net, words: np.ndarray, begins: np.ndarray, rate: float = RATE, streams: int = STREAMS, steps: int = STEPS,
          last_rate: float | None = None) -> tuple[Net, float]:
    """One pass over ``words`` (texts end to end, ``begins`` true at each first
    word); the trained net and the mean negative log-likelihood seen."""
    p = {k: v.copy() for k, v in net.p.items()}
    net = Net(net.starts, p)
    starts, n = net.starts, p["wh"].shape[0]
    streams = max(1, min(streams, len(words) // steps))
    length = -(-len(words) // streams)
    before = np.concatenate(([net.words], words[:-1]))
    before[begins] = net.words
    # The last streams are filled up with words that count for nothing.
    fill = lambda x, v: np.concatenate((x, np.full(streams * length - len(x), v, x.dtype)))
    cut = lambda x, v: fill(x, v).reshape(streams, length).T
    x_all, y_all, reset, real_all = cut(before, net.words), cut(words, 0), cut(begins, True), cut(np.ones(len(words), bool), False)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    state, loss, seen, updates = np.zeros((streams, n), np.float32), 0.0, 0, 0
    kind_of = np.repeat(np.arange(len(starts) - 1, dtype=np.int16), np.diff(starts))
    for t0 in range(0, length, steps):
        x, y, fresh = x_all[t0:t0 + steps], y_all[t0:t0 + steps], reset[t0:t0 + steps]
        size = len(x)
        tables, matrices = _gates(p)
        keep = (~fresh).astype(np.float32)[:, :, None]
        z, r, new, gh, hp, hs = (np.empty((size, streams, n), np.float32) for _ in range(6))
        for t in range(size):
            np.multiply(state, keep[t], out=hp[t])
            z[t], r[t], new[t], gh[t], state = _step(x[t], hp[t], tables, matrices)
            hs[t] = state
        flat_h, target, real = hs.reshape(-1, n), y.ravel(), real_all[t0:t0 + steps].ravel()
        rows = int(real.sum())
        kind = kind_of[target]
        g = {}
        everyone = np.arange(len(target))
        share = real / np.float32(rows)
        d = _logits(flat_h, p["wc"].T, p["bc"])
        picked = d[everyone, kind]
        sums = _sums(np.exp(d, out=d))
        loss -= float((picked - np.log(sums))[real].sum())
        d *= (share / sums)[:, None]
        d[everyone, kind] -= share
        g["wc"], g["bc"], dhs = flat_h.T @ d, d.sum(axis=0), d @ p["wc"].T
        g["ww"], g["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
        order = np.argsort(np.where(real, kind, len(starts)).astype(np.int16), kind="stable")[:rows]
        cuts = np.searchsorted(kind[order], np.arange(len(starts)))
        sorted_h, sorted_y, sorted_d = flat_h.take(order, axis=0), target[order], np.zeros((rows, n), np.float32)
        for c in range(len(starts) - 1):
            i, j = cuts[c], cuts[c + 1]
            if j > i and starts[c + 1] - starts[c] > 1:
                own = slice(starts[c], starts[c + 1])
                d = _logits(sorted_h[i:j], p["ww"][own], p["bw"][own])
                here, pick = np.arange(j - i), sorted_y[i:j] - starts[c]
                picked = d[here, pick]
                sums = _sums(np.exp(d, out=d))
                loss -= float((picked - np.log(sums)).sum())
                d *= (np.float32(1 / rows) / sums)[:, None]
                d[here, pick] -= np.float32(1 / rows)
                g["ww"][own], g["bw"][own] = d.T @ sorted_h[i:j], d.sum(axis=0)
                sorted_d[i:j] = d @ p["ww"][own]
        dhs[order] += sorted_d
        dhs = dhs.reshape(size, streams, n)
        # Factors of the gates' derivatives, for all steps at once.
        to_z, to_n, to_r = (hp - new) * z * (1 - z), (1 - z) * (1 - new * new), gh * r * (1 - r)
        dz, dr, dn, dh = np.empty_like(z), np.empty_like(z), np.empty_like(z), np.zeros((streams, n), np.float32)
        back = [np.ascontiguousarray(p["wh"][:, k:k + n].T) for k in (0, n, 2 * n)]
        for t in range(size - 1, -1, -1):
            dh += dhs[t]
            np.multiply(dh, to_z[t], out=dz[t])
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(dn[t], to_r[t], out=dr[t])
            dh *= z[t]
            dh += dz[t] @ back[0]
            dh += dr[t] @ back[1]
            dh += (dn[t] * r[t]) @ back[2]
            dh *= keep[t]
        before_t = hp.reshape(-1, n).T
        g["wh"] = np.hstack([before_t @ d.reshape(-1, n) for d in (dz, dr, dn * r)])
        # Gradients of the gates of each input word, then of what they are made of.
        by_word = np.argsort(x.ravel().astype(np.int16 if net.words < 1 << 15 else np.int64), kind="stable")
        ordered = x.ravel()[by_word]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        gates = np.zeros((net.words + 1, 3 * n), np.float32)
        gates[ordered[first]] = np.add.reduceat(np.concatenate([d.reshape(-1, n) for d in (dz, dr, dn)], axis=1).take(by_word, axis=0), first, axis=0)
        g["b"], g["wx"], g["embed"] = gates.sum(axis=0), p["embed"].T @ gates, gates @ p["wx"].T
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
        updates += 1
        now = rate + ((rate if last_rate is None else last_rate) - rate) * t0 / length
        for k, v in p.items():
            grad = g[k] * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
            m1[k] += np.float32(0.1) * (grad - m1[k])
            m2[k] += np.float32(0.01) * (grad * grad - m2[k])
            v -= np.float32(now / (1 - 0.9 ** updates)) * m1[k] / (np.sqrt(m2[k] / np.float32(1 - 0.99 ** updates)) + np.float32(1e-8))
        seen += rows
    return net, loss / max(1, seen)
