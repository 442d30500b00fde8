"""A small causal self-attention language model over subword ids, in numpy.

One attention layer over windows of ``WIDTH`` ids.  Query and key of an id are
its embedding plus one for its place in the window; the mix of values plus a
second embedding of the last id goes through a rectifier.  The next id comes
from a softmax over classes of ids and one over the ids of the class, so a
token costs two short softmaxes.  Ids are ordered by frequency, and a class is
a run of them.

Windows overlap by ``WIDTH - STRIDE`` ids: each window scores its last
``STRIDE`` ids, so every id is scored once with at least ``WIDTH - STRIDE``
ids before it where the text has them.  Keys before a text's start are masked.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np

WIDTH, STRIDE = 64, 48
CLASSES, MEMBERS = 32, 64
KEY, VALUE = 16, 48
#: Windows whose attention is worked out together, for the cache.
AT_ONCE = 32
_F = np.float32


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, first scored place in it) of each window over sequences of these lengths."""
    n = -(-lengths // STRIDE)
    seq = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    return seq, k * STRIDE


def _most() -> np.ndarray:
    """The largest entry of each query and key before exp: 60, or next to nothing for keys after the query."""
    query, key = np.arange(STRIDE)[:, None] + WIDTH - STRIDE, np.arange(WIDTH)[None, :]
    return np.where(key <= query, 60, -1e9).astype(_F)


def _chunks(n: int) -> list[slice]:
    return [slice(k, k + AT_ONCE) for k in range(0, n, AT_ONCE)]


def _add_rows(ids: np.ndarray, rows: np.ndarray, size: int, often: int = 12) -> np.ndarray:
    """One row an id: the sum of its rows.  Frequent ids one by one, the others together, their first rows, second rows and so on."""
    order = np.argsort(ids, kind="stable")
    found = ids[order]
    cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    n = np.diff(np.r_[cuts, len(ids)])
    by = np.argsort(-n, kind="stable")
    cuts, n = cuts[by], n[by]
    # Of how many ids there are more than k rows.
    more = np.searchsorted(-n, -np.arange(often + 1))
    hot, added = int(more[often]), np.empty((len(cuts), rows.shape[1]), rows.dtype)
    ones = np.ones((1, int(n[0])), rows.dtype)
    for k, (at, m) in enumerate(zip(cuts[:hot].tolist(), n[:hot].tolist(), strict=True)):
        np.matmul(ones[:, :m], np.take(rows, order[at : at + m], axis=0, mode="clip"), out=added[k : k + 1])
    np.take(rows, order[cuts[hot:]], axis=0, out=added[hot:], mode="clip")  # no place is outside, and ``clip`` saves the check
    for k in range(1, often):
        m = int(more[k])
        if m <= hot:
            break
        added[hot:m] += np.take(rows, order[cuts[hot:m] + k], axis=0, mode="clip")
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[found[cuts]] = added
    return out


def _by_class(targets: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scored places in the order of their targets' classes, those classes, the targets' members, and where each class begins."""
    place = np.flatnonzero(scored)
    target = np.take(targets.reshape(-1), place, mode="clip")
    cls = (target // MEMBERS).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    return place[order], cls, np.take(target, order, mode="clip").astype(np.int64) % MEMBERS, np.searchsorted(cls, np.arange(CLASSES + 1))


class Attention:
    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters
        self.most = _most()
        self.ones = {n: np.ones((n, 1), _F) for n in (CLASSES, MEMBERS, WIDTH)}
        self.least = np.zeros(VALUE, _F)  # an array, for maximum is slow on scalars

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> "Attention":
        """Random weights; output biases from id counts."""
        r, size = np.random.default_rng(seed), CLASSES * MEMBERS
        c = counts.reshape(CLASSES, MEMBERS) + 0.5
        p = {
            "q": r.normal(0, 0.3, (size, KEY)), "k": r.normal(0, 0.3, (size, KEY)),
            "qp": r.normal(0, 0.3, (WIDTH, KEY)), "kp": r.normal(0, 0.3, (WIDTH, KEY)),
            "v": r.normal(0, 0.2, (size, VALUE)), "e": r.normal(0, 0.2, (size, VALUE)), "b": np.full(VALUE, 0.1),
            "wc": r.normal(0, 0.1, (VALUE, CLASSES)), "bc": np.log(c.sum(1)) - np.log(c.sum()),
            "wm": r.normal(0, 0.1, (CLASSES, VALUE, MEMBERS)), "bm": np.log(c) - np.log(c.sum(1, keepdims=True)),
        }
        return cls({k: np.ascontiguousarray(x, _F) for k, x in p.items()})

    def batch(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seq: np.ndarray, first: np.ndarray):
        """Inputs of some windows: keys' ids and validity, targets, which are scored, and their places in ``ids``.

        Sequence s is ids[starts[s] : starts[s] + lengths[s] + 1]; input i predicts the id after it.
        """
        at = first[:, None] + np.arange(STRIDE - WIDTH, STRIDE)[None, :]
        inside = (at >= 0) & (at < lengths[seq][:, None])
        place = starts[seq][:, None] + np.clip(at, 0, lengths[seq][:, None] - 1)
        scored = inside[:, WIDTH - STRIDE :]
        target = place[:, WIDTH - STRIDE :] + 1
        return ids[place], inside, target, scored

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """One row an id: its scaled query and second embedding; its key and value."""
        p = self.p
        return np.concatenate([p["q"] * _F(KEY**-0.5), p["e"] + p["b"]], axis=1), np.concatenate([p["k"], p["v"]], axis=1)

    def hidden(self, keys: np.ndarray, inside: np.ndarray, of_query: np.ndarray, of_key: np.ndarray, h: np.ndarray):
        """The hidden state of each query, written to ``h``, and what its gradient needs."""
        p = self.p
        qe = np.take(of_query, keys[:, WIDTH - STRIDE :], axis=0, mode="clip")
        qe[:, :, :KEY] += p["qp"][WIDTH - STRIDE :] * _F(KEY**-0.5)
        kv = np.take(of_key, keys, axis=0, mode="clip")
        kv[:, :, :KEY] += p["kp"]
        s = np.matmul(qe[:, :, :KEY], kv[:, :, :KEY].transpose(0, 2, 1))
        np.minimum(s, self.most, out=s)
        early = np.flatnonzero(~inside[:, 0])
        if len(early):
            s[early] = np.where(inside[early][:, None, :], s[early], _F(-1e9))
        np.exp(s, out=s)
        norm = np.matmul(s, self.ones[WIDTH])
        norm += _F(1e-30)
        out = np.matmul(s, kv[:, :, KEY:])
        out /= norm
        np.add(out, qe[:, :, KEY:], out=h)
        np.maximum(h, self.least, out=h)
        return qe, kv, s, norm, out

    def log_probabilities(self, h: np.ndarray, cls: np.ndarray, member: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target after hidden state ``h``; both as ``_by_class`` has them."""
        p, n = self.p, len(h)
        mine, total, inner = np.empty(n, _F), np.empty((n, 1), _F), np.empty((n, 1), _F)
        self._shares(h @ p["wc"], p["bc"], cls, mine, total)
        value = mine.astype(np.float64)
        for c in range(CLASSES):
            lo, hi = cuts[c], cuts[c + 1]
            if hi > lo:
                self._shares(h[lo:hi] @ p["wm"][c], p["bm"][c], member[lo:hi], mine[lo:hi], inner[lo:hi])
        value += mine
        return value - np.log(total[:, 0]) - np.log(inner[:, 0])

    def _shares(self, a: np.ndarray, bias: np.ndarray | None, at: np.ndarray, mine: np.ndarray, total: np.ndarray) -> np.ndarray:
        """exp of ``a`` and a bias, in its place, with entries of at most 80; one entry a row before exp and the row's sum to ``mine`` and ``total``."""
        if bias is not None:
            a += bias
        if len(a) and a.max() > 80:
            np.minimum(a, _F(80), out=a)
        np.take(a.reshape(-1), np.arange(0, a.size, a.shape[1]) + at, out=mine, mode="clip")
        np.exp(a, out=a)
        np.matmul(a, self.ones[a.shape[1]], out=total)
        return a

    def score(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at_once: int = 192) -> np.ndarray:
        """Log probability of every id but each sequence's first, at its place in ``ids`` (0 there)."""
        out = np.zeros(len(ids), np.float64)
        keep_memory()
        seq, first = windows(lengths)
        tables = self.tables()
        for k in range(0, len(seq), at_once):
            keys, inside, target, scored = self.batch(ids, starts, lengths, seq[k : k + at_once], first[k : k + at_once])
            h = np.empty((len(keys), STRIDE, VALUE), _F)
            for c in _chunks(len(keys)):
                self.hidden(keys[c], inside[c], *tables, h[c])
            place, *of_targets = _by_class(ids[target], scored)
            out[target.reshape(-1)[place]] = self.log_probabilities(np.take(h.reshape(-1, VALUE), place, axis=0, mode="clip"), *of_targets)
        return out

    def gradient(self, keys: np.ndarray, inside: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch and its gradient; ``targets`` are ids."""
        p, scale = self.p, _F(KEY**-0.5)
        tables, parts = self.tables(), _chunks(len(keys))
        every = np.empty((len(keys), STRIDE, VALUE), _F)
        saved = [self.hidden(keys[c], inside[c], *tables, every[c]) for c in parts]
        place, cls, member, cuts = _by_class(targets, scored)
        n = len(place)
        # A 1 beside each hidden state is the input of the biases.
        h = np.ones((n, VALUE + 1), _F)
        h[:, :-1] = np.take(every.reshape(-1, VALUE), place, axis=0, mode="clip")
        wc, wm = np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["wm"], p["bm"][:, None]], axis=1)
        gm, mine, total = np.zeros_like(wm), np.empty((2, n), _F), np.empty((2, n, 1), _F)
        a = self._softmax_gradient(h @ wc, cls, mine[0], total[0], n)
        gc, dh = h.T @ a, a @ wc[:-1].T
        for c in range(CLASSES):
            lo, hi = cuts[c], cuts[c + 1]
            if hi > lo:
                m = self._softmax_gradient(h[lo:hi] @ wm[c], member[lo:hi], mine[1, lo:hi], total[1, lo:hi], n)
                np.matmul(h[lo:hi].T, m, out=gm[c])
                dh[lo:hi] += m @ wm[c, :-1].T
        loss = np.log(total).sum() - mine.sum()
        dh *= h[:, :-1] > 0
        # One row a place: the gradient of its key and value, then that of its query and second embedding, if it has one.
        rows = np.empty((len(keys), WIDTH, 2 * (KEY + VALUE)), _F)
        dkv, dqe = rows[:, :, : KEY + VALUE], rows[:, WIDTH - STRIDE :, KEY + VALUE :]
        rows[:, : WIDTH - STRIDE, KEY + VALUE :] = 0
        every.reshape(-1, VALUE)[:] = 0
        every.reshape(-1, VALUE)[place] = dh
        dqe[:, :, KEY:] = every
        for c, (qe, kv, s, norm, out) in zip(parts, saved, strict=True):
            d = every[c]
            d /= norm
            np.matmul(s.transpose(0, 2, 1), d, out=dkv[c, :, KEY:])
            ds = np.matmul(d, kv[:, :, KEY:].transpose(0, 2, 1))
            ds -= np.einsum("ijk,ijk->ij", d, out)[:, :, None]
            ds *= s
            np.matmul(ds, kv[:, :, :KEY], out=dqe[c, :, :KEY])
            np.matmul(ds.transpose(0, 2, 1), qe[:, :, :KEY], out=dkv[c, :, :KEY])
        g = {"qp": np.zeros_like(p["qp"]), "kp": dkv[:, :, :KEY].sum(0), "b": dh.sum(0), "wc": gc[:-1], "bc": gc[-1], "wm": gm[:, :-1], "bm": gm[:, -1]}
        g["qp"][WIDTH - STRIDE :] = dqe[:, :, :KEY].sum(0) * scale
        of_key, of_query = np.split(_add_rows(keys.reshape(-1), rows.reshape(-1, 2 * (KEY + VALUE)), len(p["k"])), 2, axis=1)
        g["q"], g["e"], g["k"], g["v"] = of_query[:, :KEY] * scale, of_query[:, KEY:], of_key[:, :KEY], of_key[:, KEY:]
        return float(loss) / n, g

    def _softmax_gradient(self, a: np.ndarray, at: np.ndarray, mine: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
        """The gradient over ``n`` of each row's loss, the softmax at one place, in the place of ``a``; ``mine`` and ``total`` as in ``_shares``."""
        self._shares(a, None, at, mine, total)
        a *= 1 / (total * n)
        a.reshape(-1)[np.arange(0, a.size, a.shape[1]) + at] -= _F(1 / n)
        return a


class Adam:
    """The state of Adam for a model; ``step`` changes the model's weights in place."""

    def __init__(self, model: Attention):
        self.p, self.n = model.p, 0
        self.m, self.v, self.room = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(3))

    def step(self, g: dict[str, np.ndarray], lr: float) -> None:
        """``m`` and ``v`` are sums, not means, of gradients and squares: 10 and 100 times the means before their starts are made up for."""
        self.n += 1
        root = (100 * (1 - 0.99**self.n)) ** 0.5
        rate = _F(lr / 10 / (1 - 0.9**self.n) * root)
        for x, w in self.p.items():
            m, v, t = self.m[x], self.v[x], self.room[x]
            m *= _F(0.9)
            m += g[x]
            np.multiply(g[x], g[x], out=t)
            v *= _F(0.99)
            v += t
            np.sqrt(v, out=t)
            t += _F(1e-8 * root)
            np.divide(m, t, out=t)
            t *= rate
            w -= t


def train(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, epochs: int = 3, at_once: int = 48, rate: float = 4e-3, seed: int = 5, counts: np.ndarray | None = None) -> Attention:
    """Adam over shuffled windows, with a falling rate; output biases from ``counts``, or from those of ``ids``."""
    model = Attention.start(np.bincount(ids, minlength=CLASSES * MEMBERS).astype(np.float64) if counts is None else counts, seed)
    seq, first = windows(lengths)
    r, adam = np.random.default_rng(seed), Adam(model)
    steps = max(1, epochs * -(-len(seq) // at_once))
    for _ in range(epochs):
        order = r.permutation(len(seq))
        for k in range(0, len(seq), at_once):
            mine = order[k : k + at_once]
            keys, inside, target, scored = model.batch(ids, starts, lengths, seq[mine], first[mine])
            _, g = model.gradient(keys, inside, ids[target], scored)
            step = adam.n + 1
            adam.step(g, rate * min(1, step / 40) * (1 - 0.95 * step / steps))
    return model


def keep_memory(most: int = 32 << 20) -> None:
    """Have glibc keep up to ``most`` freed bytes: giving arrays of each step back and faulting them in again took half of a step's time."""
    with contextlib.suppress(AttributeError, OSError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, most)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, most)  # M_TRIM_THRESHOLD


def learn(model: Attention, adam: Adam, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rate: float, at_once: int = 192, seed: int = 5) -> None:
    """One more pass of Adam over all windows of some sequences, shuffled; each id is a target once.

    Of few windows, fewer make a step.
    """
    keep_memory()
    seq, first = windows(lengths)
    at_once = max(16, min(at_once, len(seq) // 50))
    order = np.random.default_rng(seed).permutation(len(seq))
    for k in range(0, len(seq), at_once):
        mine = order[k : k + at_once]
        keys, inside, target, scored = model.batch(ids, starts, lengths, seq[mine], first[mine])
        _, g = model.gradient(keys, inside, ids[target], scored)
        adam.step(g, rate * min(1, (adam.n + 1) / 20))
