"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by back-propagation and fast scoring.

Arrays are (features, windows), so that a step's gates are contiguous.
"""

from __future__ import annotations

import numpy as np

#: Kinds of spans; the last has no fixed pattern and comes from the tagger alone.
KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = 1 + len(KINDS)
HIDDEN, EMBED = 16, 8

#: Character classes by code point up to the table's end; the last entry stands for all others. 0 pads.
CLASSES = 48


def _table() -> np.ndarray:
    out = np.full(0x251, 46, np.uint8)
    out[0xC0:0x250] = 45
    for k in range(26):
        out[97 + k] = 1 + k
        out[65 + k] = 27
    out[48:58] = 28
    for k, c in enumerate("+-().@_% \n,/:#*'"):
        out[ord(c)] = 29 + k
    out[0x250] = 47
    return out


TABLE = _table()
ONE = np.eye(CLASSES, dtype=np.float32)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(points, len(TABLE) - 1)]


def _run(x: np.ndarray, emb: np.ndarray, w: np.ndarray, b: np.ndarray, back: bool):
    """One direction over classes x (steps, windows): hidden states (steps, HIDDEN, windows) and the tape.

    Gates are i, f, o, g; the first three's weights stand halved, as sigmoid(z) = (1 + tanh(z / 2)) / 2.
    """
    steps, m = x.shape
    out = np.empty((steps, HIDDEN, m), np.float32)
    h, c = np.zeros((HIDDEN, m), np.float32), np.zeros((HIDDEN, m), np.float32)
    both = np.empty((EMBED + HIDDEN, m), np.float32)
    z = np.empty((4 * HIDDEN, m), np.float32)
    tape = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        both[:EMBED] = emb.take(x[t], axis=1)
        both[EMBED:] = h
        np.matmul(w, both, out=z)
        z += b
        np.tanh(z, out=z)
        gate = z[: 3 * HIDDEN]
        gate *= 0.5
        gate += 0.5
        i, f, o, g = z[:HIDDEN], z[HIDDEN : 2 * HIDDEN], z[2 * HIDDEN : 3 * HIDDEN], z[3 * HIDDEN :]
        before = c
        c = f * c
        c += i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        tape.append((t, both.copy(), z.copy(), before, tc))
    return out, tape


def _score(x: np.ndarray, emb: np.ndarray, w: np.ndarray, b: np.ndarray, out: np.ndarray, e: np.ndarray, back: bool) -> None:
    """One direction's share of the emissions, added to e (steps, TAGS, windows), in buffers that stay in cache."""
    steps, m = x.shape
    both, z = np.zeros((EMBED + HIDDEN, m), np.float32), np.empty((4 * HIDDEN, m), np.float32)
    c, tc = np.zeros((HIDDEN, m), np.float32), np.empty((HIDDEN, m), np.float32)
    share = np.empty((TAGS, m), np.float32)
    h, gate = both[EMBED:], z[: 3 * HIDDEN]
    i, f, o, g = z[:HIDDEN], z[HIDDEN : 2 * HIDDEN], z[2 * HIDDEN : 3 * HIDDEN], z[3 * HIDDEN :]
    for t in range(steps - 1, -1, -1) if back else range(steps):
        emb.take(x[t], axis=1, out=both[:EMBED], mode="clip")
        np.matmul(w, both, out=z)
        z += b
        np.tanh(z, out=z)
        gate *= 0.5
        gate += 0.5
        c *= f
        i *= g
        c += i
        np.tanh(c, out=tc)
        np.multiply(o, tc, out=h)
        np.matmul(out, h, out=share)
        e[t] += share


def _back(dout: np.ndarray, x: np.ndarray, w: np.ndarray, tape, grad: dict, name: str) -> None:
    m = x.shape[1]
    dh, dc = np.zeros((HIDDEN, m), np.float32), np.zeros((HIDDEN, m), np.float32)
    for t, both, z, before, tc in reversed(tape):
        i, f, o, g = z[:HIDDEN], z[HIDDEN : 2 * HIDDEN], z[2 * HIDDEN : 3 * HIDDEN], z[3 * HIDDEN :]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        # (sigmoid's slope s (1 - s) for a halved argument z / 2 is 2 s (1 - s))
        dz = np.concatenate([dc * g * 2 * i * (1 - i), dc * before * 2 * f * (1 - f), dh * tc * 2 * o * (1 - o), dc * i * (1 - g * g)])
        grad["w" + name] += dz @ both.T
        grad["b" + name] += dz.sum(axis=1, keepdims=True)
        dboth = w.T @ dz
        grad["emb"] += dboth[:EMBED] @ ONE[x[t]]
        dh, dc = dboth[EMBED:], dc * f


class Tagger:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
        self.p = {"emb": draw(EMBED, CLASSES), "wf": draw(4 * HIDDEN, EMBED + HIDDEN), "wb": draw(4 * HIDDEN, EMBED + HIDDEN)}
        self.p |= {"bf": np.zeros((4 * HIDDEN, 1), np.float32), "bb": np.zeros((4 * HIDDEN, 1), np.float32)}
        for b in ("bf", "bb"):
            self.p[b][HIDDEN : 2 * HIDDEN] = 0.5
        self.p |= {"out": draw(TAGS, 2 * HIDDEN), "bias": np.zeros((TAGS, 1), np.float32), "trans": draw(TAGS, TAGS, k=0.1)}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(steps, TAGS, windows) for classes (steps, windows)."""
        p = self.p
        e = np.empty((len(x), TAGS, x.shape[1]), np.float32)
        e[:] = p["bias"]
        _score(x, p["emb"], p["wf"], p["bf"], np.ascontiguousarray(p["out"][:, :HIDDEN]), e, False)
        _score(x, p["emb"], p["wb"], p["bb"], np.ascontiguousarray(p["out"][:, HIDDEN:]), e, True)
        return e

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y (steps, windows) under the CRF, and gradients."""
        p = self.p
        steps, m = x.shape
        f, tape_f = _run(x, p["emb"], p["wf"], p["bf"], False)
        b, tape_b = _run(x, p["emb"], p["wb"], p["bb"], True)
        e = (np.matmul(p["out"][:, :HIDDEN], f) + np.matmul(p["out"][:, HIDDEN:], b) + p["bias"]).astype(np.float64)
        trans = p["trans"].astype(np.float64)[:, :, None]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, None] + trans
            top = s.max(axis=0)
            alpha[t] = np.log(np.exp(s - top).sum(axis=0)) + top + e[t]
        for t in range(steps - 2, -1, -1):
            s = trans + (e[t + 1] + beta[t + 1])[None]
            top = s.max(axis=1)
            beta[t] = np.log(np.exp(s - top[:, None]).sum(axis=1)) + top
        top = alpha[-1].max(axis=0)
        total = np.log(np.exp(alpha[-1] - top).sum(axis=0)) + top
        hot = np.eye(TAGS)[y].transpose(0, 2, 1)
        gold = (e * hot).sum(axis=(0, 1)) + p["trans"].astype(np.float64)[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(alpha + beta - total) - hot
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        pair = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            pair += np.exp(alpha[t - 1][:, None] + trans + (e[t] + beta[t])[None] - total).sum(axis=2)
        np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1.0)
        grad["trans"] = (pair / m).astype(np.float32)
        de = (de / m).astype(np.float32)
        grad["bias"] = de.sum(axis=(0, 2))[:, None]
        grad["out"][:, :HIDDEN] = np.einsum("tkm,thm->kh", de, f)
        grad["out"][:, HIDDEN:] = np.einsum("tkm,thm->kh", de, b)
        _back(np.matmul(p["out"][:, :HIDDEN].T, de), x, p["wf"], tape_f, grad, "f")
        _back(np.matmul(p["out"][:, HIDDEN:].T, de), x, p["wb"], tape_b, grad, "b")
        return float((total - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 192, rate: float = 0.02, seed: int = 1) -> float:
        """x, y: (windows, steps). Adam with a falling rate; gives the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        t, rounds, last = 0, epochs * max(1, len(x) // batch), 0.0
        for _ in range(epochs):
            losses = []
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                value, grad = self.loss(x[part].T, y[part].T)
                losses.append(value)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                t += 1
                step = rate * (1 - 0.95 * t / rounds)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g**2
                    self.p[k] = (self.p[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            last = float(np.mean(losses))
        return last

    def slack(self) -> float:
        """If at every place the best other tag's emission is below the outside tag's by more than this, the best path is
        all outside: what transitions can give back for each place that leaves it."""
        t = self.p["trans"]
        return float(max(0.0, (t[:, 1:] - t[0, 0]).max()) + max(0.0, (t[1:, 0] - t[0, 0]).max()))

    def viterbi(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags for each of several emissions (steps, TAGS), outside before and after; like lengths go together."""
        trans, out = self.p["trans"], [np.zeros(0, np.int64)] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            steps = len(parts[some[-1]])
            e = np.full((steps, len(some), TAGS), -1e9, np.float32)
            e[:, :, 0] = 0  # after its end a part stays outside
            for r, k in enumerate(some):
                e[: len(parts[k]), r] = parts[k]
            score, from_ = e[0] + trans[0], np.zeros(e.shape, np.int8)
            for t in range(1, steps):
                s = score[:, :, None] + trans
                from_[t] = s.argmax(axis=1)
                score = s.max(axis=1) + e[t]
            tags, row = np.empty((steps, len(some)), np.int64), np.arange(len(some))
            tags[-1] = (score + trans[:, 0]).argmax(axis=1)
            for t in range(steps - 1, 0, -1):
                tags[t - 1] = from_[t, row, tags[t]]
            for r, k in enumerate(some):
                out[k] = tags[: len(parts[k]), r]
        return out
