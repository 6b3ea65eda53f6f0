"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 16
WINDOW = 96
_CLASSES = " \n#!\"$%&'()*+,-./:;<=>?@[\\]^_`{|}~abcdefghijklmnopqrstuvwxyz"
VOCAB = len(_CLASSES) + 4
PAD, DIGIT, LETTER, OTHER = 0, 1, 2, 3
_ASCII = np.full(128, OTHER, np.int16)
for _i, _c in enumerate(_CLASSES):
    _ASCII[ord(_c)] = _i + 4
    _ASCII[ord(_c.upper())] = _i + 4
_ASCII[48:58] = DIGIT


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(code < 128, _ASCII[np.minimum(code, 127)], OTHER)
    for i in np.flatnonzero(code >= 128):
        if text[i].isalpha():
            out[i] = LETTER
    return out


def _sig(x):
    return 1 / (1 + np.exp(-x))


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def forbidden() -> np.ndarray:
    """Transitions from row to column that no tagging has: I without B or I of its kind before it."""
    f = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        f[:, inside] = True
        f[[inside - 1, inside], inside] = False
    return f


class Tagger:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n, h = rng.standard_normal, HIDDEN
        self.p = {"o": n((2 * h, TAGS)) * 0.2, "ob": np.zeros(TAGS), "t": n((TAGS, TAGS)) * 0.05, "s": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"x{d}": n((VOCAB, 4 * h)) * 0.3, f"h{d}": n((h, 4 * h)) * 0.2, f"c{d}": np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.stop = np.where(forbidden(), np.float32(-1e4), np.float32(0))

    # --- network -------------------------------------------------------------
    def _run(self, ids, d, keep=False):
        h, c, H = np.zeros((len(ids), HIDDEN), np.float32), np.zeros((len(ids), HIDDEN), np.float32), HIDDEN
        x, wh = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"h{d}"]
        out, saved = np.empty((*ids.shape, H), np.float32), []
        for t in range(ids.shape[1]) if d == "f" else range(ids.shape[1] - 1, -1, -1):
            z = x[ids[:, t]] + h @ wh
            g = _sig(z[:, : 3 * H])
            u = np.tanh(z[:, 3 * H :])
            before, prev = c, h
            c = g[:, H : 2 * H] * c + g[:, :H] * u
            tc = np.tanh(c)
            h = g[:, 2 * H :] * tc
            out[:, t] = h
            if keep:
                saved.append((t, g, u, before, prev, tc))
        return out, saved

    def _back(self, ids, d, dout, saved, grad):
        H, wh = HIDDEN, self.p[f"h{d}"]
        dh, dc = np.zeros((len(ids), H), np.float32), np.zeros((len(ids), H), np.float32)
        for t, g, u, before, prev, tc in reversed(saved):
            dh = dh + dout[:, t]
            i, f, o = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
            np.add.at(grad[f"x{d}"], ids[:, t], dz)
            grad[f"h{d}"] += prev.T @ dz
            grad[f"c{d}"] += dz.sum(0)
            dh, dc = dz @ wh.T, dc * f

    def emissions(self, ids):
        return np.concatenate([self._run(ids, "f")[0], self._run(ids, "b")[0]], 2) @ self.p["o"] + self.p["ob"]

    # --- conditional random field ----------------------------------------------
    def loss_and_grad(self, ids, tags):
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        (hf, sf), (hb, sb) = self._run(ids, "f", True), self._run(ids, "b", True)
        hidden = np.concatenate([hf, hb], 2)
        e = hidden @ self.p["o"] + self.p["ob"]
        trans = self.p["t"] + self.stop
        B, T, _ = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = self.p["s"] + e[:, 0]
        for t in range(1, T):
            alpha[:, t] = _lse(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
        for t in range(T - 2, -1, -1):
            beta[:, t] = _lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        pair = alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        grad["t"] += np.exp(pair).sum((0, 1))
        b, t = np.arange(B)[:, None], np.arange(T)[None]
        gold = self.p["s"][tags[:, 0]].sum() + e[b, t, tags].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
        de[b, t, tags] -= 1
        np.subtract.at(grad["t"], (tags[:, :-1], tags[:, 1:]), 1)
        grad["s"] += de[:, 0].sum(0)
        grad["o"] += np.einsum("bth,btk->hk", hidden, de)
        grad["ob"] += de.sum((0, 1))
        dh = de @ self.p["o"].T
        self._back(ids, "f", dh[..., :HIDDEN], sf, grad)
        self._back(ids, "b", dh[..., HIDDEN:], sb, grad)
        return float(z.sum() - gold) / B, {k: v / B for k, v in grad.items()}

    def train(self, ids, tags, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 4) -> None:
        rng, m, v, n = np.random.default_rng(seed), {}, {}, 0
        total = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for at in range(0, len(ids), batch):
                pick = order[at : at + batch]
                _, grad = self.loss_and_grad(ids[pick], tags[pick])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                n += 1
                step = rate * (1 - 0.95 * n / total)
                for k, g in grad.items():
                    g = g * min(1, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (step * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tagging of each window (Viterbi)."""
        e = self.emissions(ids)
        trans = self.p["t"] + self.stop
        score, back = self.p["s"] + self.stop[0] + e[:, 0], []
        for t in range(1, ids.shape[1]):
            all_ = score[:, :, None] + trans
            back.append(all_.argmax(1))
            score = all_.max(1) + e[:, t]
        tags = [score.argmax(1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(ids)), tags[-1]])
        return np.stack(tags[::-1], 1)


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of one tagging."""
    out, start = [], None
    for i, t in enumerate([*tags.tolist(), 0]):
        if start is not None and (t == 0 or t % 2 == 1):
            out.append(((tags[start] - 1) // 2, start, i))
            start = None
        if t % 2 == 1:
            start = i
    return out
