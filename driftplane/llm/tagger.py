"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Both directions run as one batched product: axis 0 of the recurrent weights is the
direction, and the second direction reads the window backwards.  Training is plain
back-propagation through time with Adam; the loss is the negative log-likelihood of the tag
sequence under the CRF.  Decoding is Viterbi over whole windows of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tagger:
    p: dict[str, np.ndarray]
    hidden: int

    @classmethod
    def fresh(cls, symbols: int, tags: int, *, embed: int = 12, hidden: int = 16, seed: int = 0) -> Tagger:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[..., hidden : 2 * hidden] = 1
        return cls({"emb": 0.3 * r.standard_normal((symbols, embed)).astype(np.float32), "wx": n(2, embed, 4 * hidden), "wh": n(2, hidden, 4 * hidden), "b": bias, "wo": n(2 * hidden, tags), "bo": np.zeros(tags, np.float32), "tr": np.zeros((tags, tags), np.float32), "st": np.zeros(tags, np.float32)}, hidden)

    def _forward(self, x: np.ndarray, mask: np.ndarray):
        """x, mask: (length, batch).  Emissions (length, batch, tags), and what backward needs."""
        p, h = self.p, self.hidden
        both = np.stack([x, x[::-1]], 1)
        e = p["emb"][both]
        z = np.matmul(e, p["wx"][None]) + p["b"][None]
        m = np.stack([mask, mask[::-1]], 1)[..., None]
        length, _, batch, _ = z.shape
        hs, cs = np.zeros((length + 1, 2, batch, h), np.float32), np.zeros((length + 1, 2, batch, h), np.float32)
        gates = np.empty_like(z)
        tc = np.empty((length, 2, batch, h), np.float32)
        for t in range(length):
            a = z[t] + np.matmul(hs[t], p["wh"])
            g = gates[t]
            np.tanh(0.5 * a[..., : 3 * h], out=g[..., : 3 * h])
            g[..., : 3 * h] *= 0.5
            g[..., : 3 * h] += 0.5
            np.tanh(a[..., 3 * h :], out=g[..., 3 * h :])
            cs[t + 1] = (g[..., h : 2 * h] * cs[t] + g[..., :h] * g[..., 3 * h :]) * m[t]
            np.tanh(cs[t + 1], out=tc[t])
            hs[t + 1] = g[..., 2 * h : 3 * h] * tc[t] * m[t]
        out = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], -1)
        return out @ p["wo"] + p["bo"], (both, e, m, hs, cs, gates, tc, out)

    def _backward(self, d_em: np.ndarray, kept) -> dict[str, np.ndarray]:
        p, h = self.p, self.hidden
        both, e, m, hs, cs, gates, tc, out = kept
        g = {"wo": np.einsum("lbi,lbk->ik", out, d_em), "bo": d_em.sum((0, 1))}
        d_out = d_em @ p["wo"].T
        dh_all = np.stack([d_out[..., :h], d_out[::-1, :, h:]], 1)
        length = len(d_em)
        dz = np.empty_like(gates)
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
        wht = np.swapaxes(p["wh"], 1, 2)
        for t in range(length - 1, -1, -1):
            i, f, o, c = (gates[t][..., k * h : (k + 1) * h] for k in range(4))
            dh = (dh + dh_all[t]) * m[t]
            dc = dc + dh * o * (1 - tc[t] ** 2)
            dc = dc * m[t]
            z = dz[t]
            z[..., :h] = dc * c * i * (1 - i)
            z[..., h : 2 * h] = dc * cs[t] * f * (1 - f)
            z[..., 2 * h : 3 * h] = dh * tc[t] * o * (1 - o)
            z[..., 3 * h :] = dc * i * (1 - c**2)
            dc = dc * f
            dh = np.matmul(z, wht)
        g["wh"] = np.einsum("ldbi,ldbk->dik", hs[:-1], dz, optimize=True)
        g["wx"] = np.einsum("ldbi,ldbk->dik", e, dz, optimize=True)
        g["b"] = dz.sum((0, 2))[:, None]
        de = np.matmul(dz, np.swapaxes(p["wx"], 1, 2)[None])
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], both.ravel(), de.reshape(-1, de.shape[-1]))
        return g

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        em, kept = self._forward(x, mask)
        tr, st = self.p["tr"], self.p["st"]
        length, batch, k = em.shape
        on = mask[..., None]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = st + em[0]
        for t in range(1, length):
            s = alpha[t - 1][:, :, None] + tr
            top = s.max(1)
            new = top + np.log(np.exp(s - top[:, None]).sum(1)) + em[t]
            alpha[t] = np.where(on[t] > 0, new, alpha[t - 1])
        for t in range(length - 2, -1, -1):
            s = tr + (em[t + 1] + beta[t + 1])[:, None, :]
            top = s.max(2)
            new = top + np.log(np.exp(s - top[..., None]).sum(2))
            beta[t] = np.where(on[t + 1] > 0, new, 0)
        top = alpha[-1].max(1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        own = np.eye(k, dtype=np.float32)[y]
        d_em = (np.exp(alpha + beta - z[:, None]) - own) * on
        # pairs of neighbouring tags: expected less observed
        d_tr = np.zeros_like(tr)
        for t in range(1, length):
            s = alpha[t - 1][:, :, None] + tr + (em[t] + beta[t])[:, None, :] - z[:, None, None]
            d_tr += (np.exp(s) * on[t][..., None]).sum(0) - np.einsum("bi,bj->ij", own[t - 1], own[t] * on[t])
        score = (st[y[0]] + np.take_along_axis(em[0], y[0][:, None], 1)[:, 0]).sum()
        score += ((tr[y[:-1], y[1:]] + np.take_along_axis(em[1:], y[1:][..., None], 2)[..., 0]) * mask[1:]).sum()
        g = self._backward(d_em / batch, kept)
        g["tr"], g["st"] = d_tr / batch, d_em[0].sum(0) / batch
        return float(z.sum() - score) / batch, g

    def decode(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (length, batch), and how far each tag's emission is above tag 0's."""
        em, _ = self._forward(x, mask)
        tr = self.p["tr"]
        length, batch, k = em.shape
        score, back = self.p["st"] + em[0], np.zeros((length, batch, k), np.int8)
        for t in range(1, length):
            s = score[:, :, None] + tr
            back[t] = s.argmax(1)
            new = s.max(1) + em[t]
            live = mask[t][:, None] > 0
            score = np.where(live, new, score)
            back[t] = np.where(live, back[t], np.arange(k, dtype=np.int8))
        tags = np.zeros((length, batch), np.int64)
        tags[-1] = score.argmax(1)
        rows = np.arange(batch)
        for t in range(length - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        tags = np.where(mask > 0, tags, 0)
        return tags, np.take_along_axis(em, tags[..., None], 2)[..., 0] - em[..., 0]

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, *, epochs: int = 6, batch: int = 64, rate: float = 0.012, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; x, mask and y are (windows, length)."""
        r, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        losses, steps = [], epochs * max(1, len(x) // batch)
        for _ in range(epochs):
            order, total = r.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                value, g = self.loss(np.ascontiguousarray(x[at].T), np.ascontiguousarray(mask[at].T), np.ascontiguousarray(y[at].T))
                total += value * len(at)
                norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
                t += 1
                step = rate * max(0.05, 1 - t / (steps + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k in self.p:
                    a = g[k].astype(np.float32) * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.p[k] = (self.p[k] - step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses
