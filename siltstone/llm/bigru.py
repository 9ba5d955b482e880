"""A bidirectional gated recurrent network over the bytes of whole texts, in numpy.

A step reads two bytes, and the scores of both directions' states after it label
its two positions.  Gates and states use ``x / (1 + |x|)`` as their curve, which
costs a tenth of a hyperbolic tangent.  Training is backpropagation through time
of the cross entropy of all positions.  Texts of any length are run in windows
of ``WINDOW`` steps with ``CONTEXT`` more on each side, many windows at once.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np

WINDOW, CONTEXT, LANES = 256, 16, 1024


def _curve(x: np.ndarray, spare: np.ndarray) -> None:
    """``x / (1 + |x|)`` in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


class BiGRU:
    def __init__(self, labels: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)

        def w(*s: int, by: float) -> np.ndarray:
            return (r.standard_normal(s) * by).astype(np.float32)

        # Input weights by direction, place in the step and byte; recurrent weights; output weights by direction.
        self.hidden, self.scale, self._pairs = hidden, 0.1, None
        self.p = {f"{g}x": w(2, 2, 256, hidden, by=0.4) for g in "zrc"} | {f"{g}h": w(2, hidden, hidden, by=hidden**-0.5) for g in "zrc"}
        self.p |= {"O": w(2, hidden, labels, by=hidden**-0.5), "o": np.zeros(labels, np.float32)}

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, scale=np.float64(self.scale), **self.p)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> BiGRU:
        net = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            net.p = {k: f[k] for k in f.files if k != "scale"}
            net.scale, net.hidden, net._pairs = float(f["scale"]), f["zh"].shape[1], None
        return net

    def pairs(self) -> dict[str, np.ndarray]:
        """Input weights of every pair of bytes by direction, summed once."""
        if self._pairs is None:
            self._pairs = {g: (x[:, 0, :, None] + x[:, 1, None, :]).reshape(2 << 16, self.hidden) for g in "zrc" if (x := self.p[f"{g}x"]) is not None}
        return self._pairs

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """Scores (step, direction, lane, label) of byte pairs (step, direction, lane)."""
        p, (steps, _, lanes), tables = self.p, x.shape, self.pairs()
        shape = (2, lanes, self.hidden)
        h, z, r, c, e, spare = (np.zeros(shape, np.float32) for _ in range(6))
        half = 0.5 * p["ch"]
        out = np.empty((steps, 2, lanes, len(p["o"])), np.float32)
        for t in range(steps):
            for g, v in (("z", z), ("r", r)):
                np.matmul(h, p[f"{g}h"], out=v)
                v += np.take(tables[g], x[t], axis=0, out=e, mode="clip")
                _curve(v, spare)
                v += 1
            np.matmul(h, half, out=c)
            c *= r
            c += np.take(tables["c"], x[t], axis=0, out=e, mode="clip")
            _curve(c, spare)
            c -= h
            c *= z
            c *= 0.5
            h += c
            np.matmul(h, p["O"], out=out[t])
        return out

    def scores(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores, without the constant ``o``, of the byte pairs of texts at even places ``[starts, ends)`` of one buffer; windows keep inside their text."""
        labels = len(self.p["o"])
        pairs = text[: len(text) // 2 * 2].reshape(-1, 2).astype(np.int64) @ np.array([256, 1])
        out = np.zeros((len(pairs), labels), np.float32)
        starts, ends = starts // 2, (ends + 1) // 2
        n = -(-(ends - starts) // WINDOW)
        owner = np.repeat(np.arange(len(starts)), n)
        core = starts[owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        last = np.minimum(core + WINDOW, ends[owner])
        lo, hi = np.maximum(core - CONTEXT, starts[owner]), np.minimum(last + CONTEXT, ends[owner])
        order = np.argsort(lo - hi, kind="stable")
        for k in range(0, len(order), LANES):
            w = order[k : k + LANES]
            t = np.arange(int((hi - lo)[w[0]]))[:, None]
            x = np.empty((len(t), 2, len(w)), np.int64)
            # Past its end a window reads on in the buffer, after all that counts.
            x[:, 0] = pairs[np.minimum(lo[w] + t, len(pairs) - 1)]
            x[:, 1] = pairs[np.maximum(hi[w] - 1 - t, 0)]
            x[:, 1] += 1 << 16
            y = self._windows(x).reshape(-1, labels)
            inner = (last - core)[w]
            lane = np.repeat(np.arange(len(w)), inner)
            place = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + np.repeat(core[w], inner)
            got = np.take(y, (place - lo[w][lane]) * (2 * len(w)) + lane, axis=0, mode="clip")
            got += np.take(y, (hi[w][lane] - 1 - place) * (2 * len(w)) + len(w) + lane, axis=0, mode="clip")
            out[place] = got
        return out

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows ``x`` (step, lane, byte of the step) of full length and its gradients; ``target`` holds the steps' labels."""
        p, (steps, lanes, _), hid = self.p, x.shape, self.hidden
        both = np.stack([x, x[::-1]], axis=1)
        dt = p["o"].dtype
        kept = {k: np.empty((steps, 2, lanes, hid), dt) for k in "hzrcu"}
        out, h = np.empty((steps, 2, lanes, hid), dt), np.zeros((2, lanes, hid), dt)
        way = np.arange(2)[:, None]
        for t in range(steps):
            i = both[t]
            a = {}
            for g in "zr":
                v = h @ p[f"{g}h"] + p[f"{g}x"][way, 0, i[..., 0]] + p[f"{g}x"][way, 1, i[..., 1]]
                a[g] = v / (1 + np.abs(v))
            u = h @ p["ch"]
            v = 0.5 * (1 + a["r"]) * u + p["cx"][way, 0, i[..., 0]] + p["cx"][way, 1, i[..., 1]]
            c = v / (1 + np.abs(v))
            for k, v in zip("hzrcu", (h, a["z"], a["r"], c, u), strict=True):
                kept[k][t] = v
            h = out[t] = h + 0.5 * (1 + a["z"]) * (c - h)
        y = out[:, 0] @ p["O"][0] + out[::-1, 1] @ p["O"][1] + p["o"]
        y -= y.max(2, keepdims=True)
        q = np.exp(y)
        q /= q.sum(2, keepdims=True)
        place, lane = np.indices(target.shape)
        loss = float(-np.log(q[place, lane, target] + 1e-12).mean())
        q[place, lane, target] -= 1
        dy = q / target.size
        g = {"O": np.stack([np.tensordot(out[:, 0], dy, ((0, 1), (0, 1))), np.tensordot(out[::-1, 1], dy, ((0, 1), (0, 1)))]), "o": dy.sum((0, 1))}
        dout = np.stack([dy @ p["O"][0].T, (dy @ p["O"][1].T)[::-1]], axis=1)
        da = {k: np.empty_like(kept["h"]) for k in "zrc"}
        gh, dh = {k: np.zeros_like(p[f"{k}h"]) for k in "zrc"}, np.zeros_like(h)
        back = {k: p[f"{k}h"].transpose(0, 2, 1) for k in "zrc"}
        for t in range(steps - 1, -1, -1):
            h0, z, r, c, u = (kept[k][t] for k in "hzrcu")
            dh = dh + dout[t]
            gate = 0.5 * (1 + z)
            dc = dh * gate * (1 - np.abs(c)) ** 2
            dz = dh * (c - h0) * 0.5 * (1 - np.abs(z)) ** 2
            dr = dc * u * 0.5 * (1 - np.abs(r)) ** 2
            du = dc * 0.5 * (1 + r)
            past = h0.transpose(0, 2, 1)
            for k, d, into in (("z", dz, dz), ("r", dr, dr), ("c", dc, du)):
                da[k][t] = d
                gh[k] += past @ into
            dh = dh * (1 - gate) + dz @ back["z"] + dr @ back["r"] + du @ back["c"]
        for k in "zrc":
            g |= {f"{k}h": gh[k], f"{k}x": np.zeros_like(p[f"{k}x"])}
        for slot in range(2):
            at = (both[..., slot] + np.array([0, 256])[None, :, None]).ravel()
            order = np.argsort(at, kind="stable")
            seen, first = np.unique(at[order], return_index=True)
            for k in "zrc":
                g[f"{k}x"][seen >> 8, slot, seen & 255] = np.add.reduceat(da[k].reshape(-1, hid)[order], first, axis=0)
        return loss, g

    def fit(self, batch: Callable[[np.random.Generator], tuple[np.ndarray, np.ndarray]], steps: int, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over ``steps`` batches of windows and labels with a falling rate; returns the mean loss of the last tenth."""
        r, self._pairs = np.random.default_rng(seed), None
        m, v = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            loss, g = self.gradients(*batch(r))
            losses.append(loss)
            norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values())))
            cut, now = min(1.0, 1.0 / (norm + 1e-9)), rate * min(1.0, 1.05 - step / steps)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * cut * g[k]
                v[k] = 0.99 * v[k] + 0.01 * (cut * g[k]) ** 2
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
        return float(np.mean(losses[-max(1, steps // 10) :]))
