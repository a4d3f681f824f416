"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """params: for either direction input, recurrent and bias weights; output weights and bias; CRF transitions, first and last tag scores."""

    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, classes: int, tags: int, hidden: int = 16, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        params = {}
        for d in "fb":
            params |= {f"x{d}": draw(classes, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            params[f"c{d}"][hidden : 2 * hidden] = 1
        params |= {"out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "move": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32)}
        return cls(params)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x (rows, steps) of character classes; hidden states (steps, rows, hidden), and what the way back needs."""
        rows, steps = x.shape
        wx, wh, c0 = self.params[f"x{d}"], self.params[f"h{d}"], self.params[f"c{d}"]
        n = wh.shape[0]
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        out, kept = np.zeros((steps, rows, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[:, t]] + h @ wh + c0
            s = _sigmoid(z[:, : 3 * n])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, th))
            h, c = o * th, new
            out[t] = h
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(rows, steps, tags)."""
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return (both @ self.params["out"] + self.params["bias"]).transpose(1, 0, 2)

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y over rows, and its gradients. mask (rows, steps): True up to each row's end."""
        p = self.params
        rows, steps = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e = (both @ p["out"] + p["bias"]).astype(np.float64)  # steps, rows, tags
        tags = e.shape[2]
        move = p["move"].astype(np.float64)
        alpha = np.zeros_like(e)
        alpha[0] = e[0] + p["first"]
        for t in range(1, steps):
            alpha[t] = np.where(mask[:, t, None], e[t] + _lse(alpha[t - 1][:, :, None] + move, 1), alpha[t - 1])
        z = _lse(alpha[-1] + p["last"], 1)
        beta = np.zeros_like(e)
        beta[-1] = p["last"]
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(mask[:, t + 1, None], _lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2), p["last"])
        grad = {k: np.zeros(v.shape, np.float64) for k, v in p.items()}
        de = np.exp(alpha + beta - z[:, None]) * mask.T[:, :, None]
        at = np.arange(rows)
        score = e[0, at, y[:, 0]] + p["first"][y[:, 0]]
        grad["first"] = de[0].sum(axis=0) - np.bincount(y[:, 0], minlength=tags)
        end = mask.sum(axis=1) - 1
        final = y[at, end]
        score = score + p["last"][final]
        grad["last"] = np.exp(alpha[end, at] + p["last"] - z[:, None]).sum(axis=0) - np.bincount(final, minlength=tags)
        for t in range(1, steps):
            on = mask[:, t]
            score = score + on * (e[t, at, y[:, t]] + move[y[:, t - 1], y[:, t]])
            both_tags = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            grad["move"] += (both_tags * on[:, None, None]).sum(axis=0)
            np.add.at(grad["move"], (y[on, t - 1], y[on, t]), -1)
        for t in range(steps):
            on = mask[:, t]
            de[t, at[on], y[on, t]] -= 1
        de /= rows
        for k in ("first", "last", "move"):
            grad[k] /= rows
        grad["out"] = np.einsum("trh,trk->hk", both, de)
        grad["bias"] = de.sum(axis=(0, 1))
        dboth = de @ p["out"].T.astype(np.float64)
        n = p["hf"].shape[0]
        for d, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            dh, dc = np.zeros((rows, n)), np.zeros((rows, n))
            wh = p[f"h{d}"]
            for t, h, c, i, f, o, g, th in reversed(runs[d][1]):
                dh = dh + dboth[t, :, part]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                np.add.at(grad[f"x{d}"], x[:, t], dz)
                grad[f"h{d}"] += h.T @ dz
                grad[f"c{d}"] += dz.sum(axis=0)
                dh, dc = dz @ wh.T, dc * f
        return float((z - score).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 160, batch: int = 64, rate: float = 0.03, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; the loss of each step. No rows: nothing changes."""
        rng, losses = np.random.default_rng(seed), []
        first, second = ({k: np.zeros(v.shape) for k, v in self.params.items()} for _ in "ab")
        order = np.zeros(0, np.int64)
        for step in range(1, steps + 1 if len(x) else 1):
            if len(order) < min(batch, len(x)):
                order = rng.permutation(len(x))
            own, order = order[:batch], order[batch:]
            value, grad = self.loss(x[own], y[own], mask[own])
            losses.append(value)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.params[k] = (self.params[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one sequence of emissions (steps, tags)."""
        p = self.params
        steps, tags = e.shape
        back = np.zeros((steps, tags), np.uint8)
        score = e[0] + p["first"]
        for t in range(1, steps):
            ways = score[:, None] + p["move"]
            back[t] = ways.argmax(axis=0)
            score = ways.max(axis=0) + e[t]
        out = np.zeros(steps, np.int64)
        out[-1] = int((score + p["last"]).argmax())
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out
