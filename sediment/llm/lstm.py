"""A bidirectional LSTM with a sigmoid for each step, forward and backward passes, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BiLSTM:
    def __init__(self, inputs: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.inputs, self.hidden = inputs, hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[side + "x"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
            self.p[side + "h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p[side + "c"] = np.zeros(4 * hidden)
            self.p[side + "c"][hidden : 2 * hidden] = 1.0  # remember at first
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden)
        self.p["d"] = rng.normal(0, 1 / np.sqrt(inputs), inputs)
        self.p["b"] = np.zeros(1)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction. x: (steps, rows, inputs); behind a row's end its state stays."""
        steps, rows, _ = x.shape
        n = self.hidden
        h, c = np.zeros((rows, n), x.dtype), np.zeros((rows, n), x.dtype)
        out, tape = np.zeros((steps, rows, n), x.dtype), []
        weights, gates = self.p[side + "h"].astype(x.dtype, copy=False), x @ self.p[side + "x"].astype(x.dtype, copy=False) + self.p[side + "c"].astype(x.dtype, copy=False)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ weights
            s = _sigmoid(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep:
                tape.append((t, h, c, i, f, o, g, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c2, c)
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0]
        n = self.hidden
        return f @ self.p["o"][:n] + b @ self.p["o"][n:] + x @ self.p["d"] + self.p["b"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n = self.hidden
        f, tape_f = self._run("f", x, mask, True)
        b, tape_b = self._run("b", x, mask, True)
        p = _sigmoid(f @ self.p["o"][:n] + b @ self.p["o"][n:] + x @ self.p["d"] + self.p["b"])
        count = max(1, int(mask.sum()))
        loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum()) / count
        e = (p - y) * mask / count
        g = {"o": np.concatenate([np.einsum("tr,trn->n", e, f), np.einsum("tr,trn->n", e, b)]), "d": np.einsum("tr,trn->n", e, x), "b": np.array([e.sum()])}
        for side, tape, w in (("f", tape_f, self.p["o"][:n]), ("b", tape_b, self.p["o"][n:])):
            gx, gh, gc = np.zeros_like(self.p[side + "x"]), np.zeros_like(self.p[side + "h"]), np.zeros(4 * n)
            dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
            for t, h0, c0, i, fg, o, gg, th, m in reversed(tape):
                dh = dh + e[t][:, None] * w
                do = dh * th * o * (1 - o)
                d = dc + dh * o * (1 - th * th)
                dz = np.concatenate([d * gg * i * (1 - i), d * c0 * fg * (1 - fg), do, d * i * (1 - gg * gg)], axis=1) * m
                gx += x[t].T @ dz
                gh += h0.T @ dz
                gc += dz.sum(axis=0)
                back = dz @ self.p[side + "h"].T
                dh, dc = np.where(m, back, dh), np.where(m, d * fg, dc)
            g |= {side + "x": gx, side + "h": gh, side + "c": gc}
        return loss, g

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int, rows: int = 32, rate: float = 0.01, seed: int = 3) -> float:
        """Adam over batches of sequences of like length; the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        order = np.argsort([len(s) for s in sequences], kind="stable")
        batches = [order[a : a + rows] for a in range(0, len(order), rows)]
        m, v, step, mean = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0, 0.0
        for epoch in range(epochs):
            mean = 0.0
            for k in rng.permutation(len(batches)):
                x, mask, y = padded([sequences[i] for i in batches[k]], [labels[i] for i in batches[k]])
                loss, g = self.gradients(x, mask, y)
                mean += loss / len(batches)
                step += 1
                scale = min(1.0, 5.0 / (np.sqrt(sum((q * q).sum() for q in g.values())) + 1e-9))
                for name, q in g.items():
                    q = q * scale
                    m[name] = 0.9 * m[name] + 0.1 * q
                    v[name] = 0.999 * v[name] + 0.001 * q * q
                    self.p[name] -= rate * (0.3 if epoch >= epochs * 2 // 3 else 1.0) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return mean


def padded(sequences: list[np.ndarray], labels: list[np.ndarray] | None = None, dtype=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, rows, inputs), the mask of real steps, and labels."""
    steps = max(len(s) for s in sequences)
    x = np.zeros((steps, len(sequences), sequences[0].shape[1]), dtype)
    mask, y = np.zeros((steps, len(sequences)), bool), np.zeros((steps, len(sequences)))
    for r, s in enumerate(sequences):
        x[: len(s), r], mask[: len(s), r] = s, True
        if labels is not None:
            y[: len(s), r] = labels[r]
    return x, mask, y
