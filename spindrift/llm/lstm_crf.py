"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of padded windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters told apart: ASCII by itself, other letters, other digits and all else by class.
N_CHARS = 131


def encode(text: str) -> np.ndarray:
    return np.array([o if (o := ord(c)) < 128 else 128 if c.isalpha() else 129 if c.isdigit() else 130 for c in text], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tags: int, embed: int = 12, hidden: int = 20, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        w = {"E": rng.normal(0, 0.3, (N_CHARS, embed))}
        for side in "fb":
            w |= {f"W{side}": rng.normal(0, 0.25, (embed, 4 * hidden)), f"U{side}": rng.normal(0, 0.25, (hidden, 4 * hidden)), f"b{side}": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}
        return cls(w | {"V": rng.normal(0, 0.25, (2 * hidden, tags)), "c": np.zeros(tags), "T": np.zeros((tags, tags))})

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """Hidden states (steps, rows, hidden) of one direction; the mask keeps the state still over padding."""
        w, u, b = (self.weights[f"{k}{side}"] for k in "WUb")
        steps, rows, h = x.shape[0], x.shape[1], u.shape[0]
        state, cell, out, held = np.zeros((rows, h)), np.zeros((rows, h)), np.zeros((steps, rows, h)), [None] * steps
        inputs = x @ w + b
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gates = inputs[t] + state @ u
            f, i, o = _sigmoid(gates[:, :h]), _sigmoid(gates[:, h : 2 * h]), _sigmoid(gates[:, 2 * h : 3 * h])
            g = np.tanh(gates[:, 3 * h :])
            new = f * cell + i * g
            th = np.tanh(new)
            m = mask[t][:, None]
            held[t] = (f, i, o, g, cell, th, state, m)
            cell, state = np.where(m, new, cell), np.where(m, o * th, state)
            out[t] = state
        return out, held

    def emissions(self, codes: np.ndarray, lengths: np.ndarray):
        """Scores (steps, rows, tags) of padded rows of character codes, and what training needs of the way."""
        steps = codes.shape[1]
        mask = np.arange(steps)[:, None] < lengths[None, :]
        x = self.weights["E"][codes.T]
        forward, hf = self._pass(x, mask, "f")
        backward, hb = self._pass(x, mask, "b")
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.weights["V"] + self.weights["c"], (x, mask, both, hf, hb)

    def decode(self, codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The best tag sequence of each row (Viterbi)."""
        scores, _ = self.emissions(codes, lengths)
        t_scores = self.weights["T"]
        best, back = scores[0], []
        for t in range(1, len(scores)):
            ways = best[:, :, None] + t_scores[None]
            back.append(ways.argmax(axis=1))
            best = np.where((t < lengths)[:, None], ways.max(axis=1) + scores[t], best)
        tag = best.argmax(axis=1)
        out = np.zeros((len(scores), len(lengths)), np.int64)
        rows = np.arange(len(lengths))
        for t in range(len(scores) - 1, -1, -1):
            out[t] = tag
            if t:
                tag = np.where(t < lengths, back[t - 1][rows, tag], tag)
        return [out[:n, k] for k, n in enumerate(lengths.tolist())]

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood per row, and its gradients."""
        w = self.weights
        scores, (x, mask, both, hf, hb) = self.emissions(codes, lengths)
        steps, rows, k = scores.shape
        t_scores, alpha = w["T"], [scores[0]]
        log_sum = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
        for t in range(1, steps):
            alpha.append(np.where(mask[t][:, None], log_sum(alpha[-1][:, :, None] + t_scores[None], 1) + scores[t], alpha[-1]))
        z = log_sum(alpha[-1], 1)
        beta = np.zeros((rows, k))
        d_scores, d_t, gold = np.zeros_like(scores), np.zeros_like(t_scores), np.zeros(rows)
        row = np.arange(rows)
        for t in range(steps - 1, -1, -1):
            m = mask[t][:, None]
            d_scores[t] = np.where(m, np.exp(np.minimum(alpha[t] + beta - z[:, None], 0)), 0)
            d_scores[t][row, tags[:, t]] -= mask[t]
            gold += np.where(mask[t], scores[t][row, tags[:, t]], 0)
            if t:
                pair = alpha[t - 1][:, :, None] + t_scores[None] + (scores[t] + beta)[:, None, :] - z[:, None, None]
                d_t += (np.exp(np.minimum(pair, 0)) * mask[t][:, None, None]).sum(axis=0)
                np.subtract.at(d_t, (tags[mask[t], t - 1], tags[mask[t], t]), 1)
                gold += np.where(mask[t], t_scores[tags[:, t - 1], tags[:, t]], 0)
                beta = np.where(m, log_sum(t_scores[None] + (scores[t] + beta)[:, None, :], 2), beta)
        grads = {"T": d_t, "c": d_scores.sum(axis=(0, 1)), "V": np.einsum("tnh,tnk->hk", both, d_scores)}
        d_both, d_x = d_scores @ w["V"].T, np.zeros_like(x)
        h = w["Uf"].shape[0]
        for side, held, d_out in (("f", hf, d_both[:, :, :h]), ("b", hb, d_both[:, :, h:])):
            d_w, d_u, d_b = np.zeros_like(w[f"W{side}"]), np.zeros_like(w[f"U{side}"]), np.zeros_like(w[f"b{side}"])
            d_state, d_cell = np.zeros((rows, h)), np.zeros((rows, h))
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                f, i, o, g, cell, th, before, m = held[t]
                d_state = d_state + d_out[t]
                now = np.where(m, d_state, 0)
                d_new = np.where(m, d_cell, 0) + now * o * (1 - th * th)
                d_gates = np.concatenate([d_new * cell * f * (1 - f), d_new * g * i * (1 - i), now * th * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
                d_w += x[t].T @ d_gates
                d_u += before.T @ d_gates
                d_b += d_gates.sum(axis=0)
                d_x[t] += d_gates @ w[f"W{side}"].T
                d_state = np.where(m, d_gates @ w[f"U{side}"].T, d_state)
                d_cell = np.where(m, d_new * f, d_cell)
            grads |= {f"W{side}": d_w, f"U{side}": d_u, f"b{side}": d_b}
        grads["E"] = np.zeros_like(w["E"])
        np.add.at(grads["E"], codes.T, d_x)
        return float((z - gold).mean()), {name: g / rows for name, g in grads.items()}


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), max(1, int(lengths.max(initial=1)))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, lengths


def train(texts: list[np.ndarray], tags: list[np.ndarray], n_tags: int, epochs: int = 8, batch: int = 48, rate: float = 0.012, seed: int = 7) -> Model:
    """Adam on batches of windows of like length."""
    model, rng = Model.fresh(n_tags, seed=seed), np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            codes, lengths = pad([texts[k] for k in pick])
            wanted, _ = pad([tags[k] for k in pick])
            _, grads = model.gradients(codes, lengths, wanted)
            step += 1
            scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads.values()))))
            now = rate * (1 - epoch / (epochs + 1))
            for k, g in grads.items():
                g = g * scale
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.995 * m2[k] + 0.005 * g * g
                model.weights[k] -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.995**step)) + 1e-8)
    return model
