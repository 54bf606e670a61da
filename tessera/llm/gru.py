"""A bidirectional gated recurrent network over bytes, in numpy: forward, backpropagation through time."""

from __future__ import annotations

import numpy as np

PAD = 256  # the code of positions beyond a text's end


def initial_weights(classes: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """For each direction d: what a byte adds to the gates (x), what the state adds (u), biases (b);
    and the output's weights (v) and biases (c). Gates in rows: update, reset, candidate."""
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w["x" + d] = rng.normal(0, 0.3, (3 * hidden, PAD + 1))
        w["u" + d] = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden))
        w["b" + d] = np.zeros((3 * hidden, 1))
    w["v"] = rng.normal(0, 0.3, (classes, 2 * hidden))
    w["c"] = np.zeros((classes, 1))
    return {k: x.astype(np.float32) for k, x in w.items()}


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the squashing function of gates and candidates, several times
    cheaper than exponentials. Its slope is (1 - |y|)**2."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _slope(gate: np.ndarray) -> np.ndarray:
    """Of a gate, which is (1 + softsign) / 2."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


def _run(w: dict, d: str, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each step of one direction, [time, hidden, batch], zero outside of the texts, so that a
    text's first state follows from its first byte alone; what backward needs, if kept."""
    steps, batch = data.shape
    x, u, b = w["x" + d], w["u" + d], w["b" + d]
    n = u.shape[1]
    states = np.empty((steps, n, batch), dtype=np.float32)
    h = np.zeros((n, batch), dtype=np.float32)
    saved = []
    real = data != PAD
    whole = real.all(axis=1)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = np.take(x, data[t], axis=1, mode="clip")
        m = u @ h
        m += b
        gates = a[: 2 * n]
        gates += m[: 2 * n]
        _softsign(gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:n], gates[n:]
        c = m[2 * n :] * r
        c += a[2 * n :]
        _softsign(c)
        new = h - c
        new *= z
        new += c
        if not whole[t]:
            new *= real[t]
        if keep:
            saved.append((t, h, z, r, c, m[2 * n :]))
        h = states[t] = new
    return states, saved


def probabilities(w: dict, data: np.ndarray) -> np.ndarray:
    """The classes' probabilities at each position of data [time, batch]: [classes, time, batch]."""
    steps, batch = data.shape
    n = w["uf"].shape[1]
    out = w["v"][:, :n] @ _run(w, "f", data, False)[0] + w["v"][:, n:] @ _run(w, "b", data, False)[0]
    out = np.moveaxis(out, 1, 0) + w["c"][:, :, None]
    out -= out.max(axis=0)
    np.exp(out, out=out)
    out /= out.sum(axis=0)
    return out


def gradients(w: dict, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the positions within the texts, and its gradient by every weight."""
    steps, batch = data.shape
    n = w["uf"].shape[1]
    runs = {d: _run(w, d, data, True) for d in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
    logits = w["v"] @ both + w["c"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    real = (data != PAD).astype(np.float32)
    count = max(real.sum(), 1)
    at = (np.arange(steps)[:, None], labels[None, :], np.arange(batch)[None, :])
    loss = float(-(np.log(np.maximum(p[at], 1e-9)) * real).sum() / count)
    p[at] -= 1
    p *= real[:, None, :] / count
    g = {k: np.zeros_like(x) for k, x in w.items()}
    g["v"] = np.einsum("tcb,thb->ch", p, both, optimize=True)
    g["c"] = p.sum(axis=(0, 2))[:, None]
    back = w["v"].T @ p
    for d, part in (("f", back[:, :n]), ("b", back[:, n:])):
        u, carry = w["u" + d], np.zeros((n, batch), dtype=np.float32)
        one_hot = np.zeros((PAD + 1, batch), dtype=np.float32)
        for t, h, z, r, c, m in reversed(runs[d][1]):
            dh = (part[t] + carry) * real[t]
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (h - c) * _slope(z)
            dr = dc * m * _slope(r)
            da = np.concatenate([dz, dr, dc])
            dm = np.concatenate([dz, dr, dc * r])
            g["u" + d] += dm @ h.T
            g["b" + d] += dm.sum(axis=1, keepdims=True)
            one_hot[data[t], np.arange(batch)] = 1
            g["x" + d] += da @ one_hot.T
            one_hot[data[t], np.arange(batch)] = 0
            carry = dh * z + u.T @ dm
    return loss, g


def train(data: np.ndarray, labels: np.ndarray, classes: int, hidden: int, epochs: int, batch: int, seed: int) -> dict[str, np.ndarray]:
    """Weights fitted to data [time, examples] by Adam, the same for the same input."""
    rng = np.random.default_rng(seed)
    w = initial_weights(classes, hidden, seed)
    first = {k: np.zeros_like(x) for k, x in w.items()}
    second = {k: np.zeros_like(x) for k, x in w.items()}
    steps, total = 0, max(1, epochs * -(-data.shape[1] // batch))
    for _ in range(epochs):
        order = rng.permutation(data.shape[1])
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            _, g = gradients(w, data[:, chosen], labels[chosen])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            steps += 1
            rate = 0.02 * (1 - (steps - 1) / total) + 0.001
            for k, x in g.items():
                x = x * min(1.0, 2.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                w[k] -= (rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return w
