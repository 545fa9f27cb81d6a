"""A small bidirectional gated recurrent network in numpy: the batch runs along the last axis, so that each step is a few wide operations.

Used with table inputs: a step's input is a number that picks columns of a projected input table.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def direction(rng: np.random.Generator, hidden: int, inputs: int) -> dict[str, np.ndarray]:
    """Weights of one direction: W for the inputs, U for the state, b; rows are update, reset and candidate."""
    return {
        "W": (rng.standard_normal((3 * hidden, inputs)) / np.sqrt(inputs)).astype(F32),
        "U": (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(F32),
        "b": np.zeros((3 * hidden, 1), F32),
    }


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray | None = None, keep: bool = False):
    """States over time. x: (time, 3 hidden, batch), projected inputs with bias; mask: (time, batch), 0 where the state stays.

    Returns the states (time, hidden, batch), and with keep what backward() needs.
    """
    t, three, n = x.shape
    k = three // 3
    h = np.zeros((k, n), F32)
    out = np.empty((t, k, n), F32)
    held = []
    uz, un = p["U"][: 2 * k], p["U"][2 * k :]
    for s in range(t):
        g = sigmoid(x[s, : 2 * k] + uz @ h)
        u = un @ h
        c = np.tanh(x[s, 2 * k :] + g[k:] * u)
        z = g[:k] if mask is None else g[:k] * mask[s] + (1 - mask[s])
        new = c + z * (h - c)
        if keep:
            held.append((h, g, u, c, z))
        out[s] = h = new
    return (out, held) if keep else out


def backward(p: dict[str, np.ndarray], held: list, d_out: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the projected inputs (time, 3 hidden, batch) and of U."""
    t, k, n = d_out.shape
    dx = np.empty((t, 3 * k, n), F32)
    du = np.zeros_like(p["U"])
    uz, un = p["U"][: 2 * k], p["U"][2 * k :]
    dh = np.zeros((k, n), F32)
    for s in range(t - 1, -1, -1):
        h, g, u, c, z = held[s]
        dh = dh + d_out[s]
        dz = dh * (h - c)
        if mask is not None:
            dz = dz * mask[s]
        dc = dh * (1 - z) * (1 - c * c)
        dr = dc * u
        r = g[k:]
        dg = np.concatenate([dz, dr]) * g * (1 - g)
        dx[s, : 2 * k], dx[s, 2 * k :] = dg, dc
        dcu = dc * r
        du[: 2 * k] += dg @ h.T
        du[2 * k :] += dcu @ h.T
        dh = dh * z + uz.T @ dg + un.T @ dcu
    return dx, du


class Adam:
    """Adam over a dictionary of arrays, with clipped gradients."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * F32(clip)
            self.m[k] += F32(0.1) * (g - self.m[k])
            self.v[k] += F32(0.001) * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.n), self.v[k] / (1 - 0.999**self.n)
            self.p[k] -= (self.rate * scale * m / (np.sqrt(v) + 1e-8)).astype(F32)
