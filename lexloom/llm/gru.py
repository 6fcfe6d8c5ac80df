"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time.

Every byte position of a sequence gets a distribution over the labels. Gates and states are piecewise linear (clipped sums) instead of sigmoid and tanh: on
a CPU that is most of the time. Arrays are laid out by feature, then by sequence, so that every step works on whole blocks. Shorter sequences are
padded at their end; the state stays zero there, so what a sequence gets does not depend on the others beside it.
"""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np

F32 = np.float32


@contextmanager
def one_thread():
    """Small matrices are multiplied faster by one thread: numpy's own OpenBLAS, where it is one, is held to that for a while."""
    calls = []
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        try:
            lib = ctypes.CDLL(path)
        except OSError:
            continue
        for get, put in (("scipy_openblas_get_num_threads64_", "scipy_openblas_set_num_threads64_"), ("openblas_get_num_threads", "openblas_set_num_threads")):
            if hasattr(lib, get) and hasattr(lib, put):
                calls.append((getattr(lib, put), getattr(lib, get)()))
                break
    for put, _ in calls:
        put(1)
    try:
        yield
    finally:
        for put, before in calls:
            put(before)


class ByteGRU:
    """``W``: what a byte adds to the gates; ``U``: what the state adds; ``b``: their offsets; ``V``, ``c``: from both directions' states to the labels."""

    def __init__(self, labels: int, hidden: int = 16, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.labels = h, labels
        self.p = {"V": rng.normal(0, (2 * h) ** -0.5, (2 * h, labels)).astype(F32), "c": np.zeros(labels, F32)}
        for d in "fb":
            offsets = np.r_[np.full(2 * h, 0.5), np.zeros(h)].astype(F32)
            self.p |= {"W" + d: rng.normal(0, 0.15, (256, 3 * h)).astype(F32), "U" + d: rng.normal(0, 0.4 * h**-0.5, (h, 3 * h)).astype(F32), "b" + d: offsets}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, states: np.ndarray, kept: list | None = None) -> None:
        """Fill ``states`` (T, H, B) of one direction for bytes (T, B) in its order; what the backward pass needs goes to ``kept``."""
        h, (steps, batch) = self.hidden, x.shape
        kind = self.p["V"].dtype
        table, u = np.ascontiguousarray((self.p["W" + d] + self.p["b" + d]).T), np.ascontiguousarray(self.p["U" + d].T)
        every = live.all(1)
        state = np.zeros((h, batch), kind)
        gates, both = np.empty((3 * h, batch), kind), np.empty((3 * h, batch), kind)
        for t in range(steps):
            if kept is not None:
                gates, both = np.empty_like(gates), np.empty_like(both)
            np.take(table, x[t], axis=1, out=gates, mode="clip")
            np.dot(u, state, out=both)
            zr, n = gates[: 2 * h], gates[2 * h :]
            zr += both[: 2 * h]
            np.maximum(zr, 0, out=zr)
            np.minimum(zr, 1, out=zr)
            n += zr[h:] * both[2 * h :] if kept is not None else np.multiply(zr[h:], both[2 * h :], out=both[2 * h :])
            np.maximum(n, -1, out=n)
            np.minimum(n, 1, out=n)
            if kept is not None:
                kept.append((state, gates, both[2 * h :]))
            new = states[t]
            np.subtract(state, n, out=new)
            new *= zr[:h]
            new += n
            if not every[t]:
                new *= live[t].astype(kind)
            state = new

    def _states(self, x: np.ndarray, live: np.ndarray, kept_f: list | None = None, kept_b: list | None = None) -> np.ndarray:
        """States of both directions (T, 2H, B), in the order of the bytes."""
        h = self.hidden
        x = x.astype(np.intp)
        states = np.empty((len(x), 2 * h, x.shape[1]), self.p["V"].dtype)
        self._run(x, live, "f", states[:, :h], kept_f)
        self._run(x[::-1], live[::-1], "b", states[::-1, h:], kept_b)
        return states

    def _out(self, states: np.ndarray) -> np.ndarray:
        o = np.matmul(self.p["V"].T, states)
        o += self.p["c"][:, None]
        return o

    def _softmax(self, o: np.ndarray) -> np.ndarray:
        if np.abs(self.p["V"]).sum(0).max() + np.abs(self.p["c"]).max() > 60:  # states are within -1 and 1, so below that no power overflows
            o -= o.max(1, keepdims=True)
        o -= np.log(np.exp(o).sum(1, keepdims=True))
        return o

    def log_probs(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """(T, labels, B) for bytes (T, B) of which those where ``live`` is set belong to the sequences.

        Sequences in ascending order of length, each from the first row on, are read without their padding; what is there is that of a state of zero."""
        first = x.shape[1] - live.sum(1)  # of the sequences that go on
        if not len(x) or not (live == (np.arange(x.shape[1]) >= first[:, None])).all() or (np.diff(first) < 0).any():
            return self._softmax(self._out(self._states(x, live)))
        x = x.astype(np.intp)
        out = np.empty((len(x), self.labels, x.shape[1]), self.p["V"].dtype)
        out[:] = self.p["c"][:, None]
        for d, v in zip("fb", (self.p["V"][: self.hidden], self.p["V"][self.hidden :])):
            self._read(x, first, d, np.ascontiguousarray(v.T), out)
        return self._softmax(out)

    def _read(self, x: np.ndarray, first: np.ndarray, d: str, v: np.ndarray, out: np.ndarray) -> None:
        """Add what one direction's states give to the labels, without keeping them. Here arrays are by gate, sequence and feature: a byte's part of a gate is one block of memory."""
        h, (steps, batch) = self.hidden, x.shape
        kind = v.dtype
        block = np.dtype((np.void, h * kind.itemsize))
        tables = [np.ascontiguousarray(q).view(block)[:, 0] for q in np.split(self.p["W" + d] + self.p["b" + d], 3, 1)]
        u = np.stack(np.split(self.p["U" + d], 3, 1))
        zero, one = kind.type(0), kind.type(1)
        state = np.zeros((batch, h), kind)
        all_gates, all_both = np.empty((3, batch, h), kind), np.empty((3, batch, h), kind)
        blocks = all_gates.view(block)[..., 0]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            k = first[t]
            s, gates, both, at = state[k:], all_gates[:, k:], all_both[:, k:], x[t, k:]
            for table, gate in zip(tables, blocks):
                table.take(at, out=gate[k:], mode="clip")
            np.matmul(s, u, out=both)
            zr, n = gates[:2], gates[2]
            zr += both[:2]
            zr.clip(zero, one, out=zr)
            both[2] *= zr[1]
            n += both[2]
            n.clip(-one, one, out=n)
            s -= n
            s *= zr[0]
            s += n
            out[t, :, k:] += np.dot(v, s.T)

    def gradients(self, x: np.ndarray, live: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients for bytes (T, B), the weight of each position (T, B; 0 for padding) and a label distribution (labels, B)."""
        h = self.hidden
        kept_f, kept_b = [], []
        states = self._states(x, live, kept_f, kept_b)
        logp = self._softmax(self._out(states))
        w = (weight / max(weight.sum(), 1e-9)).astype(logp.dtype)[:, None, :]
        loss = -float((logp * y * w).sum())
        d_out = (np.exp(logp) - y) * w
        flat = lambda q: q.transpose(1, 0, 2).reshape(q.shape[1], -1)
        o = flat(d_out)
        g = {"V": flat(states) @ o.T, "c": o.sum(1)}
        self._back(x, live, "f", kept_f, np.matmul(self.p["V"][:h], d_out), g)
        self._back(x[::-1], live[::-1], "b", kept_b, np.matmul(self.p["V"][h:], d_out)[::-1], g)
        return loss, g

    def _back(self, x: np.ndarray, live: np.ndarray, d: str, kept: list, d_states: np.ndarray, g: dict) -> None:
        h, u = self.hidden, self.p["U" + d]
        steps, batch = x.shape
        d_gates = np.empty((steps, 3 * h, batch), u.dtype)
        du = np.zeros_like(u)
        carry = np.zeros((h, batch), u.dtype)
        for t in range(steps - 1, -1, -1):
            state, gates, from_state = kept[t]
            z, r, n = gates[:h], gates[h : 2 * h], gates[2 * h :]
            ds = (d_states[t] + carry) * live[t]
            own = d_gates[t]
            own[:h] = ds * (state - n) * ((z > 0) & (z < 1))
            own[2 * h :] = ds * (1 - z) * (np.abs(n) < 1)
            own[h : 2 * h] = own[2 * h :] * from_state * ((r > 0) & (r < 1))
            back = own.copy()
            back[2 * h :] *= r
            du += state @ back.T
            carry = ds * z + u @ back
        rows = d_gates.transpose(0, 2, 1).reshape(-1, 3 * h)
        used, at = np.unique(x.ravel(), return_inverse=True)
        hot = np.zeros((len(used), rows.shape[0]), u.dtype)
        hot[at.ravel(), np.arange(rows.shape[0])] = 1
        dw = np.zeros_like(self.p["W" + d])
        dw[used] = hot @ rows
        g["W" + d], g["U" + d], g["b" + d] = dw, du, rows.sum(0)


def train(draw: Callable[[np.random.Generator], tuple], labels: int, steps: int = 500, hidden: int = 16, rate: float = 0.01, seed: int = 0) -> ByteGRU:
    """Fit a network to batches ``(bytes, live, weight, labels)`` that ``draw`` makes, with Adam and a falling rate."""
    with one_thread():
        net = ByteGRU(labels, hidden, seed)
        rng = np.random.default_rng(seed + 1)
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        v = {k: np.zeros_like(x) for k, x in net.p.items()}
        for step in range(1, steps + 1):
            _, g = net.gradients(*draw(rng))
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * min(1.0, step / 30) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * step / steps)))
            for k, q in g.items():
                q = q * F32(scale)
                m[k] += F32(0.1) * (q - m[k])
                v[k] += F32(0.01) * (q * q - v[k])
                net.p[k] -= F32(lr) * (m[k] / F32(1 - 0.9**step)) / (np.sqrt(v[k] / F32(1 - 0.99**step)) + F32(1e-6))
        return net
