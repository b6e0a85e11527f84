"""A small causal self-attention model in numpy: scores and steps over batches of context windows.

A position is a word, seen through the ids of its subwords (hashed first and last bytes). One masked attention layer
over the positions before it predicts the class of the next word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HEADS, TAILS, CLASSES, DIMENSION = 4096, 1024, 64, 16
WINDOW, STRIDE = 32, 24
RATE, BATCH = 0.08, 64
# Names of the parameters in one order; those with a row per subword are averaged by use.
PARTS = ("heads", "tails", "places", "query", "key", "value", "mixed", "out", "bias")
BY_ROW = ("heads", "tails")


@dataclass
class Windows:
    """Index of each window's positions in a run of sequences, which of them exist, and which it scores."""

    at: np.ndarray
    live: np.ndarray
    scored: np.ndarray


def windows(sizes: np.ndarray, first: np.ndarray) -> Windows:
    """Windows over sequences of ``sizes`` positions that begin at ``first``; each position is scored in one window."""
    count = np.where(sizes > WINDOW, 1 + -(-(sizes - WINDOW) // STRIDE), 1)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    local = number[:, None] * STRIDE + np.arange(WINDOW)
    live = local < sizes[owner][:, None]
    scored = live & ((number == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    return Windows(np.where(live, first[owner][:, None] + local, first[owner][:, None]), live, scored)


class AttentionModel:
    def __init__(self, prior: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.15, shape).astype(np.float32)

        d = DIMENSION
        self.params = {
            # one more row each for the start of a text
            "heads": drawn(HEADS + 1, d),
            "tails": drawn(TAILS + 1, d),
            "places": drawn(WINDOW, d),
            "query": drawn(d, d) * 2,
            "key": drawn(d, d) * 2,
            "value": drawn(d, d) * 2,
            "mixed": drawn(d, d) * 2,
            "out": drawn(d, len(prior)),
            "bias": np.log(prior).astype(np.float32)[None],
        }
        self.rooms: dict[str, np.ndarray] = {}
        self.causal = np.where(np.triu(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)

    def _forward(self, head: np.ndarray, tail: np.ndarray) -> dict[str, np.ndarray]:
        """Activations of a batch of windows. Products with a parameter take all positions as one matrix; ``a`` has a row per key position
        and a column per asking one, so that the softmax runs down the columns."""
        p = self.params
        n, d = len(head), DIMENSION
        x = p["heads"].take(head, axis=0)
        x += p["tails"].take(tail, axis=0)
        x += p["places"]
        x = x.reshape(-1, d)
        q, k, v = ((x @ p[name]).reshape(n, -1, d) for name in ("query", "key", "value"))
        a = np.matmul(k, q.transpose(0, 2, 1), out=self._room("a", (n, WINDOW, WINDOW)))
        a *= DIMENSION**-0.5
        a += self.causal
        a -= a.max(axis=1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=1, keepdims=True)
        m = (a.transpose(0, 2, 1) @ v).reshape(-1, d)
        return {"x": x, "q": q, "k": k, "v": v, "a": a, "m": m, "y": x + m @ p["mixed"]}

    def _room(self, name: str, shape: tuple[int, ...]) -> np.ndarray:
        """An array that the batches take turns to use; one of a batch's size."""
        if name not in self.rooms or self.rooms[name].shape != shape:
            self.rooms[name] = np.empty(shape, np.float32)
        return self.rooms[name]

    def _classes(self, y: np.ndarray) -> np.ndarray:
        """Scores of the classes, a row each and a column per position, with each column's largest at 0."""
        z = np.matmul(self.params["out"].T, y.T, out=self._room("z", (self.params["out"].shape[1], len(y))))
        z += self.params["bias"].T
        z -= z.max(axis=0)
        return z

    def class_scores(self, head: np.ndarray, tail: np.ndarray, wanted: np.ndarray, w: Windows) -> np.ndarray:
        """log10 probability of the wanted class at every position, each taken from the window that scores it."""
        out = np.zeros(len(wanted))
        for first in range(0, len(w.at), BATCH):
            at, scored = w.at[first : first + BATCH], w.scored[first : first + BATCH]
            z = self._classes(self._forward(head.take(at), tail.take(at))["y"])
            own = z[wanted.take(at.ravel()), np.arange(at.size)]
            np.exp(z, out=z)
            out[at[scored]] = ((own - np.log(z.sum(axis=0))) / np.log(10.0))[scored.ravel()]
        return out

    def fit(self, head: np.ndarray, tail: np.ndarray, wanted: np.ndarray, w: Windows, used: dict[str, np.ndarray], squares: dict[str, np.ndarray]) -> None:
        """One pass of gradient steps over the windows; counts in ``used`` how often each subword was met."""
        p = self.params
        for first in range(0, len(w.at), BATCH):
            at, live = w.at[first : first + BATCH], w.live[first : first + BATCH].ravel()
            n, d = len(at), DIMENSION
            h, t = head.take(at), tail.take(at)
            f = self._forward(h, t)
            z = self._classes(f["y"])
            np.exp(z, out=z)
            share = (live / max(1, live.sum())).astype(np.float32)
            z *= share / z.sum(axis=0)
            z[wanted.take(at.ravel()), np.arange(at.size)] -= share
            grads = {"out": (z @ f["y"]).T, "bias": z.sum(axis=1)[None]}
            dy = z.T @ p["out"].T
            grads["mixed"] = f["m"].T @ dy
            dm = (dy @ p["mixed"].T).reshape(n, -1, d)
            dv = (f["a"] @ dm).reshape(-1, d)
            da = np.matmul(f["v"], dm.transpose(0, 2, 1), out=self._room("da", f["a"].shape))
            da -= np.einsum("nji,nji->ni", da, f["a"])[:, None, :]
            da *= f["a"]
            da *= DIMENSION**-0.5
            dq, dk = (da.transpose(0, 2, 1) @ f["k"]).reshape(-1, d), (da @ f["q"]).reshape(-1, d)
            dx = dy
            for name, g in (("query", dq), ("key", dk), ("value", dv)):
                grads[name] = f["x"].T @ g
                dx += g @ p[name].T
            grads["places"] = dx.reshape(n, -1, d).sum(axis=0)
            for name, g in grads.items():
                squares[name] += g * g
                p[name] -= RATE * g / np.sqrt(squares[name] + 1e-10)
                used[name] += 1
            for name, ids in (("heads", h.ravel()), ("tails", t.ravel())):
                rows, g = _by_id(ids, dx)
                moved = squares[name].take(rows, axis=0)
                moved += g * g
                squares[name][rows] = moved
                moved += 1e-10
                p[name][rows] -= RATE * g / np.sqrt(moved)
                used[name][rows] += 1


def _by_id(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and the sums of their rows of ``values``."""
    seen = np.zeros(int(ids.max()) + 1, np.int64)
    seen[ids] = 1
    rows = np.flatnonzero(seen)
    seen[rows] = np.arange(len(rows))
    d = values.shape[1]
    places = (seen.take(ids) * d)[:, None] + np.arange(d)
    return rows, np.bincount(places.ravel(), values.ravel(), len(rows) * d).reshape(-1, d).astype(np.float32)
