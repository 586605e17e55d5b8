"""Scaled forward-backward recursions over many sequences at once."""

from __future__ import annotations

import numpy as np


class Chains:
    """Sequences given end to end, handled step by step.

    A step of a recursion takes the t-th symbol of every sequence longer than t.  Inside,
    symbols lie in the order of steps, longest sequences first, so that a step is one slice;
    ``in_order`` brings values back to the order given.
    """

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = np.asarray(lengths, dtype=np.int64)
        order = np.argsort(-self.lengths, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        longest = int(self.lengths.max()) if len(order) else 0
        self.active = np.searchsorted(-self.lengths[order], -np.arange(longest), side="left")
        self.offsets = np.concatenate([[0], np.cumsum(self.active)])
        self.total = int(self.lengths.sum())
        starts = np.cumsum(self.lengths) - self.lengths
        step = np.arange(self.total) - np.repeat(starts, self.lengths)
        self.place = self.offsets[step] + np.repeat(rank, self.lengths)
        self.full = np.flatnonzero(self.lengths)
        self.starts = starts[self.full]
        self.weights = np.zeros((0, 0))

    def in_order(self, values: np.ndarray) -> np.ndarray:
        return values[self.place]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each sequence of values in the order given; zero for empty ones."""
        out = np.zeros((len(self.lengths), *values.shape[1:]))
        if len(self.full):
            out[self.full] = np.add.reduceat(values, self.starts, axis=0)
        return out

    def forward(self, emit: np.ndarray, symbols: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each sequence's weight, and the scaled forward values in the order of steps.

        ``emit`` is symbols x states, ``start`` states, ``move`` states x states; none need be probabilities.
        """
        stepped = np.empty(self.total, dtype=np.int64)
        stepped[self.place] = symbols
        self.weights = emit[stepped]
        kept, scale = self.weights.copy(), np.empty(self.total, dtype=emit.dtype)
        ends = self.offsets.tolist()
        before = None
        for a, b in zip(ends[:-1], ends[1:]):
            now = kept[a:b]
            now *= start if before is None else before[: b - a] @ move
            total = scale[a:b]
            now.sum(axis=1, out=total)
            now /= total[:, None]
            before = now
        return self.sums(np.log(scale.astype(float))[self.place]), kept

    def smooth(self, move: np.ndarray, forward: np.ndarray, moves: bool = False) -> np.ndarray | None:
        """Turn the last forward values into posteriors, in place; expected moves (states x states) if asked for."""
        states = move.shape[0]
        total = np.zeros((states, states)) if moves else None
        ends, back_move = self.offsets.tolist(), np.ascontiguousarray(move.T)
        ahead = np.zeros((0, states), dtype=forward.dtype)  # of the next step: weight times backward value
        for a, b in zip(ends[-2::-1], ends[:0:-1]):
            now, later = forward[a:b], len(ahead)
            back = np.ones((b - a, states), dtype=forward.dtype)
            if later:
                np.matmul(ahead, back_move, out=back[:later])
                if moves:
                    held = now[:later] / (now[:later] * back[:later]).sum(axis=1)[:, None]
                    total += held.T @ ahead
            ahead = back * self.weights[a:b]
            ahead /= ahead.sum(axis=1)[:, None]
            now *= back
            now /= now.sum(axis=1)[:, None]
        return total * move if moves else None
