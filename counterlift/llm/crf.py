"""Linear-chain conditional random field in numpy, over many chains at once.

Chains are rows ``first[i]:first[i] + length[i]`` of flat arrays, so a step of the recursions
handles the t-th token of all chains. Features are 64-bit hashes; those of the training table
are known, others weigh nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from counterlift.llm.textarrays import U64

_SIEVE_BITS = 20


def _steps(first: np.ndarray, length: np.ndarray):
    """Row indices of the t-th tokens, for t = 0, 1, ...; longest chains first."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n = len(first)
    for t in range(int(length[0]) if n else 0):
        n = int(np.searchsorted(-length[:n], -t, "left"))
        yield t, first[:n] + t


@dataclass
class Chain:
    """A trained model: known feature hashes (sorted), their weights by state, and transitions."""

    known: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[(self.known >> U64(64 - _SIEVE_BITS)).astype(np.int64)] = True

    def rows(self, features: np.ndarray) -> np.ndarray:
        """Row of ``weights`` of each feature; the last row, of zeros, for an unknown one."""
        out = np.full(features.shape, len(self.known), np.int64)
        maybe = self.sieve[(features >> U64(64 - _SIEVE_BITS)).astype(np.int64)]
        value = features[maybe]
        at = np.minimum(np.searchsorted(self.known, value), max(len(self.known) - 1, 0))
        out[maybe] = np.where(self.known[at] == value, at, len(self.known)) if len(self.known) else len(self.known)
        return out

    def emissions(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), self.weights.shape[1]))
        for c in columns:
            r = self.rows(c)
            hit = np.flatnonzero(r < len(self.known))
            out[hit] += self.weights[r[hit]]
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probability of each state at each token, given its whole chain (forward-backward)."""
        alpha, beta, _ = self._recur(scores, first, length)
        both = alpha * beta
        total = both.sum(1, keepdims=True)
        return np.divide(both, total, out=np.zeros_like(both), where=total > 0)

    def pruned(self, least: float = 0.25, least_zero: float = 1.0) -> Chain:
        """The model without features that hardly favour another state over state 0, or state 0 over all others."""
        gap = self.weights[:, 1:].max(axis=1) - self.weights[:, 0]
        use = (gap >= least) | (gap <= -least_zero)
        return Chain(self.known[use], self.weights[use], self.moves, self.starts)

    def sparse_marginals(self, columns: list[np.ndarray], first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``marginals`` where most chains have no known feature but those that every token has:
        of such chains one per length is computed and stands for the others of that length."""
        n = len(columns[0])
        scores = np.zeros((n, self.weights.shape[1]))
        hit = np.zeros(n, bool)
        for c in columns:
            r = self.rows(c)
            at = np.flatnonzero(r < len(self.known))
            scores[at] += self.weights[r[at]]
            if len(at) < n:
                hit[at] = True
        marked = np.concatenate(([0], np.cumsum(hit)))
        plain = marked[first + length] == marked[first]
        _, one = np.unique(length[plain], return_index=True)
        shown = np.flatnonzero(~plain)
        shown = np.concatenate((shown, np.flatnonzero(plain)[one]))
        size = length[shown]
        begin = np.cumsum(size) - size
        rows = np.repeat(first[shown] - begin, size) + np.arange(int(size.sum()))
        out = np.zeros_like(scores)
        out[rows] = self.marginals(scores[rows], begin, size)
        alike = np.flatnonzero(plain)
        if len(alike):
            _, lead, back = np.unique(length[alike], return_index=True, return_inverse=True)
            model_of = first[alike[lead]][back]
            size = length[alike]
            begin = np.cumsum(size) - size
            shift = np.arange(int(size.sum()))
            out[np.repeat(first[alike] - begin, size) + shift] = out[np.repeat(model_of - begin, size) + shift]
        return out

    def _recur(self, scores, first, length):
        force = np.exp(scores - scores.max(axis=1, keepdims=True))
        moves = np.exp(self.moves)
        alpha, beta = np.zeros_like(force), np.ones_like(force)
        steps = list(_steps(first, length))
        for t, at in steps:
            a = (np.exp(self.starts) if t == 0 else alpha[at - 1] @ moves) * force[at]
            alpha[at] = a / a.sum(1, keepdims=True)
        for t, at in reversed(steps):
            if t:
                b = (beta[at] * force[at]) @ moves.T
                beta[at - 1] = b / b.sum(1, keepdims=True)
        return alpha, beta, force

    def best_path(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Most likely state of each token along its chain (Viterbi)."""
        value = np.zeros_like(scores)
        back = np.zeros(scores.shape, np.int8)
        out = np.zeros(len(scores), np.int8)
        steps = list(_steps(first, length))
        for t, at in steps:
            if t == 0:
                value[at] = self.starts + scores[at]
            else:
                reach = value[at - 1][:, :, None] + self.moves[None]
                back[at] = reach.argmax(1)
                value[at] = reach.max(1) + scores[at]
        ends = first + length - 1
        out[ends] = value[ends].argmax(1)
        for t, at in reversed(steps):
            if t:
                out[at - 1] = back[at, out[at]]
        return out


def train(columns: list[np.ndarray], labels: np.ndarray, first: np.ndarray, length: np.ndarray, states: int,
          least: int = 2, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> Chain:
    """Maximum likelihood with a small ridge, by AdaGrad over the whole (small) table.

    ``columns`` are feature hashes per token; a feature seen fewer than ``least`` times is unknown.
    Without chains the model knows nothing and prefers state 0.
    """
    flat = np.concatenate(columns) if len(columns) and len(columns[0]) else np.zeros(0, U64)
    known, often = np.unique(flat, return_counts=True)
    known = known[often >= least]
    starts = np.zeros(states)
    model = Chain(known, np.zeros((len(known), states)), np.zeros((states, states)), starts)
    if not len(first):
        model.starts[1:] = -20
        model.moves[:, 1:] = -20
        return model
    rows = [model.rows(c) for c in columns]
    truth = np.eye(states)[labels]
    inner = np.ones(len(labels), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    n = len(labels)
    squares = [np.full(x.shape, 1e-8) for x in (model.weights, model.moves, model.starts)]
    seen_moves = np.zeros((states, states))
    np.add.at(seen_moves, (labels[inner - 1], labels[inner]), 1)
    for _ in range(rounds):
        padded = np.vstack((model.weights, np.zeros(states)))
        scores = sum(padded[r] for r in rows)
        alpha, beta, force = model._recur(scores, first, length)
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        gap = truth - p
        grad = np.stack([sum(np.bincount(r, gap[:, k], len(known) + 1) for r in rows)[: len(known)] for k in range(states)], 1)
        into = force[inner] * beta[inner]
        pair = alpha[inner - 1][:, :, None] * np.exp(model.moves)[None] * into[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        steps = (grad - ridge * n * model.weights / 100, seen_moves - pair.sum(0) - ridge * n * model.moves / 100, gap[first].sum(0))
        for value, g, sq in zip((model.weights, model.moves, model.starts), steps, squares, strict=True):
            sq += g * g
            value += rate * g / np.sqrt(sq)
    return model
