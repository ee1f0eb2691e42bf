"""A linear-chain conditional random field over sparse features, in numpy."""

from __future__ import annotations

import numpy as np

Sequence = tuple[list[list[str]], list[int]]


class ChainCRF:
    """Labels 0..n-1; weights by feature and label, and by pair of neighbouring labels."""

    def __init__(self, labels: int = 2):
        self.labels, self.index = labels, {}
        self.weights, self.steps = np.zeros((0, labels)), np.zeros((labels, labels))

    def scores(self, items: list[list[str]]) -> np.ndarray:
        """Label scores of each item; unknown features count nothing."""
        out = np.zeros((len(items), self.labels))
        for i, feats in enumerate(items):
            known = [self.index[f] for f in feats if f in self.index]
            if known:
                out[i] = self.weights[known].sum(axis=0)
        return out

    def decode(self, items: list[list[str]]) -> list[int]:
        """The most likely labels by Viterbi's algorithm; ties go to the smaller label."""
        if not items:
            return []
        s = self.scores(items)
        best, back = s[0], []
        for row in s[1:]:
            paths = best[:, None] + self.steps
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]

    def marginals(self, items: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(label marginals of each item, expected counts of label pairs) by forward-backward."""
        s, n = self.scores(items), len(items)
        forward, backward = np.zeros((n, self.labels)), np.zeros((n, self.labels))
        forward[0] = s[0]
        for i in range(1, n):
            forward[i] = s[i] + _lse(forward[i - 1][:, None] + self.steps)
        for i in range(n - 2, -1, -1):
            backward[i] = _lse((self.steps + s[i + 1] + backward[i + 1]).T)
        total = _lse(forward[-1][:, None])[0]
        pairs = np.zeros_like(self.steps)
        for i in range(n - 1):
            pairs += np.exp(forward[i][:, None] + self.steps + s[i + 1] + backward[i + 1] - total)
        return np.exp(forward + backward - total), pairs

    def fit(self, data: list[Sequence], epochs: int = 8, rate: float = 0.3, ridge: float = 1e-4, seed: int = 0) -> ChainCRF:
        """Maximise the penalised conditional likelihood by AdaGrad, a sequence at a time in seeded order."""
        for items, _ in data:
            for feats in items:
                for f in feats:
                    self.index.setdefault(f, len(self.index))
        self.weights = np.zeros((len(self.index), self.labels))
        seen, seen_steps, rng = np.full_like(self.weights, 1e-2), np.full_like(self.steps, 1e-2), np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                items, labels = data[k]
                if not items:
                    continue
                p, pairs = self.marginals(items)
                gap = -p
                gap[np.arange(len(labels)), labels] += 1
                for a, b in zip(labels, labels[1:]):
                    pairs[a, b] -= 1
                rows = np.array([self.index[f] for feats in items for f in feats])
                own = np.repeat(np.arange(len(items)), [len(feats) for feats in items])
                touched, inverse = np.unique(rows, return_inverse=True)
                g = np.zeros((len(touched), self.labels))
                np.add.at(g, inverse, gap[own])
                g -= ridge * self.weights[touched]
                seen[touched] += g * g
                self.weights[touched] += rate * g / np.sqrt(seen[touched])
                g = -pairs - ridge * self.steps
                seen_steps += g * g
                self.steps += rate * g / np.sqrt(seen_steps)
        return self


def _lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))
