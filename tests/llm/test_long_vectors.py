"""Vectors of more components than one exact float32 product holds."""

import numpy as np

from spanloom.llm.embedding_dedup import linked


def test_long_vectors_are_compared():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 3000))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * np.linspace(0.1, 0.6, 20)[:, None]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = x @ x.T >= 0.95
    assert 0 < np.triu(want, 1).sum() < 20
    assert (linked(x, x, 0.95) == want).all()
