"""The bound of a tile of pairs is computed strip by strip."""

import numpy as np

from trendframe.llm import toxicity as X


def test_strips_give_what_the_whole_tile_gives(monkeypatch):
    rng = np.random.default_rng(1)
    both = rng.integers(0, 50, (300, 300)).astype(np.float32)
    toxic = np.minimum(both, rng.integers(0, 50, (300, 300))).astype(np.float32)
    expected, mine, theirs = both * np.float32(0.2), rng.uniform(0.5, 2, 300), rng.uniform(0.5, 2, 300)
    want = X.telling(both, toxic, expected, np.maximum(mine[:, None], theirs[None])) >= 20.0
    heights, plain = [], X.telling
    monkeypatch.setattr(X, "telling", lambda both, *a: (heights.append(len(both)), plain(both, *a))[1])
    assert np.array_equal(X.strips(both, toxic, expected, mine, theirs, 20.0), want) and want.any()
    assert max(heights) <= X.STRIP
