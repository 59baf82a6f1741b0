"""Word pairs of the quality model on their way to the shards."""

import numpy as np
import pandas as pd
import pytest

from terrashift.llm import quality


def test_counts_of_pairs_travel_packed(spark):
    """What is shuffled for a pair is a few bytes, however many shards there are, and adds up to the counts."""
    rng = np.random.default_rng(8)
    vocabulary = np.sort(rng.integers(-(2**62), 2**62, 20_000))
    texts = [rng.choice(vocabulary, 50_000) for _ in range(4)]
    keys = np.concatenate([quality._pair_keys(t, vocabulary) for t in texts])
    spread = quality._spread(keys)
    assert (quality._gathered(spread) == keys).all()
    want, n = np.unique(keys, return_counts=True)
    sizes = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "_hashed", lambda batch, at: enumerate(batch))
        for shards in (1, 300):
            rows = pd.concat([b.to_pandas() for b in quality._count_pairs(vocabulary, shards)([texts[:2], texts[2:]])])
            sizes.append(rows["found"].map(len).sum() / len(want))
            got = pd.concat([quality._add_up(g) for _, g in rows.groupby("shard")]).sort_values("pair")
            assert (got["pair"].to_numpy() == want).all() and (got["n"].to_numpy() == n).all()
    assert max(sizes) < 4
