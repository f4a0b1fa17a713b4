"""Sums leave a task by some shards at a time."""

import numpy as np
import pyarrow as pa

from sigloom.llm import lm


def test_sums_leave_by_parts(monkeypatch):
    rng = np.random.default_rng(1)
    keys, shard = rng.integers(0, 3000, 40_000).astype(np.uint64), rng.integers(0, 50, 40_000).astype(np.int32)
    monkeypatch.setattr(lm, "HELD", 64_000)
    for parts in (list(lm._shard_by_shard(keys, shard)), list(lm._split(*_distinct(keys, shard)))):
        assert len(parts) > 5 and max(p.nbytes for p in parts) < 200_000
    whole = lm._sums_in_shards(keys, shard).to_pylist()
    assert pa.Table.from_batches(list(lm._shard_by_shard(keys, shard))).to_pylist() == whole


def _distinct(keys, shard):
    keys, counts = np.unique(keys * np.uint64(50) + shard.astype(np.uint64), return_counts=True)
    return keys, counts, (keys % np.uint64(50)).astype(np.int32)
