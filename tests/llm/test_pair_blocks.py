import numpy as np

from parapet.llm import phrases


def test_pairs_are_counted_over_blocks(spark):
    rng = np.random.default_rng(5)
    keys = np.concatenate([rng.integers(0, 1 << 32, 4000, dtype=np.uint64).astype(np.uint32), np.array([0, 1, 0xFFFFFFFF, 0x3FFFFF, 0x400000], np.uint32)])
    rows, total = [], {}
    for _ in range(3):
        k, n = np.unique(rng.choice(keys, 6000), return_counts=True)
        for x, m in zip(k.tolist(), n.tolist(), strict=True):
            total[x] = total.get(x, 0) + m
        for part in np.unique(k >> 22).tolist():
            own = (k >> 22) == part
            block = phrases._block(k[own], n[own])
            back = phrases._unblock(block, part)
            assert (back[0] == k[own]).all() and (back[1] == n[own]).all()
            rows.append((part, bytearray(block)))
    found = phrases._frequent_pairs(spark.createDataFrame(rows, "part int, block binary"), 6).collect()
    assert sorted(r.key & 0xFFFFFFFF for r in found) == sorted(x for x, m in total.items() if m >= 6)


def test_blocks_are_short():
    """A row for each pair took 24 bytes before compression; most bytes of a block are zero."""
    keys = np.sort(np.random.default_rng(1).choice(1 << 22, 1000, replace=False).astype(np.uint32))
    block = phrases._block(keys, np.ones(1000, np.int64))
    assert len(block) == 8000 and block.count(0) > 4500
