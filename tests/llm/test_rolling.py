import tracemalloc

import numpy as np

from quaystone.llm.suffix_dedup import Rolling


def test_fingerprints_hold_two_numbers_a_value():
    values = np.arange(1, 200_001, dtype=np.uint64)
    tracemalloc.start()
    rolling = Rolling(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * values.nbytes
    twice = Rolling(np.concatenate([values[:100], values[:100]]))
    assert twice.of(np.array([0]), np.array([100])) == twice.of(np.array([100]), np.array([200])) == rolling.of(np.array([0]), np.array([100]))
