import numpy as np

from strandloom.llm import setjoin


def test_segment_rows_grow_slowly():
    """Of 24 million sets (about 6 GB) a pair at the threshold is found with few segments a set."""
    digits, segments = setjoin.segment_plan(24_000_000, 0.6, 0.9999)
    assert segments <= 300 and 2 ** (4 * digits) >= 24_000_000
    assert (1 - (0.6 + 0.4 / 16) ** digits) ** segments <= 1e-4


def test_many_sets_are_sketched_as_one():
    rng = np.random.default_rng(4)
    sets = [rng.integers(1, 2**32, n, dtype=np.uint32) for n in (1, 7, 30)]
    sketcher = setjoin.Sketcher(0, 20, 3)
    together = sketcher.digits(np.concatenate(sets), np.array([0, 1, 8]), 4)
    assert together.max() > 7
    for own, row in zip(sets, together):
        assert (sketcher.digits(own, np.zeros(1, np.int64), 4)[0] == row).all()
        assert (sketcher.bits(own) == row >> 3).all()
