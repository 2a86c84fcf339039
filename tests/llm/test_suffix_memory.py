"""Suffix dedup takes room for its texts, not for the place of every byte of them."""

import tracemalloc

import numpy as np

from stocktake.llm import suffix_dedup as S


def peak_of(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_strings_take_little_more_than_their_bytes():
    data = np.random.default_rng(1).integers(0, 256, 1 << 20).astype(np.uint8)
    starts = np.arange(0, len(data) - S.WINDOW, 5)
    found, peak = peak_of(lambda: S.strings(data, starts, S.WINDOW, S.WINDOW))
    assert peak < 3 * found.nbytes
    assert all(bytes(found[i : i + 1].view(np.uint8))[:-1] == data[starts[i] : starts[i] + S.WINDOW].tobytes() for i in (0, 17, len(starts) - 1))
    ends = S.strings(data, np.array([len(data) - 3, 7]), np.array([3, 2]), 8).view(np.uint8).reshape(-1, 9)
    assert ends.tolist() == [[*data[-3:].tolist(), 0, 0, 0, 0, 0, 3], [*data[7:9].tolist(), 0, 0, 0, 0, 0, 0, 2]]


def test_equal_texts_are_compared_in_slices():
    data = np.frombuffer(b"0123456789" * 40_000, np.uint8)
    at = np.arange(len(data) - S.WINDOW + 1)
    (group, heads), peak = peak_of(lambda: S._grouped([at % 10], lambda i: S.strings(data, at[i], S.WINDOW, S.WINDOW)))
    assert len(heads) == 10 and (group == group[at % 10]).all()
    assert peak < len(at) * 2 * S.WINDOW
