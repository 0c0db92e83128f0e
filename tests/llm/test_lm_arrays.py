"""The language model's orders and counts of numbers against numpy's plain ones, and the types in which sizes of tables are counted."""

import numpy as np
import pytest

from confab.llm import lm


def test_distinct_and_among_are_numpys():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5_000):
        x = rng.integers(0, 900, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        names, at = np.unique(x, return_inverse=True)
        got = lm.distinct(x)
        assert got[0].dtype == x.dtype and (got[0] == names).all() and (got[1] == at).all()
        for few in (x[:0], x[:40][::-1], np.array([3, 1 << 63], np.uint64)):
            assert (lm.among(x, few) == np.isin(x, few)).all()


@pytest.mark.parametrize("most", [7, 90_000, 1 << 40, (1 << 62) - 1])
def test_orders_are_stable_where_64_bits_hold_number_and_place_and_where_not(most):
    rng = np.random.default_rng(2)
    key = rng.choice(rng.integers(0, most, 300, endpoint=True), 4_000)
    assert (lm.stable_order(key, most) == np.argsort(key, kind="stable")).all()


@pytest.mark.parametrize("names", [50, 1 << 24, 1 << 31])
def test_entries_are_counted_once_each_in_order(names):
    rng = np.random.default_rng(3)
    at, k, doc = names - 1 - rng.integers(0, 30, 6_000), names - 1 - rng.integers(0, 30, 6_000), rng.integers(0, 9, 6_000) * 8_191
    want, n = np.unique(np.stack([at, k, doc], axis=1), axis=0, return_counts=True)
    got = lm.counted(at, k, doc, names)
    assert all((x == y).all() for x, y in zip(got, (*want.T, n), strict=True)) and got[2].dtype == np.uint16


@pytest.mark.parametrize("kind", [np.uint16, np.int32, np.uint32, np.int64, np.uint64])
def test_packed_arrays_come_back(kind):
    x = np.random.default_rng(4).integers(0, np.iinfo(kind).max, 3_000, dtype=kind, endpoint=True)
    for some in (x, np.sort(x), x[:0], x[:1]):
        back = lm._unpacked(lm._packed(some), kind)
        assert back.dtype == some.dtype and (back == some).all()


def test_sizes_are_counted_in_their_own_type():
    """With a plain 1 numpy converts at every index, which took 30 times as long."""
    kinds = []

    class Watched(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, **others):
            if method == "at":
                kinds.append(getattr(inputs[2], "dtype", None))
            return getattr(ufunc, method)(*[np.asarray(x) if isinstance(x, Watched) else x for x in inputs], **others)

    n = np.full(40, 30)
    s = lm.Seating(n, np.ones(40, np.int64), n, n + 90, 0.5, np.random.default_rng(5))
    s.size = s.size.view(Watched)
    s.come(np.full(40, 90), lambda a: np.full(len(a), 0.5))
    s.sweep(lambda a, tables: np.full(len(a), 0.5))
    s.leave(np.full(40, 60))
    assert np.asarray(s.sizes()).sum() == 40 * 60 and kinds and set(kinds) == {s.size.dtype}
