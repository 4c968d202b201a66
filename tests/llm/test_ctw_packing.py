"""What the context tree sends between its passes comes back as it was."""

import numpy as np
import pytest

from motifspark.llm import ctw


@pytest.mark.parametrize("values", [[], [0], [5], [0, 1, 2**64 - 1], range(0, 70_000, 7), [1 << k for k in range(64)]])
def test_keys_and_numbers_survive_packing(values):
    keys = np.array(sorted(values), np.uint64)
    assert (ctw.unpack_sorted(ctw.pack_sorted(keys)) == keys).all()
    for kind in (np.uint32, np.int64, np.float32):
        numbers = keys.astype(kind)
        assert (ctw.unpack_numbers(ctw.pack_numbers(numbers), kind) == numbers).all()


def test_random_keys_survive_packing():
    keys = ctw.distinct(np.random.default_rng(3).integers(0, 1 << 45, 50_000, dtype=np.uint64))
    assert (ctw.unpack_sorted(ctw.pack_sorted(keys)) == keys).all()


@pytest.mark.parametrize("size", [0, 1, 64, 65, 1000, 200_000])
def test_lookup_gives_each_key_its_value_and_refuses_others(size):
    keys = np.random.default_rng(4).permutation(np.arange(size, dtype=np.uint64) * np.uint64(7))
    asked = np.concatenate([keys[::3], keys[::2]])
    assert (ctw.Lookup(keys, keys.astype(np.float32))(asked) == asked.astype(np.float32)).all()
    with pytest.raises(RuntimeError):
        ctw.Lookup(keys, keys)(np.array([3], np.uint64))


def test_short_numbers_keep_seventeen_bits():
    numbers = -np.random.default_rng(5).exponential(1.0, 10_000)
    assert np.allclose(ctw.short(numbers), numbers, rtol=2.0**-17, atol=0)
