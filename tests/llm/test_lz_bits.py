"""Sixteen bits of a minimum tell long texts apart as well as short ones."""

import numpy as np
import pytest

from tallyspark.llm import lz_fingerprint


@pytest.mark.parametrize("bits", [20, 24, 30])
def test_small_minima_keep_sixteen_bits(bits):
    """Minima over 2^bits phrases, of two unrelated texts, agree about once in 2^16."""
    rng = np.random.default_rng(bits)
    sides = []
    for _ in range(2):
        parse, out = lz_fingerprint.Parse().feed(b"ab"), []
        for _ in range(200):
            parse.fold()
            parse.least = (rng.exponential(2.0 ** (64 - bits), len(parse.least))).astype(np.uint64)
            out.append(parse.signature())
        sides.append(np.concatenate(out))
    assert (sides[0] == sides[1]).mean() < 4 / 65536 + 1e-3
