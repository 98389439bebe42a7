import numpy as np
import pytest

from stipple.llm.bits import bit_sums, bit_sums_of_rows
from stipple.llm.simhash import SEED, families, mixed, shingle_hashes, xxhash


@pytest.mark.parametrize("rows,n", [(1, 1), (3, 59), (16, 60), (8, 61), (5, 74), (2, 1000), (16, 5000)])
def test_sums_of_rows(rows, n):
    hashes = np.random.default_rng(n).integers(0, 1 << 64, (rows, n), np.uint64)
    want = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(rows, n, 8), axis=2).sum(1, dtype=np.int64)
    assert (bit_sums_of_rows(hashes) == want).all()
    assert (bit_sums(hashes.ravel(), np.arange(rows) * n) == want).all()


def test_families_and_shingles():
    h = np.random.default_rng(1).integers(0, 1 << 64, 50, np.uint64)
    assert all((families(h, 16)[i] == mixed(h, i)).all() for i in range(16))
    words = "a bb ccc d eeeee ff".encode().split()
    assert shingle_hashes(words, 5).tolist() == [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), SEED) for i in range(2)]
