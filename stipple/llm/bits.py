"""Sums of the bits of 64-bit hashes over runs."""

from __future__ import annotations

import numpy as np

#: A byte's bits, most significant first, as the eight bytes of one word: eight counters that are added at once.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()
#: Hashes that a counter of one byte can take.
FULL = 255


def bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits, most significant first, is set in each run of ``hashes``; no run is empty."""
    n = np.diff(np.r_[starts, len(hashes)])
    parts = -(-n // FULL)
    if (parts > 1).any():  # runs too long for the counters are summed in parts
        at = np.repeat(starts, parts) + FULL * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    else:
        at = starts
    octets = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T)
    sums = np.stack([np.add.reduceat(LANES[row], at).view(np.uint8).reshape(-1, 8) for row in octets], axis=1).reshape(len(at), 64)
    if at is starts:
        return sums.astype(np.int64)
    return np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0, dtype=np.int64)


def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits, for 64 of them at once."""
    differ = a ^ b
    carry = differ & c
    carry |= a & b
    differ ^= c
    return differ, carry


def bit_sums_of_rows(hashes: np.ndarray) -> np.ndarray:
    """bit_sums of the rows of a matrix. Fifteen hashes are first added up to four, of the weights 1, 2, 4 and 8."""
    rows, n = hashes.shape
    k = n // 15
    if k < 4:
        return bit_sums(hashes.ravel(), np.arange(rows) * n)
    waiting: list[list[np.ndarray]] = [[hashes[:, i * k : (i + 1) * k] for i in range(15)], [], [], []]
    for weight in range(3):
        while len(waiting[weight]) > 1:
            total, carry = added(*[waiting[weight].pop() for _ in range(3)])
            waiting[weight].append(total)
            waiting[weight + 1].append(carry)
    # a row of each weight after the other, and at its end the hashes that are left over
    left = n - 15 * k
    all_at_once = np.concatenate([waiting[3][0], waiting[2][0], waiting[1][0], waiting[0][0], hashes[:, n - left :]], axis=1)
    starts = (np.arange(rows)[:, None] * (4 * k + left) + np.arange(4) * k).ravel()
    sums = bit_sums(all_at_once.ravel(), starts).reshape(rows, 4, 64)
    return ((sums[:, 0] * 2 + sums[:, 1]) * 2 + sums[:, 2]) * 2 + sums[:, 3]
