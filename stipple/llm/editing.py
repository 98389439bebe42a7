"""Myers' bit-parallel edit distance: of one pattern over any hashable symbols, and of many pairs of strings at once."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: Words of all pairs that are compared at once, symbols of their tables, and pairs below which one by one is faster.
WORDS, SYMBOLS, FEW_PAIRS = 8192, 256, 10
#: Columns from one look for hopeless pairs to the next; the bound that is looked at may be too high by this.
COLUMNS, SLACK = 32, 10
#: A symbol of no string.
PAD = 0x110000


class Pattern:
    """A pattern compiled to one bit mask per symbol."""

    def __init__(self, symbols: Sequence[Hashable]):
        self.n = len(symbols)
        self.masks: dict[Hashable, int] = {}
        for i, s in enumerate(symbols):
            self.masks[s] = self.masks.get(s, 0) | 1 << i
        self.all, self.top = (1 << self.n) - 1, 1 << max(self.n - 1, 0)

    def _run(self, text: Sequence[Hashable], anchored: int):
        """Distances of the pattern to the best substring (or, if anchored, the prefix) that ends at each place."""
        plus, minus, score, full, top, get = self.all, 0, self.n, self.all, self.top, self.masks.get
        for s in text:
            eq = get(s, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus)
            down = plus & horizontal
            score += bool(up & top) - bool(down & top)
            up = up << 1 | anchored
            down <<= 1
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical & full
            yield score

    def best(self, text: Sequence[Hashable]) -> tuple[int, int]:
        """(distance, end) of the substring of ``text`` nearest to the pattern; the first of equals. end is exclusive."""
        found = (self.n, 0)
        for end, score in enumerate(self._run(text, 0), 1):
            if score < found[0]:
                found = score, end
        return found

    def distance(self, text: Sequence[Hashable]) -> int:
        """Distance to the whole of ``text``."""
        if not self.n:
            return len(text)
        score = self.n
        for score in self._run(text, 1):
            pass
        return score

    def within(self, text: Sequence[Hashable], most: int) -> bool:
        """Whether the distance to the whole of ``text`` is at most ``most``; stops where what is left of the text can't mend it."""
        if not self.n:
            return len(text) <= most
        plus, minus, score, full, top, get = self.all, 0, self.n, self.all, self.top, self.masks.get
        allowed = most + len(text)
        for s in text:
            eq = get(s, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus)
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            allowed -= 1
            if score > allowed:  # a further symbol lowers the score by one at most
                return False
            up = up << 1 | 1
            down <<= 1
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical & full
        return score <= most


def shared_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared_end(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return low


def within_many(pairs: Sequence[tuple[str, str]], most: Sequence[int]) -> np.ndarray:
    """Whether the distance of each pair is at most its bound. What both share at their ends costs no edits."""
    out, left = np.zeros(len(pairs), bool), []
    for k, (a, b) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > most[k]:
            continue
        if i := shared_start(a, b):
            a, b = a[i:], b[i:]
        if i := shared_end(a, b):
            a, b = a[: len(a) - i], b[: len(b) - i]
        if len(b) <= most[k]:
            out[k] = True
        elif a:
            left.append((-(-len(a) // 64), k, a, b, most[k]))
    left.sort(key=lambda x: (x[0], x[4]))
    while left:
        n, size = 1, left[0][0]
        while n < len(left) and left[n][0] <= size * 1.25 + 1 and n < WORDS // min(size, 2 + (left[n][4] >> 6)):
            n += 1
        some, left = [x[:4] for x in left[:n]], left[n:]
        _settle(some, most, out)
    return out


def _settle(some: list[tuple[int, int, str, str]], most: Sequence[int], out: np.ndarray) -> None:
    """Of (words, number, shorter, longer string). Pairs are columns, the words of a pattern rows.

    Both strings are filled up with PAD by as much, which leaves their distance, until the pattern fills its words. Row w is w symbols of
    the text behind row 0, so that one step takes a symbol in every row. Only rows that a way within the bounds can pass are computed. A pair is given up
    when all ways through the symbols read cost too much.
    """
    if len(some) < FEW_PAIRS:
        for _, k, a, b in some:
            out[k] = Pattern(a).within(b, most[k])
        return
    w = max(x[0] for x in some)
    some = sorted(some, key=lambda x: len(x[3]) - len(x[2]))
    n_pairs, full = len(some), 64 * w
    n = np.array([len(b) + full - len(a) for _, _, a, b in some])
    spread = lambda strings, width: np.frombuffer("".join(x.ljust(width, "\0") for x in strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n_pairs, width).copy()
    patterns = spread([a for _, _, a, _ in some], full)
    patterns[np.arange(full) >= np.array([len(a) for _, _, a, _ in some])[:, None]] = PAD
    seen = np.zeros(PAD + 1, bool)
    seen[patterns] = True
    symbols = np.flatnonzero(seen)
    if len(symbols) > SYMBOLS:
        _settle(some[: n_pairs // 2], most, out)
        _settle(some[n_pairs // 2 :], most, out)
        return
    code = np.zeros(PAD + 1, np.int64)
    code[symbols] = np.arange(1, len(symbols) + 1) * (w * n_pairs)
    lane = np.arange(w * n_pairs).reshape(w, n_pairs)
    table = np.zeros((len(symbols) + 1) * w * n_pairs, np.uint64)
    for bit in range(64):
        table[code[patterns[:, bit::64].T] + lane] |= np.uint64(1 << bit)
    width = int(n[-1])
    texts = spread([b for _, _, _, b in some], width)
    texts[np.arange(width) >= np.array([len(b) for _, _, _, b in some])[:, None]] = PAD
    read = np.zeros((width + 2 * w, n_pairs), np.int64)
    read[w - 1 : w - 1 + width] = code[texts.T]
    del patterns, texts, seen, code

    number, bound = np.array([k for _, k, _, _ in some]), np.array([most[k] for _, k, _, _ in some])
    plus, minus = np.full((w, n_pairs), ~np.uint64(0)), np.zeros((w, n_pairs), np.uint64)
    score = np.repeat(np.arange(64, full + 1, 64, dtype=np.uint64)[:, None], n_pairs, axis=1)
    plus_in, minus_in = np.zeros((w + 1, n_pairs), np.uint64), np.zeros((w + 1, n_pairs), np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    last, done, low, high, views = n + w - 2, 0, 0, 0, None
    for i in range(width + w - 1):
        if views is None:  # the diagonals that a way within the bounds can reach
            right, left = int((bound + n - full).max()) // 2, int((bound - n + full).max()) // 2
        new_low, new_high = max(low, (i - 63 - right) // 65 - 1), max(high, min(w, (i + left) // 65 + 2))
        if views is None or (new_low, new_high) != (low, high):
            if i and new_high > high:  # the column before it, as if all its symbols were added
                score[high] = score[high - 1] - plus_in[high] + minus_in[high] + np.uint64(64)
            low, high = new_low, new_high
            at, eq, vertical, horizontal, up, down, plus_out, minus_out = np.empty((high - low, len(n)), np.int64), *(np.empty((high - low, len(n)), np.uint64) for _ in range(7))
            views = lane[low:high], plus[low:high], minus[low:high], score[low:high], plus_in[low:high], minus_in[low:high], plus_in[low + 1 : high + 1], minus_in[low + 1 : high + 1]
            lanes, pv, mv, scores, p_in, m_in, p_next, m_next = views
        p_in[0], m_in[0] = one, 0
        np.add(read[i + w - high : i + w - low][::-1], lanes, out=at)
        np.take(table, at, out=eq, mode="clip")
        np.bitwise_or(eq, mv, out=vertical)
        eq |= m_in
        np.bitwise_and(eq, pv, out=horizontal)
        horizontal += pv
        horizontal ^= pv
        horizontal |= eq
        np.bitwise_or(horizontal, pv, out=up)
        np.invert(up, out=up)
        up |= mv
        np.bitwise_and(pv, horizontal, out=down)
        np.right_shift(up, top, out=plus_out)
        np.right_shift(down, top, out=minus_out)
        scores += plus_out
        scores -= minus_out
        np.left_shift(up, one, out=up)
        up |= p_in
        np.left_shift(down, one, out=down)
        down |= m_in
        np.bitwise_or(vertical, up, out=pv)
        np.invert(pv, out=pv)
        pv |= down
        np.bitwise_and(up, vertical, out=mv)
        p_next[...], m_next[...] = plus_out, minus_out
        if last[done] == i:
            to = int(np.searchsorted(last, i, "right"))
            out[number[done:to]] = score[-1, done:to].view(np.int64) <= bound[done:to]
            done = to
            if done == len(last):
                return
        if i % COLUMNS == COLUMNS - 1:
            row = np.arange(low, high)[:, None]
            ahead = full - 64 * (row + 1) - (n - np.maximum(i + 1 - row, 0))  # of the diagonal that ends at the end, at the end of each word
            here = scores.view(np.int64)
            least = (here + np.abs(ahead)).min(0)
            for byte in range(7, -1, -1):
                shift = np.uint64(8 * byte)
                bits = np.bitwise_count(pv >> shift).astype(np.int64) - np.bitwise_count(mv >> shift)
                least = np.minimum(least, (here - bits + np.abs(ahead + 64 - 8 * byte)).min(0))
            alive = np.flatnonzero((least - SLACK <= bound) & (np.arange(len(n)) >= done))
            if not len(alive):
                return
            if len(alive) < 0.85 * len(n):
                read, lane, plus, minus, score, plus_in, minus_in = (np.ascontiguousarray(x[:, alive]) for x in (read, lane, plus, minus, score, plus_in, minus_in))
                number, bound, n, last, done, views = number[alive], bound[alive], n[alive], last[alive], 0, None
