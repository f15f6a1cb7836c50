"""The first free row with an amount near another, without a list of the pairs that are near."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence


class Free:
    """Rows of B, given by their amounts in the order of positions: take(x) is the place of the first free one whose amount is near x.

    A tree over the sorted amounts holds the first free place of each stretch. What is near x are neighbours among the sorted
    amounts: within_percent is asked at both ends only, where a - b has no rounding for less than 50 per cent, so the quotients ascend.
    """

    def __init__(self, amounts: Sequence[float], percent: float) -> None:
        n = len(amounts)
        order = sorted(range(n), key=amounts.__getitem__)
        self.n, self.percent, self.amounts = n, percent, [amounts[i] for i in order]
        self.over, self.under = 1 + percent / 100, 1 - percent / 100
        self.tree, self.leaf = [n] * n + order, [0] * n
        for at, i in enumerate(order, n):
            self.leaf[i] = at
        for i in range(n - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def near(self, x: float) -> tuple[int, int]:
        amounts, percent = self.amounts, self.percent
        if x == 0 or x == math.inf:
            return bisect_left(amounts, x), bisect_right(amounts, x)
        low, high = x / self.over, x / self.under
        if x < 0:
            low, high = high, low
        lo, hi = bisect_left(amounts, low - abs(low) * 1e-14 - 1e-320), bisect_right(amounts, high + abs(high) * 1e-14 + 1e-320)
        while lo < hi and not ((y := amounts[lo]) and abs(x - y) / abs(y) * 100 <= percent):
            lo = bisect_right(amounts, y, lo, hi)
        while lo < hi and not ((y := amounts[hi - 1]) and abs(x - y) / abs(y) * 100 <= percent):
            hi = bisect_left(amounts, y, lo, hi)
        return lo, hi

    def take(self, x: float) -> int | None:
        tree, n = self.tree, self.n
        if tree[1] == n:
            return None
        lo, hi = self.near(x)
        lo, hi, first = lo + n, hi + n, n
        while lo < hi:
            if lo & 1:
                if tree[lo] < first:
                    first = tree[lo]
                lo += 1
            if hi & 1:
                hi -= 1
                if tree[hi] < first:
                    first = tree[hi]
            lo >>= 1
            hi >>= 1
        if first == n:
            return None
        i = self.leaf[first]
        tree[i] = n
        while (i := i >> 1) and tree[i] == first:
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right
        return first
