"""The rule of op2: every placement makes the sum of squared counts of open sequences per gap least."""

from collections import Counter

import numpy as np

from ladderbook.llm.packing import sum_of_squares


def test_each_placement_makes_the_sum_least():
    rng = np.random.default_rng(9)
    for size, most, n in ((60, 61, 3000), (1024, 900, 1500), (10, 11, 400)):
        lengths = rng.integers(1, most, n)
        where, _ = sum_of_squares(lengths, size)
        gaps: dict[int, int] = {}
        count: Counter = Counter()
        square = 0

        def change(old, new, count=count):
            moved = Counter({old: -1}) if old is not None else Counter()
            if new:
                moved[new] += 1
            return sum((count[g] + d) ** 2 - count[g] ** 2 for g, d in moved.items())

        for x, s in zip(lengths.tolist(), where.tolist()):
            options = {size: change(None, size - x)} | {g: change(g, g - x) for g, c in count.items() if c and g >= x}
            old = gaps.get(s)
            taken = change(old, (old or size) - x)
            assert taken == min(options.values()), (x, old, options)
            square += taken
            if old is not None:
                count[old] -= 1
            gaps[s] = (old or size) - x
            if gaps[s]:
                count[gaps[s]] += 1
            else:
                del gaps[s]
        assert square == sum(c * c for c in count.values())
