"""Slow row-by-row netting, written independently of the operators, to check them against."""

from __future__ import annotations

import random
from collections import defaultdict


def random_lines(seed: int, rows: int = 60, customers: int = 3, items: int = 2, days: int = 40):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        sale = rng.random() < 0.6
        when = f"2021-{1 + rng.randrange(days) // 20:02d}-{1 + rng.randrange(20):02d}T{rng.choice(['00', '10'])}:00:00"
        out.append((
            rng.randrange(customers), f"P{rng.randrange(items)}", f"{'' if sale else 'C'}{rng.randrange(20)}",
            float(rng.randint(1, 9) * (1 if sale else -1)), float(rng.choice([2, 3])), when,
        ))
    return out


def remaining(rows, policy: str) -> dict[int, float]:
    """Row number -> what is left of it."""
    left = {i: max(r[3], 0.0) for i, r in enumerate(rows)}
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[0], r[1]].append(i)
    for members in groups.values():
        members.sort(key=lambda i: (rows[i][5], i))
        for place, i in enumerate(members):
            need = -rows[i][3]
            if need <= 0:
                continue
            earlier = [j for j in members[:place] if rows[j][3] > 0]
            if policy == "price_compatible":
                earlier = [j for j in reversed(earlier) if rows[j][4] == rows[i][4]]
            for j in earlier:
                used = min(left[j], need)
                left[j] -= used
                need -= used
    return left


def remaining_before(rows, cutoff: str) -> dict[int, float]:
    """First-in-first-out state from rows strictly before the cutoff."""
    known = [i for i, r in enumerate(rows) if r[5] < cutoff]
    left = remaining([rows[i] for i in known], "fifo")
    return {known[k]: v for k, v in left.items() if v > 0}
