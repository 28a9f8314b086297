import math
import random
from collections import Counter

import pytest

from accordant.operators.atoms import ATOMS, atoms


def told(spark, rows):
    frame = spark.createDataFrame(rows, "a string, b string, c string").repartition(3)
    return atoms(frame, "a", "b", "c").first()


def plain(rows):
    """Cell by cell, from the probabilities of events."""
    n = len(rows)
    p = lambda holds: sum(map(holds, rows)) / n
    i_x = i_y = i_xy = r = 0.0
    for (x, y, t), c in Counter(rows).items():
        either = lambda q, x=x, y=y: q[0] == x or q[1] == y
        of_t = p(lambda q, t=t: q[2] == t)
        i_x += c / n * math.log2(p(lambda q, x=x, t=t: q[0] == x and q[2] == t) / of_t / p(lambda q, x=x: q[0] == x))
        i_y += c / n * math.log2(p(lambda q, y=y, t=t: q[1] == y and q[2] == t) / of_t / p(lambda q, y=y: q[1] == y))
        i_xy += c / n * math.log2(c / n / of_t / p(lambda q, x=x, y=y: q[:2] == (x, y)))
        r += c / n * math.log2(p(lambda q, t=t, e=either: e(q) and q[2] == t) / of_t / p(either))
    return i_x, i_y, i_xy, r, i_x - r, i_y - r, i_xy - i_x - i_y + r


def test_known_and_random_tables(spark):
    xor = [(str(a), str(b), str(a ^ b)) for a in (0, 1) for b in (0, 1)] * 5
    got = told(spark, xor)
    assert [got[c] for c in ATOMS] == pytest.approx([0, 0, 1, math.log2(2 / 3), -math.log2(2 / 3), -math.log2(2 / 3), 1 + math.log2(2 / 3)], abs=1e-12)
    copy = told(spark, [(x, x, x) for x in "aabbbc"])
    assert copy.redundancy == pytest.approx(copy.i_xy) and copy.synergy == pytest.approx(0, abs=1e-12)
    rng = random.Random(4)
    rows = [(rng.choice(["p", "q", None]), rng.choice("uvw"), rng.choice(["1", "2"])) for _ in range(300)]
    rows += [(a, b, "3" if a == "p" else "1") for a, b, _ in rows[:100]]
    got = told(spark, rows)
    assert [got[c] for c in ATOMS] == pytest.approx(plain(rows), abs=1e-9)
    assert sum(got[c] for c in ATOMS[3:]) == pytest.approx(got.i_xy)
    assert all(x is None for x in told(spark, []))
