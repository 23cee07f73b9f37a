"""The bands of known pages leave few pairs, and every pair that is near enough."""

import random

from sparkfolio.operators import known_pages as P


def test_bands_leave_few_pairs_and_all_near_ones(spark):
    rng = random.Random(5)
    looks = [(i, 1240, 1754, [float(rng.randint(100, 156)) for _ in range(64)]) for i in range(300)]
    moved = [(i, w, h, [x + (1 if j % 4 == i % 4 else 0) for j, x in enumerate(t)]) for i, w, h, t in looks]
    known = spark.createDataFrame(looks, "look long, width int, height int, thumb array<double>")
    mine = spark.createDataFrame(moved, "look long, width int, height int, thumb array<double>")
    assert P.met(mine, known).count() < 300 * 300 / 20
    assert {(r.look, r.page_id) for r in P.compared(mine, known).collect()} >= {(i, i) for i in range(300)}
