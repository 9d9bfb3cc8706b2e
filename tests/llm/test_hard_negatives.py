import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from pressmill.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id long, key string, n int, score double, positives string"
LONG = 2**63 - 1


def plain(rows, k=5, m=10, dim=None):
    """Straight from the contract, in whole numbers."""
    good = [(i, y, [math.floor(256 * v) for v in x]) for i, x, y in rows if i is not None and y is not None and x and all(v is not None and math.isfinite(v) for v in x) and len(x) == dim]
    good = [(i, (y + 1) % 10 if i % 7 == 0 else y, x) for i, y, x in good]
    out = []
    for i, y, x in (r for r in good if r[0] % 100 == 0):
        score = [(max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(x, u, strict=True)))), j, z) for j, z, u in good if j != i]
        best = sorted(((-s, j) for s, j, z in score if z == y))[:k]
        for p, j in best:
            found = sorted((-s, v) for s, v, z in score if z != y and 30 * -p <= 100 * s <= 90 * -p)[:m]
            out += [(i, j, r + 1, v, -p, -s) for r, (s, v) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **how):
    frame = spark.createDataFrame([(i, x, y, 1, "k", 2, 0.5, "p") for i, x, y in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, label, **how).collect()))


def vectors(n, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, 6)) * spread
    return [(i, (centre[i % 4] + rng.normal(size=6) * spread).round(3).tolist(), int(i * 7 % 10)) for i in range(n)]


def test_against_plain_search(spark):
    rows = vectors(900, 1)
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(120)]  # copies of an anchor under several labels
    rows += [(i, None, 1) for i in (200_000, 3)] + [(200_100, [0.1] * 6, None), (None, [0.1] * 6, 2), (200_200, [float("nan")] + [0.1] * 5, 2), (200_300, [float("inf")] * 6, 2), (200_400, [None] + [0.2] * 5, 2), (200_500, [0.1] * 5, 2), (200_600, [], 2), (200_700, [0.0] * 6, 2)]
    want = plain(rows, dim=6)
    assert len(want) > 300
    assert run(spark, rows, chunk=3, least=100, sample=200, cells=16) == want
    assert run(spark, rows) == want


def test_few_rows_ties_and_repeats(spark):
    same = [0.5] * 4
    rows = [(0, same, 1), (100, same, 1), (3, same, 1), (5, [0.25] * 4, 2), (6, [0.25] * 4, 2), (6, [0.25] * 4, 2), (8, [0.25] * 4, 3), (3, same, 1), (9, [-0.5] * 4, 4)]
    assert run(spark, rows) == plain(rows, dim=4) != []
    assert run(spark, []) == [] and run(spark, [(1, same, 1), (2, same, 2)]) == [] == run(spark, [(0, same, 1)])


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i * 50, [rng.choice([1, -1]) * 10.0 ** rng.randint(-3, 9) for _ in range(3)], i % 2) for i in range(60)]
    assert run(spark, rows, cells=8) == plain(rows, dim=3) != []
    run(spark, [(i, [1.7e308 * (-1) ** i, 1e300], i % 2) for i in range(0, 400, 25)])


@pytest.mark.parametrize("scale", [300, 4, 1e12])
def test_bounds_hold(scale):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(400, 5)) * scale)
    x[:60] = x[0]
    cells = hard_negatives.cells_of(x[rng.choice(400, 90)], x.min(0), x.max(0), 12)
    codes = cells.codes(x).astype(np.intp)
    for anchor in x[::40]:
        low, high = hard_negatives.bounds(*hard_negatives.tables(cells, anchor), codes)
        exact = [sum(int(a) * int(b) for a, b in zip(r, anchor, strict=True)) for r in x]
        assert all(a <= s <= b for a, s, b in zip(low.tolist(), exact, high.tolist(), strict=True))
