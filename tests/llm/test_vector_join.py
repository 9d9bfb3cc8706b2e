import math

import numpy as np
import pytest

from pressmill.llm import vector_join

SCHEMA = "vec_id long, embedding array<double>, label int, gid long, root string, n int, links double, place string"


def plain(rows, dim, cosine=0.95):
    """(id, links, component, kept) of every row, all pairs compared."""
    good = [k for k, (_, x) in enumerate(rows) if x and len(x) == dim and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    at = list(range(len(rows)))

    def top(k):
        while at[k] != k:
            k = at[k]
        return k

    links = [0] * len(rows)
    x = {k: np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in good}  # no square overflows
    for a in good:
        for b in good:
            if a < b and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= cosine:
                links[a] += 1
                links[b] += 1
                at[top(b)] = top(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        known = least.get(top(k))
        least[top(k)] = i if known is None else known if i is None else min(i, known)
    return sorted(repr((i, links[k], least[top(k)], i == least[top(k)])) for k, (i, _) in enumerate(rows))


def run(spark, rows, **how):
    frame = spark.createDataFrame([(i, x, 1, 2, "r", 3, 0.5, "p") for i, x in rows], SCHEMA).repartition(3)
    found = vector_join.near_duplicates(frame, **how)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(repr(tuple(r)) for r in found.collect())


def planted(seed, dim=12):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(300)]
    rows += [rows[5] + rng.normal(size=dim) * 0.12 for _ in range(150)]  # a group of near copies, links of some pairs only
    rows += [rows[9] * f for f in (1, 1, 1, 2, 0.5)] + [rows[11]] * 90
    step = rng.normal(size=dim)
    rows += [rows[20] + step * t * 0.05 for t in range(40)]  # a chain
    order = rng.permutation(len(rows))
    return [(int(k) * 3, rows[i].tolist()) for k, i in enumerate(order)]


@pytest.mark.parametrize("how", [{}, {"least": 50, "most": 60, "leaf": 8, "sample": 100}, {"least": 100, "leaf": 3, "dims": 2, "sample": 1}])
def test_against_all_pairs(spark, how):
    rows = planted(4)
    rows += [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [float("nan")] + [1.0] * 11), (9004, [float("inf")] * 12), (9005, [None] + [1.0] * 11), (9006, [1.0] * 11)]
    rows += [(None, rows[0][1]), (None, [0.0] * 11 + [5.0]), (12, rows[4][1]), (12, rows[4][1]), (9010, [1e300] + [0.0] * 11), (9011, [1e-300] + [0.0] * 11)]
    assert run(spark, rows, **how) == plain(rows, 12)


def test_thresholds_and_empty_tables(spark):
    rows = planted(6)[:200]
    for cosine in (0.999999, 0.5):
        assert run(spark, rows, cosine=cosine, least=40, leaf=16) == plain(rows, 12, cosine)
    assert run(spark, []) == [] and run(spark, [(3, None)]) == [repr((3, 0, 3, True))]


def test_skipped_leaves_are_apart():
    rng = np.random.default_rng(1)
    x = vector_join.unit(rng.normal(size=(2000, 3)))
    basis = vector_join.axes(x[:500], 3)
    eps = vector_join.epsilon(0.99)
    cells = np.floor(x @ basis / eps)
    x = x[np.lexsort(cells.T[::-1])]
    a, b = (vector_join.Sequence.of(part, np.ones(len(part), np.int64), basis, 16) for part in (x[:1300], x[1300:]))
    for left, right in ((a, b), (a, a), (b, b)):
        kept = {tuple(p) for p in vector_join.near_leaves(left, right, eps).tolist()}
        every = len(left.boxes[0][0]) * len(right.boxes[0][0])
        assert 0 < len(kept) < every * 0.5
        score = left.x @ right.x.T
        for i, j in zip(*(k.tolist() for k in np.nonzero(score >= 0.99)), strict=True):
            if left is not right or i <= j:
                assert (i // 16, j // 16) in kept
