import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import hardnegatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, node string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


def brute(rows, positives=5, negatives=5):
    ok = {(i, l, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, l in rows
          if i is not None and l is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    lengths = defaultdict(int)
    for _, v, _ in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            lengths[len(v)] += 1
    most = max(lengths, key=lambda n: (lengths[n], n), default=0)
    ok = [r for r in ok if len(r[2]) == most]
    out = []
    for i, l, x in ok:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in ok)
        for s, j, _ in [r for r in scored if r[2] == l and r[1] != i][:positives]:
            fit = [r for r in scored if r[2] != l and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(i, j, n, k, -s, -t) for n, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(table, **more):
    return sorted(map(tuple, H.mine(table, F.col("vec_id") % 10 == 0, **more).collect()))


def clouds(rng, n, dim=6, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("node_rows", [8, 64, 8192])
def test_against_brute_force(spark, node_rows, monkeypatch):
    monkeypatch.setattr(H, "VISITS", 4)
    monkeypatch.setattr(H, "BLOCK", 8)
    monkeypatch.setattr(H, "CHUNK", 5)
    rng = random.Random(2)
    rows = clouds(rng, 240)
    rows += [(i, rows[5][1], i % 3) for i in range(300, 420)]  # copies of a vector: ties
    rows += [rows[0]] * 3 + [(500, [0.0] * 6, 1), (510, [0.0] * 6, 1)]
    assert mined(frame(spark, rows), node_rows=node_rows) == brute(rows)


def test_awkward_rows(spark):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = clouds(rng, 60, 3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (70, None, 1), (80, [1.0, None, 0.0], 1), (90, [nan, 0.0, 0.0], 2), (91, [0.0, -inf, 0.0], 2)]
    rows += [(100, [1.0, 2.0], 1), (110, [], 1), (120, [1.0, 1.0, 1.0], None), (10, [0.5, 0.5, 0.5], 1), (30, [0.5, 0.5, 0.5], 1)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_large_components_stay_exact_or_fail(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 1]) * float(2 ** rng.randrange(12, 21)) + 1 for _ in range(4)], i % 2) for i in range(40)]
    assert mined(frame(spark, rows)) == brute(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(frame(spark, [(i, [1e12, 1e12], i % 2) for i in range(20)]))
    with pytest.raises(Exception, match="64 bits"):
        mined(frame(spark, [(i, [1e30, 1.0], i % 2) for i in range(20)]))


def test_no_rows(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(10, [1.0], 1)])) == []


def test_boxes_bound_every_product():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-50, 50, (700, 5)), rng.integers(-50, 50, (9, 5))
    leaves = H.str_leaves(x, rng.integers(0, 3, 700), 40)
    assert sorted(np.concatenate(leaves)) == list(range(700)) and max(map(len, leaves)) <= 40
    least, most = H.intervals(q, np.array([x[t].min(axis=0) for t in leaves]), np.array([x[t].max(axis=0) for t in leaves]))
    for t, rows in enumerate(leaves):
        products = q @ x[rows].T
        assert (least[:, t] <= products.min(axis=1)).all() and (products.max(axis=1) <= most[:, t]).all()
