import math
import random

import numpy as np
import pytest

from wardline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, weight string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", "clash", 1) for r in rows], SCHEMA)


def whole(rows):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) == 7 and all(c is not None and math.isfinite(c) for c in v)]


def check(spark, rows, components=5, weight="count"):
    ok = whole(rows)
    found = whitening.whiten_table(frame(spark, rows), components=components, weight=weight).collect()
    assert len(found) == components * len(ok)
    xs = [x for _, x in ok] if weight == "count" else [list(x) for x in sorted({tuple(x) for _, x in ok})]
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in xs])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    of = {}
    for r in found:
        of.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
    mine = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for _, x in ok])
    for c in range(components):
        z = mine @ vectors[:, c] / math.sqrt(values[c])
        got = sorted((r["vec_id"], r["whitened"]) for r in of[c + 1])
        want = min((sorted(zip([i for i, _ in ok], s * z)) for s in (1, -1)), key=lambda w: sum(abs(a[1] - b[1]) for a, b in zip(got, w)))
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([a for _, a in got], [a for _, a in want], atol=1e-8)
        deviations = sorted((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in ok)
        assert sorted((r["vec_id"], r["deviation"]) for r in of[c + 1]) == deviations


def sample(n, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(k, 0.3 + 0.2 * k) for k in range(7)]) for i in range(n)]


@pytest.mark.parametrize("weight", ["count", "one"])
def test_against_numpy(spark, weight):
    rows = sample(200)
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # copies weigh as many times
    rows += [rows[0], rows[0]]
    check(spark, rows, weight=weight)


def test_awkward_rows(spark):
    rows = sample(40, 2)
    rows += [(100, None), (101, [1.0] * 6 + [None]), (102, [float("nan")] * 7), (103, [float("inf")] * 7), (104, []), (105, [1.0])]
    check(spark, rows)


def test_components_without_variance(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(5)]
    found = whitening.whiten_table(frame(spark, rows)).collect()
    assert len(found) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in found)
    assert {round(r["explained"], 9) for r in found if r["component"] == 1} == {1.0} and found[0]["identity_error"] < 1e-9
    alone = whitening.whiten_table(frame(spark, rows[:1])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in alone] == [(None, None, 0)] * 3


def test_deviation_beyond_64_bits_fails(spark):
    with pytest.raises(Exception, match="int|overflow|Overflow|convert"):
        whitening.whiten_table(frame(spark, [(i, [i * 1e9, 0.0]) for i in range(9)])).collect()


def test_no_rows(spark):
    assert whitening.whiten_table(frame(spark, [])).collect() == []
    assert whitening.whiten_table(frame(spark, [(1, None)])).collect() == []
