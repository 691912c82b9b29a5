import random

import numpy as np

from tests.llm.helpers import DOCUMENTS, awkward, nothing, words
from wardline.llm import nearcopies, simhash


def brute_set(text, k=5):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(parts[i : i + k]) for i in range(max(1, len(parts) - k + 1)))


def brute_stay(rows):
    """Rows (id, text) that stay."""
    sets = sorted({brute_set(t) for _, t in rows}, key=repr)
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(b)] = find(a)
    least = {}
    for i, t in rows:
        if i is not None:
            r = find(brute_set(t))
            least[r] = min(i, least.get(r, i))
    return [(i, t) for i, t in rows if i is None or least[find(brute_set(t))] == i]


def edited(rng, text, n):
    """``n`` words of a text replaced."""
    parts = text.split()
    for at in rng.sample(range(len(parts)), n):
        parts[at] = f"e{rng.randrange(10**6)}"
    return " ".join(parts)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS)
    got = [(r["doc_id"], r["text"]) for r in nearcopies.drop_near_copies(docs).collect()]
    want = brute_stay(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return len(rows) - len(want)


def test_similarity_around_the_limit(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):  # 0.7 to 0.95: one to seven edits in 200 words
        text = words(rng, 200, 5000)
        rows += [(2 * i, text), (2 * i + 1, edited(rng, text, 1 + i % 7))]
    assert 50 < check(spark, rows) < 120


def test_clouds_and_templates(spark):
    rng = random.Random(6)
    base, template = words(rng, 200, 5000), words(rng, 140, 5000)
    rows = [(i, edited(rng, base, rng.randrange(6))) for i in range(150)]
    rows += [(1000 + i, template + " " + words(rng, 60, 5000)) for i in range(150)]  # alike to about 0.5: all stay
    text = words(rng, 200, 5000)
    for i in range(30):  # a chain of links
        rows.append((2000 + i, text := edited(rng, text, 2)))
    check(spark, rows)


def test_only_the_judged_row_goes(spark):
    rng = random.Random(7)
    a, b = words(rng, 100, 5000), words(rng, 100, 5000)
    rows = [(1, a), (2, a + " tail"), (2, b), (None, words(rng, 50)), (None, a + " more"), (3, ""), (4, " \n"), (5, None)]
    assert check(spark, rows) == 3


def test_awkward_and_no_rows(spark):
    docs = awkward(spark)
    kept = nearcopies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = brute_stay([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert nearcopies.drop_near_copies(nothing(spark)).collect() == []


def join_rows(plan):
    """Rows that each join of an executed plan has made."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return join_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return join_rows(plan.plan())
    own = [plan.metrics().get("numOutputRows").get().value()] if "Join" in name else []
    below = plan.children()
    return own + [n for i in range(below.size()) for n in join_rows(below.apply(i))]


def test_a_cloud_meets_only_what_can_be_near(spark):
    """400 sets of one label and 40 of others share 80 of 100 shingles: too few, but enough for one set of just these."""
    core = list(range(80))
    own = iter(range(1000, 10**6))
    cloud = [core + list(range(80, 98)) + [next(own) for _ in range(2)] for _ in range(400)]
    rest = [core + [next(own) for _ in range(20)] for _ in range(40)] + [core]
    rows = [(v, -1 if v < 400 else v, s) for v, s in enumerate(cloud + rest)]
    told = spark.createDataFrame([(v, 7, label) for v, label, _ in rows], "v long, key long, label long")
    sets = spark.createDataFrame([(v, len(s), 1, s) for v, _, s in rows], "v long, n long, weight long, shingles array<long>")
    pairs = nearcopies._prefix_pairs(told, sets, 80)
    assert {tuple(sorted(r)) for r in pairs.collect()} == {(v, 440) for v in range(440)}
    made = join_rows(pairs._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 440


def test_close_fingerprints_link_without_a_shared_key(spark, monkeypatch):
    """With keys that no two sets share, what is left is the way by SimHash and pivots; it is verified as well."""
    rng = random.Random(14)
    text, other = words(rng, 3000, 10**6), words(rng, 300, 10**6)
    rows = [(1, text), (2, edited(rng, text, 1)), (3, other), (4, edited(rng, other, 60)), (5, words(rng, 300, 10**6))]
    a, b = (simhash.majority(nearcopies.shingle_set(t.encode(), 5)) for _, t in rows[:2])
    assert 0 < (a ^ b).bit_count() <= nearcopies.DISTANCE
    monkeypatch.setattr(nearcopies, "band_keys", lambda hashes: np.arange(32, dtype=np.uint64) + hashes.sum())
    assert check(spark, rows) == 1
    monkeypatch.setattr(nearcopies, "majority", lambda hashes: 0)  # every pair looks close
    assert check(spark, rows[2:]) == 0
