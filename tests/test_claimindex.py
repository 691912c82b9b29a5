import pytest
from pyspark.sql import functions as F

from wardline.operators import adjudicate as A
from wardline.operators import claimindex as X
from wardline.operators import drift as D

from test_scoring import SWEEP_TIERS, WEIGHTS, claim, claims_df, closed_df, policy

CORPUS = "corpus_version string, position bigint, predicate string, value string, weight bigint, techniques array<string>"
HOT = "CONNECTED_TO_INDICATOR"


def versions(spark, before, after):
    rows = [(v, i, HOT, value, w, []) for v, entries in (("v1", before), ("v2", after)) for i, (value, w) in enumerate(entries.items())]
    return spark.createDataFrame(rows, CORPUS)


@pytest.fixture(scope="module")
def world(spark):
    rows = []
    for i in range(400):
        rows += [claim(f"c{i}", "AUTH_FAILED_BURST"), claim(f"c{i}", HOT, seq=1, object=f"ip{i % 80}"), claim(f"c{i}", HOT, seq=2)]
    claims, pol = claims_df(spark, rows).cache(), policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    closed = closed_df(spark, claims, pol, sorted({r[0] for r in rows})).cache()
    return claims, pol, closed


def plain(drifts):
    cols = [c for c in drifts.columns if c != "carried"]
    return sorted(repr(sorted(r.asDict(True).items())) for r in drifts.select(*cols).collect())


def files_read(df):
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    leaves = plan.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_incremental_equals_full(spark, world, tmp_path):
    claims, pol, closed = world
    before = {f"ip{i}": 5000 for i in range(40)}
    after = {**{f"ip{i}": 5000 for i in range(2, 40)}, "ip5": 1, **{f"ip{i}": 5000 for i in range(50, 54)}}
    corpus = versions(spark, before, after)
    assert {(r.value, r.change) for r in X.corpus_delta(corpus, "v1", "v2").collect()} == (
        {("ip0", "removed"), ("ip1", "removed"), ("ip5", "changed")} | {(f"ip{i}", "added") for i in range(50, 54)}
    )
    index = X.ClaimIndex(spark, str(tmp_path), 8)
    index.append(claims.filter("case_id < 'c5'"), 0)
    index.append(claims.filter("case_id >= 'c5'"), 1)
    index.append(claims.filter("case_id >= 'c5'"), 1)  # a repeated batch adds nothing
    first = D.drift_sweep(closed, claims, pol, "p", corpus, "v1", "k")
    again = X.incremental_sweep(closed, index, pol, "p", corpus, "v1", "v2", first, "k").cache()
    assert plain(again) == plain(D.drift_sweep(closed, claims, pol, "p", corpus, "v2", "k"))
    assert again.filter("not carried").count() == 4 * 5 and again.filter("carried").count() == 37 * 5
    with pytest.raises(Exception, match="not one under corpus version v2"):
        X.incremental_sweep(closed, index, pol, "p", corpus, "v2", "v1", first, "k").collect()


def test_new_cases_are_swept_and_untouched_ones_not_read(spark, world, tmp_path):
    claims, pol, closed = world
    corpus = versions(spark, {"ip1": 5000}, {"ip1": 5000, "ip7": 5000})
    late = F.col("case_id").isin("c1", "c2", "c81")
    index = X.ClaimIndex(spark, str(tmp_path), 16)
    index.append(claims.filter(~late), 0)
    first = D.drift_sweep(closed.filter(~late), claims.filter(~late), pol, "p", corpus, "v1", "k")
    index.append(claims.filter(late), 1)
    new = closed.filter(late).select("case_id")
    out = X.incremental_sweep(closed, index, pol, "p", corpus, "v1", "v2", first, "k", new)
    assert plain(out) == plain(D.drift_sweep(closed, claims, pol, "p", corpus, "v2", "k"))
    touched = index.cases_with(spark.createDataFrame([(HOT, "ip7")], "predicate string, object string"))
    assert {r.case_id for r in touched.collect()} == {f"c{i}" for i in range(7, 400, 80)}
    buckets = [r[0] for r in touched.select(index._bucket("case_id")).distinct().collect()]
    scan = spark.read.parquet(index.claims_path)
    assert files_read(scan.filter(F.col("bucket").isin(buckets))) < files_read(scan) / 2
    assert {r.case_id for r in index.claims_of(touched).collect()} == {f"c{i}" for i in range(7, 400, 80)}


def test_emptied_corpus_and_no_change(spark, world, tmp_path):
    claims, pol, closed = world
    index = X.ClaimIndex(spark, str(tmp_path), 8)
    index.append(claims, 0)
    corpus = versions(spark, {"ip1": 5000, "ip2": 5000}, {})
    first = D.drift_sweep(closed, claims, pol, "p", corpus, "v1", "k")
    assert X.incremental_sweep(closed, index, pol, "p", corpus, "v1", "v2", first, "k").count() == 0
    same = versions(spark, {"ip1": 5000}, {"ip1": 5000})
    first = D.drift_sweep(closed, claims, pol, "p", same, "v1", "k")
    out = X.incremental_sweep(closed, index, pol, "p", same, "v1", "v2", first, "k")
    assert [(r.case_id, r.carried, r.indicator_corpus_version) for r in out.orderBy("case_id").collect()] == [(c, True, "v2") for c in ("c1", "c161", "c241", "c321", "c81")]
