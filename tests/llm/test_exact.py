import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCUMENTS, awkward, nothing
from wardline.llm import exact


def brute(rows, best):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = best((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_against_brute_force(spark, keep, best):
    docs = awkward(spark)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], best)
    assert sorted(map(tuple, exact.exact_duplicates(docs, keep).collect()), key=repr) == want


def test_colliding_digests_stay_apart(spark):
    docs = awkward(spark)
    weak = exact.exact_duplicates(docs, digest=lambda text: F.pmod(F.length(text), F.lit(2)))
    assert sorted(map(tuple, weak.collect()), key=repr) == sorted(map(tuple, exact.exact_duplicates(docs).collect()), key=repr)


def test_kept_rows_have_every_column(spark):
    docs = awkward(spark)
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.where("doc_id is not null").collect()]
    assert set(texts) == {r["text"] or "" for r in docs.collect()}
    assert len(set(texts)) == len(texts)


def test_only_the_judged_row_goes(spark):
    rows = [(1, "copy"), (None, "copy"), (None, "only here"), (2, "copy"), (2, "here alone"), (3, None), (None, ""), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    kept = [(r["doc_id"], r["text"]) for r in exact.drop_exact_duplicates(docs).collect()]
    want = [(1, "copy"), (None, "only here"), (2, "here alone"), (3, None), (None, "x"), (None, "x")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_no_rows(spark):
    assert exact.exact_duplicates(nothing(spark)).collect() == []
    assert exact.drop_exact_duplicates(nothing(spark)).collect() == []
