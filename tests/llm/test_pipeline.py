import importlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm import test_nearcopies, test_packing, test_repeats
from tests.llm.helpers import DOCUMENTS, awkward, words
from wardline.llm import langid, queries
from wardline.queries.harness import compare, duck

pipeline = importlib.import_module("corpus_pipeline")
SF = "/root/testdata/sf0.001"
COLUMNS = [c.split()[0] for c in DOCUMENTS.split(", ")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    awkward(spark).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "sequences":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        after[name] = docs = spark.read.parquet(str(tmp_path / name))
    pairs = {name: [(r["doc_id"], r["text"]) for r in df.collect()] for name, df in after.items() if name != "sequences"}

    start = spark.read.parquet(f"{folder}/documents.parquet")
    judged = langid.identify(start, queries.language_model(start)).where("not rejected")
    assert sorted((i for i, _ in pairs["language"]), key=repr) == sorted((r["doc_id"] for r in judged.collect()), key=repr)

    least = {}
    for i, text in pairs["language"]:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    want = [(i, t) for i, t in pairs["language"] if least.get(t or "", i) == i]
    assert sorted(pairs["exact_copies"], key=repr) == sorted(want, key=repr)

    assert sorted(pairs["near_copies"], key=repr) == sorted(test_nearcopies.brute_stay(pairs["exact_copies"]), key=repr)

    removed = {r[0]: r[1] - r[2] for r in test_repeats.brute(pairs["near_copies"], 400)}
    assert len(pairs["repeated_passages"]) == len(pairs["near_copies"])
    for i, text in pairs["repeated_passages"]:
        assert 0 <= removed[i] - len((text or "").encode()) <= 6

    rows = after["sequences"].collect()
    test_packing.check(rows, pairs["repeated_passages"], 2048)
    assert sorted(map(tuple, pipeline.run(spark, folder).drop("sequence_id", "offset").collect()), key=repr) == sorted(
        (tuple(r)[:5] for r in rows), key=repr
    )


def test_only_what_a_result_reads_stays_on_disk(spark, folder, monkeypatch, tmp_path):
    from wardline.llm import common

    monkeypatch.setattr(common, "scratch_path", lambda _, name: str(tmp_path / "scratch" / name))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:4]:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = sorted(p.rsplit("-", 1)[0] for p in os.listdir(tmp_path / "scratch"))
    assert left == ["intervals", "near-gone"]


def test_short_passages_are_taken_out(spark):
    import random

    rng = random.Random(12)
    rows, want = [], []
    for n in (50, 51, 52, 58, 65):
        passage = words(rng, n, 5000)
        for _ in range(2):
            before, behind = words(rng, 150, 5000), words(rng, 150, 5000)
            rows.append((len(rows), f"{before} {passage} {behind}", "en", "s", 1))
            want.append(f"{before} {passage} {behind}".split() if n == 50 else f"{before} {behind}".split())
    assert max(len(t.encode()) for t in (passage,)) < 400
    got = pipeline.repeated_passages(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()
    assert [r["text"].split() for r in sorted(got)] == want


def test_rows_of_one_id_are_judged_one_by_one(spark):
    import random

    rng = random.Random(13)
    a, b, c = (words(rng, 100, 5000) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (2, a), (2, c), (3, c + " tail"), (3, words(rng, 100, 5000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS)
    left = pipeline.near_copies(spark, pipeline.exact_copies(spark, docs, ""), "")
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[2], rows[4], rows[6]], key=repr)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_clean_documents_stay(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows = [(i, words(rng, 150, 3000) + " plain words here", "en", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == set(range(60))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, name):
    assert entry.queries()[name] is queries.QUERIES[name]
    ok, message = compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert ok, message


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy_on_the_tables(spark):
    sf = SF.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    seen = queries.op7(spark, sf).where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert seen > 0.97
