import random

from pyspark.sql import functions as F

from tests.llm.helpers import DOCUMENTS, awkward, nothing
from wardline.llm import langid

SYLLABLES = {"xx": "ka lo mi tu ne".split(), "yy": "bar gon dru fel wim".split(), "zz": "sia quo lue paio nee".split()}


def corpus(spark, n=150):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(60))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang, None, len(text)))
    return spark.createDataFrame(rows, DOCUMENTS)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.where(langid.held_out(F.col("doc_id"))).collect()}
    assert len(truth) > 20
    assert sum(got[i]["lang_pred"] == lang for i, lang in truth.items()) >= 0.97 * len(truth)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()


def test_awkward_rows(spark):
    model = langid.fit(corpus(spark))
    docs = awkward(spark).union(spark.createDataFrame([(900, "123 ... !!", None, None, None)], DOCUMENTS).selectExpr("*", "'c'", "'c'", "1", "'c'", "2"))
    got = langid.identify(docs, model).collect()
    assert len(got) == docs.count()
    texts = [r["text"] for r in docs.collect()]
    undetermined = sum(not t or not any(c.isalpha() for c in t) for t in texts)
    assert sum(r["lang_pred"] == "und" for r in got) == undetermined
    assert all(r["rejected"] for r in got if r["lang_pred"] == "und")
    assert langid.keep_identified(docs, model).columns == docs.columns


def test_one_language_and_none(spark):
    one = langid.fit(corpus(spark).where("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.identify(corpus(spark), one).collect()} == {"xx"}
    none = langid.fit(nothing(spark))
    assert {r["lang_pred"] for r in langid.identify(corpus(spark), none).collect()} == {"und"}
    assert langid.identify(nothing(spark), one).collect() == []
