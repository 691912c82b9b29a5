import hashlib
import random

from pyspark.sql import functions as F

from tests.llm.helpers import DOCUMENTS, awkward, nothing, words
from wardline.llm import imatch


def edit(text, following):
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def check_texts(docs, got):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    known = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {}
    for i, (doc_id, text) in enumerate(known):
        follower = known[(i + 1) % len(known)]
        told = sum(r[0] == follower[0] for r in rows) == 1 or len({r[1] for r in rows if r[0] == follower[0]}) == 1
        by_id.setdefault(doc_id, []).append((text, follower[1] if told else None))
    assert len(got) == len(rows)
    for r in got:
        if len(by_id[r["doc_id"]]) == 1:
            text, following = by_id[r["doc_id"]][0]
            assert r["n_chars"] == len(text)
            assert following is None or r["edited_sha256"] == hashlib.sha256(edit(text, following).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = {}
    for r in got:
        for text, _ in by_id[r["doc_id"]][:1]:
            if len(by_id[r["doc_id"]]) == 1:
                prints.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_awkward_rows(spark):
    docs = awkward(spark)
    check_texts(docs, imatch.fingerprint_edits(docs).collect())


def test_many_ranges(spark):
    rng = random.Random(1)
    rows = [(i * i * 7 - 50, words(rng, rng.randrange(0, 60)), None, None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    seen = imatch.with_next(docs, buckets=9).where("not guest").collect()
    texts = [r[1] for r in sorted(rows)]
    want = dict(zip(texts, texts[1:] + texts[:1]))
    assert len(seen) == 60 and all(r["next"] == want[r["text"]] for r in seen)


def test_edits_stay_near_and_others_far(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 400, 3000), None, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = imatch.fingerprint_edits(docs, imatch.Lexicons(high=0.5)).collect()
    assert sum(r["near_edited"] for r in got) / 300 > 0.35
    assert sum(r["near_next"] for r in got) / 300 < 0.1


def test_band_against_brute_force(spark):
    rng = random.Random(3)
    texts = [words(rng, 50, 500) for _ in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    every = imatch.Lexicons(rates=(1 / 16,), low=0.05, high=0.1)
    df = {}
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    want = spark.createDataFrame([(w,) for w, n in df.items() if 10 <= n <= 20], "w string").selectExpr("xxhash64(w) as term")
    got = {r["term"] for r in imatch.band(docs, every).collect()}
    assert got == {r["term"] for r in want.collect()}


def test_band_counts_copies_once(spark):
    rng = random.Random(5)
    text = words(rng, 50, 500)
    rows = [(text,)] * 150 + [(words(rng, 50, 5000),) for _ in range(299)]
    docs = spark.createDataFrame(rows, "text string")
    every = imatch.Lexicons(rates=(1 / 64,), low=1 / 300)
    got = {r["term"] for r in imatch.band(docs, every).collect()}
    own = spark.createDataFrame([(text,)], "text string").select(imatch.term_hashes(F.col("text"), every)).first()[0]
    assert len(own) > 10 and len(set(own) & got) > 0.8 * len(own)


def test_hot_texts_stay_near_their_edits(spark):
    rng = random.Random(6)
    text, template = words(rng, 400, 90000), words(rng, 300, 90000)
    texts = [text] * 100 + [template + f" n{i}" for i in range(100)] + [words(rng, 400, 3000) for _ in range(100)]
    order = list(range(300))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in zip(order, texts)], DOCUMENTS)
    got = {r["doc_id"]: r for r in imatch.fingerprint_edits(docs).collect()}
    of = dict(zip(order, texts))
    for start in (0, 100):  # copies of one text, and one template above the band
        really = [got[i] for i in order[start : start + 100] if i < 299 and of[i + 1][:40] != of[i][:40]]
        assert len(really) > 30 and sum(r["near_edited"] for r in really) / len(really) > 0.25


def test_fixed_documents(spark):
    one = spark.createDataFrame([(5, "Only one text here", None, None, None)], DOCUMENTS)
    row = imatch.fingerprint_edits(one).first()
    assert row["edited_sha256"] == hashlib.sha256(edit("Only one text here", "Only one text here").encode()).hexdigest()
    assert row["near_next"] == 1.0
    assert imatch.fingerprint_edits(nothing(spark)).collect() == []
