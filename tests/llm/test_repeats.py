import hashlib
import random
from collections import Counter

import pytest

from tests.llm.helpers import DOCUMENTS, awkward, nothing, words
from wardline.llm import repeats


def brute(rows, length):
    counts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        counts.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if counts[data[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [400, 64])
def test_awkward_rows(spark, length):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = repeats.remove_repeats(docs, length).collect()
    assert sorted((tuple(r)[:-1] for r in found), key=repr) == brute(rows, length)
    left = [len(r["text"].encode()) - (r["n_bytes"] - r["n_removed"]) for r in found]
    assert all(-6 <= less <= 0 for less in left) and left.count(0) > len(left) // 2


@pytest.mark.parametrize("seed", range(3))
def test_passages_cut_at_random(spark, seed):
    rng = random.Random(seed)
    source = "".join(rng.choice("abcd \n") for _ in range(3000))
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(2900)
            parts.append(source[a : a + rng.randrange(20, 260)])
            parts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(0, 90))))
        rows.append((i, "".join(parts), None, None, None))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = sorted((tuple(r)[:-1] for r in repeats.remove_repeats(docs, 100).collect()), key=repr)
    assert got == brute([r[:2] for r in rows], 100)


def test_long_text_crosses_stretches(spark, monkeypatch):
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh") for _ in range(4000))
    whole = [repeats.anchors((body * 3).encode(), 200)]
    monkeypatch.setattr(repeats, "STRETCH", 500)
    cut = repeats.anchors((body * 3).encode(), 200)
    covered = [set().union(*(range(a, b + 1) for a, b in zip(x[1], x[2]))) for x in (whole[0], cut)]
    assert covered[0] == covered[1] == set(range(len(body) * 3 - 199))
    assert {*zip(whole[0][0].tolist(), whole[0][3].tolist())} == {*zip(cut[0].tolist(), cut[3].tolist())}


def test_cut_keeps_columns_and_characters(spark):
    docs = awkward(spark)
    cut = repeats.cut_repeats(docs, 400)
    assert cut.columns == docs.columns
    want = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in repeats.remove_repeats(docs, 400).collect()}
    for r in cut.where("doc_id is not null").collect():
        assert len((r["text"] or "").encode()) in (want[r["doc_id"]], want[r["doc_id"]] - 1, want[r["doc_id"]] - 2)
        assert r["n_chars"] is None or r["n_chars"] == len(r["text"])


def brute_words(rows, length):
    """Texts left if every word within a repeated run of ``length`` words goes; white space does not count."""
    counts = Counter()
    for _, text in rows:
        ws = (text or "").split()
        counts.update(tuple(ws[i : i + length]) for i in range(len(ws) - length + 1))
    out = []
    for i, text in rows:
        ws = (text or "").split()
        gone = set()
        for p in range(len(ws) - length + 1):
            if counts[tuple(ws[p : p + length])] > 1:
                gone.update(range(p, p + length))
        out.append((i, [w for p, w in enumerate(ws) if p not in gone]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_runs_of_words(spark, seed):
    rng = random.Random(seed)
    source = words(rng, 900, 5000).split()
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(800)
            parts += source[a : a + rng.randrange(40, 90)] + words(rng, rng.randrange(30), 5000).split()
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t"]) for w in parts), None, None, None))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = [(r["doc_id"], (r["text"] or "").split()) for r in repeats.cut_repeats(docs, 10**6, words=51).collect()]
    assert sorted(got, key=repr) == brute_words([r[:2] for r in rows], 51)


def test_no_rows(spark):
    assert repeats.remove_repeats(nothing(spark)).collect() == []
    assert repeats.cut_repeats(nothing(spark)).collect() == []
