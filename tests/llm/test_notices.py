import random
import re

from tests.llm.helpers import awkward, nothing, words
from wardline.llm import notices


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute_base(text):
    ws = split(text)
    places = []
    for phrase, label in notices.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def texts(rng):
    out = [None, "", "MIT License MIT license mit-license", "gnu General Public License apache license", "mitlicense", "É mit\nlicense", "xmit license"]
    for notice in notices.NOTICES:
        for edits in range(6):
            chars = list(notice)
            for _ in range(edits):
                at = rng.randrange(1, len(chars) - 1)
                chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "k"]])
            out.append(f"{words(rng, 5)}. {''.join(chars).title()}, {words(rng, 5)}")
    return out


def test_base_places(spark):
    rng = random.Random(1)
    rows = [(i, t, "clash") for i, t in enumerate(texts(rng))] + [(None, "mit license", None), (3, "mit license", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = notices.scan(docs).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr)
    assert found == sorted(((i, *brute_base(t)) for i, t, _ in rows), key=repr)
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)


def test_every_edit_within_the_bound_is_found():
    rng = random.Random(2)
    for notice, label in notices.NOTICES.items():
        allowed = notices.edits_allowed(notice, 0.08)
        for _ in range(40):
            chars = list(notice)
            for _ in range(rng.randrange(0, allowed + 3)):
                at = rng.randrange(1, len(chars) - 1)
                chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "k"]])
            edited = "".join(chars)
            joined = f" start {' '.join(edited.split())} end ".encode()
            places = notices.fuzzy_places(joined, notice, allowed)
            true = distance(notice, " ".join(edited.split()))
            if true <= allowed:
                assert places and min(p[2] for p in places) <= true
            for start, end, edits in places:
                assert edits <= allowed and distance(notice, joined[start:end].decode()) <= edits


def test_places_on_both_sides_of_a_better_one():
    notice = "licensed under the apache license version 2 0"
    parts = [notice.replace("under", "undr"), notice, notice.replace("apache", "apche"), notice, notice.replace("version", "versoin")]
    for chosen in (parts[:2], parts[1:3], parts, parts[::-1]):
        joined = f" {' '.join(chosen)} ".encode()
        places = notices.fuzzy_places(joined, notice, notices.edits_allowed(notice, 0.08))
        assert [joined[a:b].decode() for a, b, _ in places] == chosen
        assert [e for *_, e in places] == [distance(notice, c) for c in chosen]


def test_spans_are_words(spark):
    docs = spark.createDataFrame([(1, "One two. Released under teh MIT Licence. Three")], "doc_id long, text string")
    row = notices.scan(docs, share=0.15).first()
    span = row["spans"][0]
    ws = split("One two. Released under teh MIT Licence. Three")
    assert ws[span["first_word"] : span["last_word"] + 1] == ["released", "under", "teh", "mit", "licence"]
    assert span["label"] == "mit" and row["n_base"] == 0 and row["labels"] == "mit"


def test_awkward_and_no_rows(spark):
    docs = awkward(spark)
    assert notices.scan(docs).count() == docs.count()
    assert notices.scan(nothing(spark)).collect() == []


def test_cost_is_linear_in_the_text():
    import time

    text = ("word mit license and more of the text " * 260_000).encode()  # 10 MB, 260,000 places
    begun = time.process_time()
    words, base, _ = notices.scan_text(text, notices.PHRASES, notices.NOTICES, 0.08)
    assert words == 8 * 260_000 and len(base) == 260_000 and base[-1][0] == words - 7
    assert time.process_time() - begun < 60
