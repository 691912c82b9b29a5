import random
import zlib

import public_tokenizers
import pytest

from tests.llm.helpers import awkward, nothing, words
from wardline.llm import sentencepieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(PATH)


def whole_text_viterbi(pieces, text):
    """The textbook search over the whole text at once."""
    marked = sp.SPACE + text.replace(" ", sp.SPACE) if text else ""
    best = [(0, 0)] + [None] * len(marked)
    for n in range(1, len(marked) + 1):
        options = []
        for size in range(min(pieces.longest, n), 0, -1):
            known = pieces.cost.get(marked[n - size : n])
            if known:
                options.append((best[n - size][0] + known[0], -size))
        options.append((best[n - 1][0] + pieces.byte_cost * len(marked[n - 1].encode()), 0))
        cost, size = min(options)
        best[n] = (cost, -size or 1)
    ids, n = [], len(marked)
    while n:
        size = best[n][1]
        piece = marked[n - size : n]
        ids[:0] = [pieces.cost[piece][1]] if piece in pieces.cost else [pieces.bytes[b] for b in piece.encode()]
        n -= size
    return ids


TEXTS = ["", " ", "a", "  two  spaces ", "Hello world", "naïve café 梦 漢字 \U0001f600", "line\nbreak\ttab", "x" * 3000, "ab" * 700, "\x00\x01", "the the", "a" + " " * 40 + "b"]


def test_against_whole_text_search(encoder):
    rng = random.Random(1)
    more = ["".join(rng.choice("abcdehinorst  é\n梦") for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    for text in TEXTS + more:
        ids = list(memoryview(encoder.encode(text)).cast("I"))
        assert ids == whole_text_viterbi(encoder.pieces, text), repr(text)
        assert b"".join(encoder.pieces.raw[i] for i in ids).removeprefix(b" ").decode() == text


def test_window_stays_short(encoder):
    search = sp.StreamingViterbi(encoder.pieces)
    rng = random.Random(2)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    ids = []
    for i in range(0, len(text), 7):
        ids += search.push(text[i : i + 7])
    ids += search.finish()
    assert b"".join(encoder.pieces.raw[i] for i in ids).decode() == text
    assert search.peak < 20 * encoder.pieces.longest


def test_tables(spark):
    docs = awkward(spark)
    encoded = sp.encode(docs, PATH)
    decoded = sp.decode(encoded, PATH)
    assert sorted(((r["doc_id"], r["text"]) for r in decoded.collect()), key=repr) == sorted(
        ((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr
    )
    for r in encoded.collect():
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
    assert sp.decode(sp.encode(nothing(spark), PATH), PATH).collect() == []


def test_marker_in_text_becomes_a_space(encoder):
    ids = memoryview(encoder.encode("a▁b")).cast("I")
    assert b"".join(encoder.pieces.raw[i] for i in ids).decode() == " a b"


def test_memo_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(sp, "WORDS", 50)
    monkeypatch.setattr(sp, "PARTS", 60)
    small = sp.Encoder(PATH)
    text = words(random.Random(3), 500, 10_000)
    assert small.encode(text) == encoder.encode(text)
    assert len(small) <= 50 and len(small.parts) <= 60
