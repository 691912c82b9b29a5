"""License scans: places of given phrases, and short notices found with a bounded number of edits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose exact places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices looked for with edits, as lower-case words, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}

#: A-Z to a-z; bytes that part words to a space.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def edits_allowed(notice: str, share: float) -> int:
    return int(len(notice) * share)


@lru_cache(maxsize=256)
def seeds(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset, part): ``edits + 1`` parts of a notice, of which at least one survives ``edits`` edits unchanged."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=256)
def _verifier(notice: str, edits: int):
    import regex

    # best match first, whole words only
    return regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice)}){{e<={edits}}}(?= )".encode())


def _find_all(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + 1)


def fuzzy_places(joined: bytes, notice: str, edits: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of places of ``notice`` in words joined by, and between, single spaces.

    Exact seeds locate candidates; around each, the notice is matched with at most ``edits`` edits.  Candidates whose
    surroundings overlap are looked at together, so repeated seeds do not repeat the work.  The best match of such a region
    comes first, and then those on either side of it.
    """
    reach: list[list[int]] = []
    near = []
    for offset, part in seeds(notice, edits):
        near += [(at - offset - edits - 1, at - offset + len(notice) + edits + 1) for at in _find_all(joined, part)]
    for low, high in sorted(near):
        if reach and low <= reach[-1][1]:
            reach[-1][1] = max(high, reach[-1][1])
        else:
            reach.append([max(low, 0), high])
    verify, places = _verifier(notice, edits), []
    rest = [(low, min(high, len(joined))) for low, high in reach]
    while rest:
        low, high = rest.pop()
        if high - low >= len(notice.encode()) - edits and (found := verify.search(joined, low, high)):
            places.append((found.start(), found.end(), sum(found.fuzzy_counts)))
            rest += [(low, found.start()), (found.end(), high)]
    return sorted(places)


def scan_text(data: bytes, phrases: Mapping[str, str], notices: Mapping[str, str], share: float):
    """(words, base places as (word, label), notice places as (first word, last word, edits, label, likeness))."""
    words = data.translate(_TO_WORDS).split()
    if not words:
        return 0, [], []
    joined = b" " + b" ".join(words) + b" "
    found = [(at, label) for phrase, label in phrases.items() for at in _find_all(joined, f" {phrase} ".encode())]
    near = [(place, notice, label) for notice, label in notices.items() for place in fuzzy_places(joined, notice, edits_allowed(notice, share))]
    if not found and not near:
        return len(words), [], []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)  # word n stands behind space n
    base = list(zip(np.searchsorted(spaces, [at for at, _ in found]).tolist(), (label for _, label in found)))
    starts, ends = (np.searchsorted(spaces, [place[side] for place, _, _ in near]).tolist() for side in (0, 1))
    fuzzy = [(a - 1, b - 1, place[2], label, 1 - place[2] / len(notice)) for a, b, (place, notice, label) in zip(starts, ends, near)]
    return len(words), base, fuzzy


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    share: float = 0.08,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every row of ``docs``.

    A-Z are lower-cased; words are runs of digits, letters a-z and non-ASCII characters.  A phrase has a place where its
    words stand in a row; ``first_word`` and ``last_word`` are the smallest and largest starts, null without a place.
    A notice has a place where it stands with edits (insertions, deletions, substitutions of bytes) of at most ``share``
    of its length.  Notices add their labels to those of phrases; ``spans`` lists the notices' places with first and
    last word, edits and label.  Label lists are sorted and joined by commas, empty if there is none.  ``score`` is the
    likeness of the best notice, 1 if there is a place of a phrase, and 0 without either.

    Whole texts are read; null and empty texts have no words.  Rows are judged by text alone.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("label", pa.string())])
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, base, fuzzy = scan_text(text.as_py() or b"", phrases, notices, share)
                starts = [at for at, _ in base]
                own = {label for _, label in base}
                score = 1.0 if base else max((f[4] for f in fuzzy), default=0.0)
                spans = [dict(zip(("first_word", "last_word", "edits", "label"), f)) for f in sorted(fuzzy)]
                labels = ",".join(sorted(own | {f[3] for f in fuzzy}))
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), labels, score, spans))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<first_word: long, last_word: long, edits: long, label: string>>",
    )
