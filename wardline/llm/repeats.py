"""Suffix-array deduplication by bucket refinement: bytes inside a repeated string of a given length are removed.

Suffixes are never written out.  A suffix's *bucket* at depth h is an identifier of its first h bytes.  Initial buckets
are those of short q-grams; the identifier at depth h + g is made from the identifiers at depth h of the suffix itself
and at depth g of the suffix h bytes further on, and results are used again for the next depth.  Rows are then sorted
(grouped) on the identifiers, and a suffix alone in its bucket needs no deeper look.

Three refinements follow one another, on ever fewer suffixes.

1. *Anchors.*  In every run of as many suffixes as a window may start before its middle, the one with the least q-gram
   identifier is an anchor.  Equal windows have equal anchors at equal places.  Every window of ``length`` bytes holds the
   first ``half`` bytes behind its anchor, so an anchor alone in its bucket at depth ``half`` closes its windows as unique.
2. *Spans.*  The windows of an anchor start in one interval.  The string that covers all of them is a deeper bucket; if
   it occurs twice, all those windows are repeats.
3. *Blocks and windows.*  What is left are places where a repeat begins or ends.  There the same is done for blocks of
   ``BLOCK`` windows, at fixed distances from their anchor, and at last for single windows: what all windows of the block
   share must occur twice, and if what covers them does, they are settled.  A settled bucket of the same group sends one
   member along, since what is left may repeat it in part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import put_down, scope, text_or_empty

#: Depth of the initial buckets.
Q = 16

#: Windows in a block.
BLOCK = 16

#: Suffixes looked at together, so that a very long text takes bounded memory.
STRETCH = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


def _pair(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Identifiers of pairs of identifiers."""
    mixed = front * _ODD
    mixed += back
    mixed ^= mixed >> _SHIFT
    return mixed


def word_ids(data: bytes) -> np.ndarray:
    """64-bit identifiers of a text's words: runs of bytes other than space and U+0009 to U+000D."""
    import xxhash

    words = data.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of a text's words, and of the bytes behind their last ones."""
    byte = np.frombuffer(data, np.uint8)
    inside = np.r_[False, (byte != 0x20) & ((byte < 0x09) | (byte > 0x0D)), False]
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


class Buckets:
    """Bucket identifiers of the suffixes of one stretch of bytes or words at depths 1, 2, 4, ..., each made from the one before."""

    def __init__(self, data: bytes | np.ndarray):
        self.n = len(data)
        data = np.frombuffer(data, np.uint8).astype(np.uint64) if isinstance(data, bytes) else data
        byte = (data + np.uint64(1)) * _ODD
        self.levels = [byte ^ (byte >> _SHIFT)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            ids, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_pair(ids[:-step], ids[step:]) if len(ids) > step else ids[:0])
        return self.levels[k]

    def at(self, starts: np.ndarray, depth: int) -> np.ndarray:
        """Identifiers at any one depth, from the levels of its binary digits."""
        out, done = np.zeros(len(starts), np.uint64), 0
        for k in reversed(range(depth.bit_length())):
            if depth >> k & 1:
                out = _pair(out, self.level(k)[starts + done])
                done += 1 << k
        return out

    def cover(self, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Identifiers of strings of different sizes, from ``least`` to under twice that, from overlapping parts."""
        k = least.bit_length() - 1
        ids = self.level(k)
        out = _pair(sizes.astype(np.uint64), ids[starts])
        for part in range(1, 4):  # a power of two over half of ``least``: four parts reach over all
            out = _pair(out, ids[starts + (sizes - (1 << k)) * part // 3])
        return out


def least_in_reach(ids: np.ndarray, reach: int) -> np.ndarray:
    """For each start p, the place of the least identifier among p ... p + reach - 1, the first of equals."""
    n = len(ids) - reach + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bits = np.uint64(max(int(len(ids) - 1).bit_length(), 1))
    low, have = (ids >> bits << bits) | np.arange(len(ids), dtype=np.uint64), 1
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(data: bytes | np.ndarray, length: int):
    """Rows (anchor, first window, last window, id at depth ``half``, id of the covering span) of a text.

    ``half`` is ``length // 2``; the windows that start in [first, last] have their least q-gram at the anchor.
    """
    half = length // 2
    reach = length - half + 1
    n_windows = len(data) - length + 1
    if n_windows <= 0:
        return None
    parts = []
    for lo in range(0, n_windows, STRETCH):
        hi = min(lo + STRETCH, n_windows)
        piece = data[lo : hi + length - 1]
        buckets = Buckets(piece)
        at = least_in_reach(buckets.level(Q.bit_length() - 1)[: hi - lo + reach - 1], reach)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        anchor = at[first]
        head = buckets.at(anchor, half)
        span = buckets.cover(first, last - first + length, length)
        parts.append((anchor + lo, first + lo, last + lo, head, span))
    return [np.concatenate(x) for x in zip(*parts)]


def blocks(data: bytes | np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, length: int):
    """Rows (source row, first, last, id of what all windows share, id of the cover) of the blocks of the given intervals.

    A block holds the windows that start ``size * i`` to ``size * i + size - 1`` bytes before the anchor.
    """
    low, high = (anchor - last) // size, (anchor - first) // size
    source = np.repeat(np.arange(len(anchor)), high - low + 1)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
    top = anchor[source] - (low[source] + nth) * size  # last start of a whole block
    begin, end = np.maximum(first[source], top - size + 1), np.minimum(last[source], top)
    shared, cover = np.empty(len(source), np.uint64), np.empty(len(source), np.uint64)
    stretch = begin // STRETCH
    for s in np.unique(stretch):
        rows = np.flatnonzero(stretch == s)
        lo = int(begin[rows].min())
        ids = Buckets(data[lo : int(top[rows].max()) + length])
        shared[rows] = ids.at(top[rows] - lo, length - size + 1)
        cover[rows] = ids.cover(begin[rows] - lo, end[rows] - begin[rows] + length, length)
    if size == 1:  # an independent second half of the identifier
        import xxhash

        digests = (xxhash.xxh3_64_intdigest(data[b : b + length]) for b in begin.tolist())
        cover = np.fromiter(digests, np.uint64, len(begin))
    return source, begin, end, shared, cover


_FIELDS = ["key", "anchor", "first", "last", "head", "span", "open"]
_MARKED = "key long, anchor long, first long, last long, head long, span long, open boolean"


def _marked(key, anchor, first, last, head, span, open_) -> pa.RecordBatch:
    columns = [key, anchor, first, last, head.view(np.int64), span.view(np.int64)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(open_, pa.bool_())], _FIELDS)


def _anchor_rows(rows: DataFrame, length: int, words: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                found = anchors(word_ids(text.as_py()) if words else text.as_py(), length)
                if found:
                    keys.append(np.full(len(found[0]), key.as_py(), np.int64))
                    parts.append(found)
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                yield _marked(np.concatenate(keys), *columns, np.ones(len(columns[0]), bool))

    return rows.mapInArrow(run, _MARKED)


def _block_rows(asked: DataFrame, size: int, length: int, words: bool = False) -> DataFrame:
    """``asked`` has ``key, text`` and a list of (anchor, first, last, open); one row for each block of ``size`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, wanted in zip(*(batch.column(i) for i in range(3))):
                wanted = wanted.values
                anchor, first, last = (wanted.field(i).to_numpy() for i in range(3))
                open_ = wanted.field(3).to_numpy(zero_copy_only=False)
                data = word_ids(text.as_py()) if words else text.as_py()
                source, begin, end, shared, cover = blocks(data, anchor, first, last, size, length)
                yield _marked(np.full(len(source), key.as_py()), anchor[source], begin, end, shared, cover, open_[source])

    return asked.mapInArrow(run, _MARKED)


def _sorted_out(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled intervals, intervals to refine) of rows with a shared part ``head`` and a cover ``span``.

    A cover that occurs twice settles all its windows.  A shared part that occurs once leaves nothing to look for.  Of
    the other groups, the rows with a cover of their own go on, and with them one member of each settled cover.
    Counts are folded before the shuffle; the rows return by joins that AQE splits.
    """
    place = F.struct("key", "anchor", "first", "last")
    n = F.count(F.lit(1)).alias("n")
    spans = marked.groupBy("head", "span").agg(n, F.min(place).alias("one"), F.max("open").alias("open"))
    spans = put_down(spans.withColumn("open", F.col("open") & (F.col("n") == 1)), "spans")
    heads = spans.groupBy("head").agg(F.sum("n").alias("all"), F.max("open").alias("some_open"))
    heads = heads.where((F.col("all") > 1) & F.col("some_open")).select("head")
    twice = spans.where(F.col("n") > 1).select(F.col("head").alias("h"), F.col("span").alias("s"))
    settled = marked.where("open").join(twice, (F.col("head") == F.col("h")) & (F.col("span") == F.col("s")))
    further = spans.join(heads, "head", "left_semi").select("one.*", "open")
    return settled.select("key", "first", "last"), further


def repeated_windows(rows: DataFrame, length: int, words: bool = False) -> DataFrame:
    """``key, first, last``: intervals of starts of repeated windows, for ``rows`` of ``key`` (long) and ``text`` (binary).

    Windows have ``length`` bytes or, if asked for, words; so have the starts.
    """
    found, further = _settle(_anchor_rows(rows, length, words), "anchors")
    for size in (BLOCK, 1):
        asked = rows.join(further, F.col("key") == F.col("k")).select("key", "text", "wanted")
        settled, further = _settle(_block_rows(asked, size, length, words), "blocks")
        found = found.union(settled)
    return found


def _settle(marked: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """:func:`_sorted_out`, what goes on as a list for each text; only the two results stay on disk.

    Most shared parts occur once: their rows are left out before anything else is grouped.
    """
    with scope():
        with scope():
            marked = put_down(marked, name)
            # written first: a join of two plain shuffles is one whose crowded keys AQE splits
            heads = put_down(marked.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"), "heads")
            marked = put_down(marked.join(heads, "head", "left_semi").select(*_FIELDS), "shared", kept=True)
        settled, further = _sorted_out(marked)
        wanted = further.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("anchor", "first", "last", "open")).alias("wanted"))
        return put_down(settled, "settled", kept=True), put_down(wanted, "further", kept=True)


def _union(ranges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes in any of the given ranges, each from its begin to before its end."""
    begin, end = (np.concatenate(x) for x in zip(*ranges))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return begin[new], end[np.r_[new[1:] - 1, len(end) - 1]]


def _cut(data: bytes, intervals: list | None, length: int, words: int | None = None):
    """(kept bytes, number removed, number of runs)."""
    if not intervals:
        return data, 0, 0
    ranges = []
    for by_word in (False, True):
        wanted = [(i["first"], i["last"]) for i in intervals if i["by_word"] == by_word]
        if wanted:
            first, last = np.array(wanted, np.int64).T
            if by_word:
                starts, ends = word_edges(data)
                ranges.append((starts[first], ends[last + words - 1]))
            else:
                ranges.append((first, last + length))
    begin, end = _union(ranges)
    edges = zip([0, *end.tolist()], [*begin.tolist(), len(data)])
    return b"".join(data[a:b] for a, b in edges), int((end - begin).sum()), len(begin)


def _interval_lists(ids_and_texts: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """``cut_key, cut``: the intervals of each text that has repeats, for a table of an id and a text.

    A list is bounded by the length of its text.
    """
    doc_id, text = ids_and_texts.columns
    with scope():
        return put_down(_listed(ids_and_texts, doc_id, text, length, words), "intervals", kept=True)


def _listed(ids_and_texts: DataFrame, doc_id: str, text: str, length: int, words: int | None) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    rows = ids_and_texts.select(F.xxhash64(doc_id, text).alias("key"), body)
    found = repeated_windows(rows, length).withColumn("by_word", F.lit(False))
    if words:
        found = found.union(repeated_windows(rows, words, words=True).withColumn("by_word", F.lit(True)))
    return found.groupBy(F.col("key").alias("cut_key")).agg(F.collect_set(F.struct("by_word", "first", "last")).alias("cut"))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text`` for every row of ``docs``.

    A byte of a text's UTF-8 form is removed if a string of ``length`` bytes that covers it also starts anywhere else in
    any text, the same one included.  Strings never cross texts and are judged on the input.

    Null and empty texts, and texts shorter than ``length``, lose nothing.  A row that repeats both id and text is one
    more place for every string in it.  ``text`` is what is left, without characters of which only some bytes are left.  Ids may be null; a row is known by a 64-bit hash of id and text.  Identifiers of
    strings have 128 bits together and are not followed by a comparison of bytes.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cut in zip(batch.column(1), batch.column(2)):
                data = text.as_py()
                kept, removed, runs = _cut(data, cut.as_py(), length)
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            n, removed, runs, sha, left = map(list, zip(*out)) if out else ([],) * 5
            numbers = [pa.array(x, pa.int64()) for x in (n, removed, runs)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(sha, pa.string()), pa.array(left, pa.string())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    marked = rows.join(_interval_lists(rows, length), F.xxhash64("doc_id", "text") == F.col("cut_key"), "left")
    return marked.select("doc_id", text_or_empty().cast("binary").alias("text"), "cut").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )


def cut_repeats(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with repeated bytes taken out of ``text`` and, if there is such a column, the
    new number of characters in ``n_chars``.

    With ``words``, every run of as many words that also starts anywhere else is taken out as well, however few bytes it
    has: from its first word's first byte to its last word's last.  Equal words may be parted by different white space.

    A character of which only some bytes are repeated goes as a whole.  Nulls stay null; a text may become empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(0), batch.column(1)):
                if not cut.is_valid or not text.is_valid:
                    texts.append(text.as_py())
                else:
                    texts.append(_cut(text.as_py().encode(), cut.as_py(), length, words)[0].decode(errors="ignore"))
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *rest], batch.schema.names[:1] + batch.schema.names[2:])

    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {name: f"c{i}" for i, name in enumerate(names)}
    lists = _interval_lists(plain.select(at["doc_id"], at["text"]), length, words)
    others = [c for c in plain.columns if c != at["text"]]
    marked = plain.join(lists, F.xxhash64(at["doc_id"], at["text"]) == F.col("cut_key"), "left").select(at["text"], "cut", *others)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.select(at["text"], *others).schema)
    cut = marked.mapInArrow(run, schema).select(*plain.columns).toDF(*names)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cut
