"""Packing documents into token sequences: best fit, then a swap-based local search that empties bins."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import put_down

#: Code points that have not had their general category for long; texts with one go to the tokenizer whole.
LATE = re.compile("[^\x00-\u024f]")

#: A space next to other white space, and rarer white space and separators anywhere: such texts are not split at spaces.
CROWDED = [pair for c in " \t\n\v\f\r" for pair in (" " + c, c + " ")] + list("\x1c\x1d\x1e\x1f\x85\xa0")

#: Entries of a worker's memo of word ids, which starts anew when full, and the longest word that it takes.
MEMO, MEMO_CHARS = 1 << 20, 40


def _byte_of_char() -> dict[str, int]:
    """The bytes behind the printable characters in which a byte-level vocabulary is written."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder(dict):
    """Ids of a byte-level BPE tokenizer as little-endian unsigned 32-bit values.

    The ids are those of the ``tokenizers`` file at ``path``.  Its ranks also run in the faster ``tiktoken``, which does
    the same merges.  The pre-tokenizer always cuts before a single space between two visible characters, so most texts
    are split there and the ids of each word are remembered.  Texts with late code points, or with a special token's
    string, are encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = _byte_of_char()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _fast(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._fast(" " + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or not text.isascii() and LATE.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            return np.array(found.ids, "<u4").tobytes()
        if text[:1] == " " or text[-1:] == " " or any(c in text for c in CROWDED):
            return self._fast(text)
        first, *words = text.split(" ")
        return self._fast(first) + b"".join(map(self.__getitem__, words))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``place, doc_id, piece, start, length, ids_crc32``: the pieces to pack, without their ids.

    A document is its ids and then ``end_id``; a null text is the empty text.  A document longer than ``capacity`` is
    cut into full pieces, before which a shorter first piece takes what is over.  ``place`` tells the rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((place, i, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
                    place += 1
            place_, at, piece, start, length, crc = map(list, zip(*rows)) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place_, pa.int64()),
                    batch.column(0).take(pa.array(at, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["place", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"place long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that has room.

    A bit mask of the amounts of free room in use finds that bin in one step.
    """
    bin_of = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        bin_of[i] = b
        left = room - need
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bin_of


def swap_search(lengths: np.ndarray, bin_of: np.ndarray, capacity: int, steps: int = 4000) -> np.ndarray:
    """Empty bins by moves that increase the sum of squared fills; returns the new bin of each item.

    The least filled bin that is not given up gives its items away: a move to the fullest bin with room, an item
    against a smaller one, or two items against a smaller one, always the exchange that leaves the other bin fullest.
    Each makes a fuller bin fuller and the source emptier, so squared fill grows.  A bin from which nothing more can
    go is given up.  The search ends at the lower bound, when all underfull bins are given up, or after ``steps`` moves:
    that bounds the work of a group whose lower bound cannot be reached, and leaves every item placed.

    Only sizes decide about an exchange, so one item stands for all of its size and one pair for all of its sum: a bin has
    at most the square root of twice its capacity different sizes, and all of them are tried.
    """
    bin_of = bin_of.copy()
    n = int(bin_of.max(initial=-1)) + 1
    fill = np.bincount(bin_of, weights=lengths, minlength=n).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    given_up = fill >= capacity
    while steps > 0 and np.count_nonzero(fill) > least:
        open_bins = np.flatnonzero(~given_up & (fill > 0))
        if len(open_bins) < 2:
            break
        source = int(open_bins[np.argmin(fill[open_bins])])
        gave = False
        own = np.flatnonzero(bin_of == source)
        own = own[np.argsort(-lengths[own], kind="stable")]
        free = capacity - fill[bin_of]  # room of the bin of each item
        other = (bin_of != source) & (free > 0)
        items = np.flatnonzero(other)
        singles = {int(lengths[i]): (int(i),) for i in own}
        some = [i for k, i in enumerate(own.tolist()) if k < 2 or lengths[own[k - 2]] != lengths[i]]  # up to two of a size
        doubles = {int(lengths[i] + lengths[j]): (i, j) for k, i in enumerate(some) for j in some[k + 1 :]}
        offers = [*singles.items(), *sorted(doubles.items(), reverse=True)]
        room = capacity - fill
        room[source] = 0
        for size, given in offers:
            able = np.flatnonzero(room >= size)
            able = able[fill[able] >= fill[source] - size]
            if len(able):
                target = int(able[np.argmin(room[able])])
                bin_of[list(given)] = target
                moved = size
            else:
                reach = lengths[items] + free[items] - size  # room left after the exchange
                fit = np.flatnonzero((reach >= 0) & (lengths[items] < size) & (fill[bin_of[items]] + size - lengths[items] > fill[source]))
                if not len(fit):
                    continue
                back = int(items[fit[np.lexsort((lengths[items[fit]], reach[fit]))[0]]])
                target = int(bin_of[back])
                bin_of[list(given)] = target
                bin_of[back] = source
                moved = size - int(lengths[back])
            fill[source] -= moved
            fill[target] += moved
            gave = True
            steps -= 1
            break
        given_up[source] = not gave
    return np.unique(bin_of, return_inverse=True)[1]


def pack(pieces: DataFrame, capacity: int = 2048, group_size: int = 20_000) -> DataFrame:
    """Places pieces of 1 to ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Pieces are dealt by hash into groups of about ``group_size``, each packed in a task of its own.  A group ends with
    about one partly filled bin more than needed, that is one in thousands; its size does not grow with the input.
    """
    stored = put_down(pieces, "pieces")
    groups = -(-max(stored.count(), 1) // group_size)

    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bin_of = swap_search(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bin_of, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(bin_of[order], bin_of[order])
        offsets = np.empty(len(lengths), np.int64)
        offsets[order] = before - before[first]
        ids = (table["dealt"].to_numpy() << 32) + bin_of
        return table.drop_columns(["dealt"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    dealt = stored.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("place"), F.lit(groups)).alias("dealt")
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("dealt").applyInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Whole documents of ``docs`` packed into sequences of at most ``capacity`` tokens, one row per piece.

    Only documents longer than a sequence are cut.  Null and empty texts are a single ``end_id``.  Ids may be null or
    repeat; each row is packed for itself.  No rows give no rows.  Other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
