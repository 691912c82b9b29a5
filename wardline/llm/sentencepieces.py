"""SentencePiece encoding and decoding by a streaming Viterbi search over the pieces of a given model."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"

#: Entries of a worker's memos of words and of their parts, which start anew when full, and the longest word they take.
WORDS, PARTS, MEMO_CHARS = 1 << 19, 1 << 19, 40

RUNS = re.compile(" +[^ ]*")


class Pieces:
    """Pieces of a ``.model`` file with costs, and the ids of its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        # the file holds ranks and no probabilities; by Zipf's law a piece of rank r costs log(1 + r), here in whole
        # millionths, so that sums are exact and a path's cost does not depend on where it was begun
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.cost = {self.text[i]: (round(1e6 * math.log(2 + rank)), i) for rank, i in enumerate(ranked)}
        self.byte_cost = round(1e6 * math.log(2 + n))
        self.longest = max(map(len, self.cost))
        #: Pieces by their characters; the cost of the piece that ends at a node is under the empty string.
        self.trie: dict = {}
        for piece, (cost, _) in self.cost.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = cost
        #: Neighbouring characters within a piece; between others every path has a border.
        self.inside = {p[k : k + 2] for p in self.cost for k in range(len(p) - 1)}
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.cost)
        self.raw = {i: p.replace(SPACE, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for b, i in self.bytes.items()}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class StreamingViterbi:
    """Cheapest pieces of a stream of characters, given out as soon as they are certain.

    Only the last ``longest`` positions can still be extended.  Their states form the window; from time to time the
    paths back from all of them are followed until they meet.  What lies before the meeting point is the same on every
    surviving path and is committed, so the memory held is the distance to that point and not the text.

    Of equally cheap paths the one with the longer last piece wins.  A character without a piece becomes its UTF-8 bytes.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # characters since the last commit
        self.cost = [0]
        self.back = [0]  # length of the last piece on the best path to a position
        self.peak = 0

    def push(self, chars: str) -> list[int]:
        """Ids that the new characters make certain."""
        out: list[int] = []
        for i in range(0, len(chars), self.pieces.longest):
            self._extend(chars[i : i + self.pieces.longest])
            if len(self.text) >= 2 * self.pieces.longest:
                out += self._commit(self._meeting())
        return out

    def _extend(self, chars: str) -> None:
        text, cost, back = self.text + chars, self.cost, self.back
        trie, first, longest, byte_cost = self.pieces.trie, len(self.text), self.pieces.longest, self.pieces.byte_cost
        # forward from every position, along the trie of pieces
        far = math.inf
        cost += [far] * len(chars)
        back += [1] * len(chars)
        for start in range(max(first - longest + 1, 0), len(text)):
            here, node, end = cost[start], trie, start
            for char in text[start : start + longest]:
                if char not in node:
                    break
                node, end = node[char], end + 1
                # only what ends in the new characters is open; of equal costs the longer last piece, begun earlier, stays
                if "" in node and end > first and here + node[""] < cost[end]:
                    cost[end], back[end] = here + node[""], end - start
            if start >= first and (end == start or "" not in trie[text[start]]):  # no piece of one character: its bytes
                step = here + byte_cost * len(text[start].encode())
                if step < cost[start + 1]:
                    cost[start + 1], back[start + 1] = step, 1
        self.text = text
        self.peak = max(self.peak, len(text))

    def finish(self) -> list[int]:
        """The rest, at the end of the stream."""
        return self._commit(len(self.text))

    def _meeting(self) -> int:
        """The latest position that lies on the paths of all states in the window."""
        n = len(self.text)
        ends = set(range(n - self.pieces.longest + 1, n + 1))
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - self.back[last])
        return ends.pop()

    def _commit(self, upto: int) -> list[int]:
        found, at = [], upto
        while at > 0:
            size = self.back[at]
            piece = self.text[at - size : at]
            known = self.pieces.cost.get(piece)
            if known is None:
                found += [self.pieces.bytes[b] for b in reversed(piece.encode())]
            else:
                found.append(known[1])
            at -= size
        self.text, self.back = self.text[upto:], [0, *self.back[upto + 1 :]]
        base = self.cost[upto]
        self.cost = [c - base for c in self.cost[upto:]]
        return found[::-1]


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit values, with a memo of words.

    Where no piece has a space after another character, every path passes the border before a run of spaces: all paths
    meet there, the ids so far are committed, and a word's ids do not depend on what surrounds it.
    """

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.parts: dict[str, bytes] = {}

    def stream(self, marked: str, chunk: int = 1 << 16) -> bytes:
        search = StreamingViterbi(self.pieces)
        parts = [_packed(search.push(marked[i : i + chunk])) for i in range(0, len(marked), chunk)]
        return b"".join(parts) + _packed(search.finish())

    def __missing__(self, word: str) -> bytes:
        marked = SPACE + word.replace(" ", SPACE)
        if len(word) > MEMO_CHARS:
            return self.stream(marked)
        inside, cuts = self.pieces.inside, [0]
        cuts += [i for i in range(1, len(marked)) if marked[i - 1 : i + 1] not in inside]
        ids = b"".join(map(self._part, map(marked.__getitem__, map(slice, cuts, [*cuts[1:], len(marked)]))))
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        """A part of a word that ends where all paths meet; it is one window."""
        ids = self.parts.get(part)
        if ids is None:
            search = StreamingViterbi(self.pieces)
            search._extend(part)
            if len(self.parts) >= PARTS:
                self.parts.clear()
            ids = self.parts[part] = _packed(search.finish())
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of ``text``, with a space before its first character."""
        if not text:
            return b""
        if self.pieces.inner_space:
            return self.stream(SPACE + text.replace(" ", SPACE))
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":  # a run of spaces goes with the word behind it
            return b"".join(self[part[1:]] for part in RUNS.findall(" " + text))
        return b"".join(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of a worker process, whose memo lasts from task to task."""
    return Encoder(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, ids_crc32`` for every row of ``docs``; ``ids`` is an array of piece ids.

    ``model`` is the path of a SentencePiece file.  Whole texts are encoded, with a space before the first character and
    no control pieces.  Null and empty texts have no ids.  ``ids_crc32`` is that of the ids as little-endian unsigned
    32-bit values.  Ids of documents may be null or repeat.  No rows give no rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            found = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            ends = np.cumsum([0] + [len(f) // 4 for f in found])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
            crc = pa.array([zlib.crc32(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, crc], ["doc_id", "ids", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of ``encoded`` with ``ids`` replaced by ``text``, without the space that encoding puts in front.

    Bytes that are not UTF-8 become U+FFFD; U+2581 in a text comes back as a space, as the format has it.  Null ids
    give the empty text, unknown and control ids nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _encoder(model).pieces.raw
        unknown = max(raw, default=-1) + 1
        known = pa.array([raw.get(i, b"") for i in range(unknown + 1)], pa.large_binary())
        for batch in batches:
            ids = batch.column(0).fill_null([])
            which = ids.flatten().fill_null(unknown).to_numpy()
            taken = known.take(pa.array(np.where((which < 0) | (which > unknown), unknown, which)))
            # the taken pieces stand side by side in one buffer
            data, starts = taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64)
            sizes = pc.list_value_length(ids).to_numpy()
            edges = starts[np.concatenate([[0], np.cumsum(sizes)])].tolist()
            whole = memoryview(data) if data is not None else b""
            texts = [bytes(whole[a:b]).removeprefix(b" ").decode(errors="replace") for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], ["text", *batch.schema.names[1:]])

    others = [c for c in encoded.columns if c != "ids"]
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in others)
    return encoded.select("ids", *others).mapInArrow(run, f"text string, {kinds}")
