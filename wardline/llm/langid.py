"""Language identification by compression: the language whose dictionary shortens a text most wins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


UNDETERMINED = "und"

#: Texts are compressed in blocks of this many bytes, so that the dictionary counts all along a long text.
BLOCK_BYTES = 8192

#: Log-odds for each unit of relative size difference in the score.
EVIDENCE = 100.0


@dataclass(frozen=True)
class LanguageModel:
    """A raw-content dictionary for each language, in order of falling share of the labelled rows."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 3


def fit(labelled: DataFrame, per_language: int = 256, piece_chars: int = 512, level: int = 3) -> LanguageModel:
    """Dictionaries from ``labelled`` (``doc_id, text, lang``), with ``lang`` not null.

    The fit is on a bounded sample: of each language the ``per_language`` texts that come first by the hash of id and
    text, and of each one piece of at most ``piece_chars`` characters at a place that the hash picks.  The driver
    holds ``per_language * piece_chars`` characters for each language.  The ranking cuts every split to the sample's
    size before the shuffle.  How often each language occurs is counted over all rows.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", F.xxhash64("doc_id", "text").alias("h"), "text"
    )
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1).cast("int") + 1
    pieces = rows.select("lang", "h", F.substring("text", start, F.lit(piece_chars)).alias("piece"))
    first = Window.partitionBy("lang").orderBy("h", "piece")
    sample = pieces.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).orderBy("lang", "k")
    texts: dict[str, list[str]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], []).append(r["piece"].lower())
    order = sorted(texts, key=lambda lang: (-shares[lang], lang))
    return LanguageModel(tuple((lang, "\n".join(texts[lang]).encode()) for lang in order), level)


def _judge(model: LanguageModel):
    """A function from a text to (language or None, score, margin)."""
    import zstandard

    compressors = []
    for lang, content in model.dictionaries:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=model.level)
        compressors.append((lang, zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False)))

    def judge(text: str | None):
        if not compressors or not text or not any(map(str.isalpha, text)):
            return None, 0.0, 0.0
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)  # of equal sizes, the more frequent language
        others = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(others) - sizes[best]) / sizes[best] if others else 1.0
        score = 1 / (1 + sum(math.exp(-min(50.0, EVIDENCE * (s - sizes[best]) / sizes[best])) for s in others))
        return compressors[best][0], score, margin

    return judge


def identify(docs: DataFrame, model: LanguageModel, min_margin: float = 0.004) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for every row of ``docs``.

    Whole texts, lower-cased, are compressed with the dictionary of each language; the smallest total wins, of equal
    totals the language with more labelled rows.  ``margin`` is the second smallest total over the smallest, less one.
    A row is rejected if its margin is under ``min_margin`` or its language is ``und``.

    ``und`` with score 0 is given to null and empty texts, texts without a letter, and all texts if the model knows no
    language; with one language, every text with a letter gets it.  Ids may be null or repeat: each row is judged
    by its text alone.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model)
        for batch in batches:
            judged = [judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([UNDETERMINED if x[0] is None else x[0] for x in judged], pa.string()),
                    pa.array([x[1] for x in judged], pa.float64()),
                    pa.array([x[2] for x in judged], pa.float64()),
                    pa.array([x[0] is None or x[2] < min_margin for x in judged], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean"
    )


def held_out(doc_id: Column) -> Column:
    """True for the third of ids kept out of the fit."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def keep_identified(docs: DataFrame, model: LanguageModel, min_margin: float = 0.004) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns as they are.

    The judgement depends on the text alone, so rows are filtered where they lie, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(model)
        for batch in batches:
            judged = (judge(t.as_py()) for t in batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([lang is not None and margin >= min_margin for lang, _, margin in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
