"""Awkward input rows shared by the tests of this folder."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, stock: int = 400) -> str:
    return " ".join(f"w{rng.randrange(stock):03d}" for _ in range(n))


def awkward(spark: SparkSession, seed: int = 1) -> DataFrame:
    """Nulls, empty and long texts, copies, edited copies, shared passages, repeated rows, a clashing extra column."""
    rng = random.Random(seed)
    passage = words(rng, 130)
    base = words(rng, 300)
    texts = [None, "", "", "   ", "é" * 30, "a", "a", base, base, base + " tail", "head " + base, words(rng, 4000)]
    texts += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(5)]
    texts += [words(rng, rng.randrange(1, 200)) for _ in range(20)]
    texts += ["ab" * 400, "x" * 900, "Ünïcödé " * 120]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base, None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    return frame.selectExpr("*", "'clash' as component_id", "'clash' as cut", "1 as key", "'clash' as body", "2 as fp")


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)
