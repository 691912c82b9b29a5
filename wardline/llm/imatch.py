"""I-Match fingerprints: terms of a document-frequency band, sorted and hashed for several randomised lexicons.

All of it is DataFrame expressions.
"""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import put_down

#: Runs of ASCII characters other than digits and letters part the terms of a lower-cased text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Hash values of terms are cut to this range to draw lexicons.
RANGE = 1 << 16

#: Lexicons that must have terms to tell something.
FEW = 8


@dataclass(frozen=True)
class Lexicons:
    """Randomised subsets of the vocabulary, ``per_rate`` of them with each share of the terms.

    A term is in one lexicon at most.  Dense lexicons see a document with few terms, sparse ones stay unchanged when some
    terms of a long document change.  ``low`` and ``high`` bound a term's document frequency, as shares of distinct texts;
    the band of inverse document frequency is log(1 / high) to log(1 / low).
    """

    rates: tuple[float, ...] = (1 / 64, 1 / 256, 1 / 1024, 1 / 4096)
    per_rate: int = 32
    low: float = 1 / 2000
    high: float = 1 / 50

    def widths(self) -> list[int]:
        return [int(RANGE * r) for r in self.rates]

    def reach(self) -> int:
        return self.per_rate * sum(self.widths())

    def slot(self, drawn: Column) -> Column:
        """Number of the lexicon of a drawn value, from 0; values at or above ``reach`` are in none."""
        out, below = None, 0
        for k, width in enumerate(self.widths()):
            here = (F.floor((drawn - below) / width) + k * self.per_rate).cast("int")
            below += width * self.per_rate
            out = F.when(drawn < below, here) if out is None else out.when(drawn < below, here)
        return out


def drawn(term_hash: Column) -> Column:
    return F.pmod(term_hash, F.lit(RANGE))


def term_hashes(text: Column, lexicons: Lexicons) -> Column:
    """Hashes of the distinct terms of a text that are in any lexicon.  Whole texts are split; nothing is cut off."""
    terms = F.split(F.lower(text), SEPARATORS)
    hashed = F.filter(F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.xxhash64(t)), lambda h: drawn(h) < lexicons.reach())
    return F.array_distinct(hashed)


def band(texts: DataFrame, lexicons: Lexicons) -> DataFrame:
    """``term``: hashes of the lexicons' terms whose document frequency, over all distinct ``texts`` (``text``), is in the band.

    Copies count once, or the terms of a text that many rows hold would leave the band.  No document frequency below ``low`` passes, so the table has at most (terms of an average document) / ``low`` rows,
    however many documents there are.
    """
    n = texts.select(F.xxhash64("text")).distinct().count()
    distinct = texts.select(F.xxhash64("text").alias("h"), term_hashes(F.col("text"), lexicons).alias("terms")).distinct()
    counts = distinct.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # in a handful of documents every share is above the band: a term of two documents is the rarest that can tell
    at_most = max(n * lexicons.high, 2)
    return counts.where((F.col("df") >= n * lexicons.low) & (F.col("df") <= at_most)).select("term")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``doc_id, text, next, part, k, guest``: each text with the next one by ascending id; after the last comes the first.

    Ids are cut into ranges of equal width, one window each.  The first row of every range is also put at the end of the
    range before, as a ``guest``, so no window looks across and the texts move once.  ``k`` numbers the rows of a range.
    Ids spread very unevenly make uneven ranges, not other results.  Null ids come first; of equal ids the order is that
    of the hashes of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high = (0, 0) if low is None else (low, high)
    buckets = buckets or min(max(n // 500, 1), 1 << 16)
    share = (F.col("doc_id").cast("decimal(20,0)") - F.lit(low)) * buckets / F.lit(high - low + 1).cast("decimal(20,0)")
    rows = rows.withColumn("part", F.coalesce(F.floor(share).cast("int"), F.lit(-1))).withColumn("h", F.xxhash64("text"))
    # one row per range: at most 65,537
    firsts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("one"))
    order = Window.orderBy("part")
    firsts = firsts.select("one", F.coalesce(F.lag("part").over(order), F.lit(1 << 30)).alias("before"))
    top = rows.agg(F.max("part")).first()[0]
    firsts = F.broadcast(
        firsts.select(
            F.col("one.doc_id").alias("f_id"), F.col("one.h").alias("f_h"), F.when(F.col("before") == 1 << 30, F.lit(top)).otherwise(F.col("before")).alias("f_part")
        )
    )
    first = rows["doc_id"].eqNullSafe(F.col("f_id")) & (rows["h"] == F.col("f_h"))
    guests = rows.join(firsts, first).select("doc_id", "text", F.col("f_part").alias("part"), "h", F.lit(True).alias("guest"))
    line = Window.partitionBy("part").orderBy("guest", "doc_id", "h")
    return rows.withColumn("guest", F.lit(False)).unionByName(guests).select(
        "doc_id", "text", F.lead("text").over(line).alias("next"), "part", F.row_number().over(line).alias("k"), "guest"
    )


def _slots(hashes: Column) -> Column:
    """Hash of a lexicon's terms, sorted; null if there are none."""
    return F.when(F.size(hashes) > 0, F.xxhash64(F.array_sort(hashes)))


def likeness(a: Column, b: Column, a_all: Column, b_all: Column, lexicons: Lexicons, least: int = FEW) -> Column:
    """Share of equal lexicons of two maps from lexicon to hash, 0 to 1.

    It is taken at the sparsest rate with at least ``least`` lexicons that have terms in either text, else at the densest
    rate; of lexicons without terms nothing is learnt.  Without any, it is 1 if the hashes of all terms are equal, else 0.
    """
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    out = None
    for k in reversed(range(len(lexicons.rates))):
        here = F.filter(keys, lambda s: F.floor(s / lexicons.per_rate) == k)  # noqa: B023  called at once
        same = F.size(F.filter(here, lambda s: F.coalesce(F.element_at(a, s) == F.element_at(b, s), F.lit(False))))
        enough = F.size(here) >= (least if k else 1)
        value = same / F.size(here)
        out = F.when(enough, value) if out is None else out.when(enough, value)
    return out.otherwise((a_all == b_all).cast("double"))


def _written(slots: Column, every: Column, lexicons: Lexicons) -> Column:
    """A fingerprint as text: hash of all terms, then the lexicons in order, empty where they have no term."""
    n = lexicons.per_rate * len(lexicons.rates)
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.coalesce(F.substring(F.hex(F.element_at(slots, s)), -8, 8), F.lit("")))
    return F.lower(F.concat(F.lpad(F.hex(every), 16, "0"), F.lit(":"), F.array_join(cells, ".")))


def fingerprint_edits(docs: DataFrame, lexicons: Lexicons = Lexicons()) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs``.

    The edited text has the last quarter of the text's code points (rounded down) replaced by as many, or all, from the
    start of the next document's text.  ``near_edited`` and ``near_next`` are the :func:`likeness` of the text's
    fingerprint to the edited text's and to the next document's.  A text with terms of the band in fewer than ``FEW``
    lexicons is known by the lexicons of all its terms; a pair with such a text is compared by those.  The fingerprint of a text depends on the text and on the
    corpus's document frequencies, so equal texts have equal fingerprints.

    Null texts are empty.  The only document is its own next one.  Ids may be null, which come first, and repeat.  No rows
    give no rows.  Other columns are ignored.
    """
    known = put_down(band(docs.select(F.coalesce("text", F.lit("")).alias("text")), lexicons), "band")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut))
    texts = with_next(docs).select("doc_id", "part", "k", "guest", "text", n.cast("long").alias("n_chars"), F.coalesce(edited, F.lit("")).alias("edited"))
    own, other = term_hashes(F.col("text"), lexicons), term_hashes(F.col("edited"), lexicons)
    whole = lambda c: F.xxhash64(F.array_sort(F.array_distinct(F.split(F.lower(F.col(c)), SEPARATORS))))
    base = texts.select(
        "doc_id", "part", "k", "guest", "n_chars", F.sha2("edited", 256).alias("sha"), whole("text").alias("all_a"),
        whole("edited").alias("all_b"), own.alias("a"), other.alias("b"),
    )
    side = lambda terms, s: F.transform(terms, lambda h: F.struct(h.alias("term"), F.lit(s).alias("side")))
    sides = F.concat(side(F.array_intersect("a", "b"), 0), side(F.array_except("a", "b"), 1), side(F.array_except("b", "a"), 2))
    row = ["part", "k", "doc_id", "guest", "n_chars", "sha", "all_a", "all_b"]
    terms = base.select(*row, F.explode_outer(sides).alias("t")).select(*row, "t.term", "t.side")
    terms = terms.join(F.broadcast(known.withColumn("in_band", F.lit(True))), "term", "left")
    slot = lexicons.slot(drawn(F.col("term")))
    # rows of a text lie in one partition, by its range: neither grouping moves them
    by_slot = terms.withColumn("slot", slot).groupBy(*row, "slot").agg(
        *(
            _slots(F.collect_list(F.when((F.col("side") != without) & known_only, F.col("term")))).alias(name)
            for name, without, known_only in (
                ("ha", 2, F.col("in_band")), ("hb", 1, F.col("in_band")), ("wa", 2, F.lit(True)), ("wb", 1, F.lit(True))
            )
        )
    )
    pairs = lambda h: F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull() & F.col(h).isNotNull(), F.struct("slot", h))))
    prints = by_slot.groupBy(*row).agg(
        pairs("ha").alias("fa"), pairs("hb").alias("fb"), pairs("wa").alias("ga"), pairs("wb").alias("gb")
    )
    line = Window.partitionBy("part").orderBy("k")
    following = (F.lead(c).over(line).alias(name) for c, name in (("fa", "fn"), ("ga", "gn"), ("all_a", "all_n")))
    ready = prints.select("*", *following).where(~F.col("guest"))

    def near(side: str) -> Column:
        # with few terms in the band on either side the lexicons of all terms tell
        fa, ga, all_a, f, g, every = (F.col(c) for c in ("fa", "ga", "all_a", f"f{side}", f"g{side}", f"all_{side}"))
        bare = (F.size(fa) < FEW) | (F.size(f) < FEW)
        return likeness(F.when(bare, ga).otherwise(fa), F.when(bare, g).otherwise(f), all_a, every, lexicons)

    def shown(side: str) -> Column:
        f, g = F.col(f"f{side}"), F.col(f"g{side}")
        return _written(F.when(F.size(f) < FEW, g).otherwise(f), F.col(f"all_{side}"), lexicons)

    return ready.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        shown("a").alias("fingerprint"),
        shown("b").alias("edited_fingerprint"),
        near("b").alias("near_edited"),
        near("n").alias("near_next"),
    )
