"""Near copies by shingle similarity: texts are linked if the Jaccard similarity of their word shingles reaches a limit.

SimHash fingerprints of the sets are linked through the pivot tables of ``simhash`` first.  64 bits cannot tell 0.8 from
0.7: at 0.8 about ten bits differ.  So further candidates come from wider signatures, and every link of either kind is
verified on the sets of shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import put_down, scope, text_or_empty
from wardline.llm.components import connected_components
from wardline.llm.simhash import SEED, links, majority, signed, splitmix

#: Keys of a set, and minimums in a key.  Sets of similarity 0.8 share no key with a probability of 3e-6.
BANDS, ROWS = 32, 5

#: Bits in which SimHash fingerprints may differ to be looked at as a pair.
DISTANCE = 4

#: Rounds of comparison with one reference a set, before pairs are listed.
ROUNDS = 2

_XORS, _ODDS = (np.array(splitmix(BANDS * ROWS, seed), np.uint64)[:, None] for seed in (SEED, SEED + 1))
_ODDS |= np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; words and short texts as in ``simhash.fingerprint``.

    A text without a word has the one shingle zero.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    hashed = xxhash.xxh64_intdigest
    shingles = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter((hashed(s, SEED) for s in shingles), np.uint64, len(shingles)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set: hashes of ``ROWS`` minimums each, every one under its own order of the shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[None, i : i + 2048] ^ _XORS) * _ODDS).min(axis=1), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODDS[0]
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _ODDS[1]
        keys ^= keys >> np.uint64(29)
    return keys


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_hash, v, fp, n, keys`` for every row; ``v`` is a hash of the shingle set, ``fp`` its SimHash, ``n`` its size."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
                values = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                keys = pa.array([band_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                prints = pa.array([signed(majority(s)) for s in sets], pa.int64())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [batch.column(0), batch.column(1), pa.array(values, pa.int64()), prints, sizes, keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "v", "fp", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, v long, fp long, n long, keys array<long>")


def _shingled(texts: DataFrame, shingle: int) -> DataFrame:
    """``v, n, weight, shingles`` for ``texts`` of ``v, n, weight`` and a binary ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(3)]
                columns = [*batch.columns[:3], pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["v", "n", "weight", "shingles"])

    return texts.select("v", "n", "weight", "text").mapInArrow(run, "v long, n long, weight long, shingles array<long>")


def close_prints(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: pairs of the sets of ``distinct`` (``v, fp``) that :func:`simhash.links` links, one for each link.

    Sets of one fingerprint are paired with the smallest of them, which stands for the fingerprint in all other links.
    """
    ones = put_down(distinct.groupBy("fp").agg(F.min("v").alias("one")), "near-prints")
    found = put_down(links(ones.select("fp"), distance), "near-close")
    low, high = (ones.select(F.col("fp").alias(f"{x}_fp"), F.col("one").alias(x)) for x in ("a", "b"))
    apart = found.select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).join(low, "a_fp").join(high, "b_fp").select("a", "b")
    same = distinct.select("v", "fp").join(ones, "fp").where("v <> one").select(F.col("one").alias("a"), F.col("v").alias("b"))
    return put_down(apart.union(same), "near-close")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (``a, b``) whose sets' similarity is at least ``percent`` / 100, in whole numbers."""
    a, b = (sets.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in ("a", "b"))
    close = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    both = F.size(F.array_intersect("s_a", "s_b"))
    enough = both * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    return pairs.join(a, "a").join(b, "b").where(close).where(enough).select("a", "b")


def _need(n_a: Column, n_b: Column, percent: int) -> Column:
    """How many common shingles sets of these sizes have at ``percent`` / 100 at least."""
    return F.ceil((n_a + n_b) * percent / (100 + percent))


def similar_links(keyed: DataFrame, sets: DataFrame, percent: int = 80, close: DataFrame | None = None) -> DataFrame:
    """``a, b``: links between distinct sets that connect all pairs of similar ones that share a key or stand in ``close``.

    ``keyed`` has ``v, key`` for the keys of more than one set, ``close`` has pairs ``a, b`` of any origin, ``sets`` has
    ``v, n, weight, shingles`` for the sets of both; a set weighs as much as its keys have members.

    *Close pairs.*  Those of them that are similar make the first labels.

    *References.*  For a few rounds every set is compared with one set of another label that shares a key with it: the
    heaviest, that is the most central, of its neighbours first, then the heaviest of a random label.  So a cloud of near
    copies falls into few labels without listing its pairs.

    *Prefixes.*  What is left are sets that share a key across labels.  Two of them can only have such shingles in common
    that occur under more than one label, and then share one of their rarest, so many that too few others are left.
    Pairs that share such a one are verified.  The sizes that occur with a shingle bound how many it takes, so texts with
    too much of their own, and the passages or templates that many texts contain, make no pairs.  No join on the way has
    more rows than there are such pairs, one for each shingle that brings them together.
    """
    labels = sets.select("v", "weight", F.col("v").alias("label"))
    edges = None
    if close is not None:
        edges = put_down(_alike(close, sets, percent), "near-links")
        labels = _labelled(sets, edges)
    for nth in range(ROUNDS):
        of_label = labels.groupBy("label").agg(F.max(F.struct("weight", "v")).alias("best"))
        told = keyed.join(labels.select("v", "label"), "v")
        order = F.col("best.weight") if nth == 0 else F.xxhash64("label", F.lit(nth))
        choice = F.struct(order.alias("order"), F.col("best.v").alias("v"), "label")
        seen = told.select("key", "label").distinct().join(of_label, "label")
        references = seen.groupBy("key").agg(F.max(choice).alias("reference"))
        tried = told.join(references, "key").where(F.col("reference.label") != F.col("label"))
        pairs = tried.groupBy(F.col("v").alias("b")).agg(F.max("reference").alias("reference")).select(F.col("reference.v").alias("a"), "b")
        found = put_down(_alike(pairs, sets, percent), "near-links")
        edges = found if edges is None else put_down(edges.union(found), "near-links")
        labels = _labelled(sets, edges)
    return edges.union(_alike(_prefix_pairs(keyed.join(labels, "v"), sets, percent), sets, percent)).distinct()


def _labelled(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, weight, label``: sets with the root of their component in ``edges``."""
    roots = connected_components(edges).withColumnRenamed("v", "of")
    labels = sets.select("v", "weight").join(roots, F.col("v") == F.col("of"), "left")
    return put_down(labels.select("v", "weight", F.coalesce("root", "v").alias("label")), "near-labels")


def _prefix_pairs(told: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs across labels that share one of their rarest shingles, for ``told`` of ``v, key, label``."""
    torn = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_ = put_down(told.join(torn.select("key"), "key").select("v", "label").distinct(), "near-open")
    terms = sets.join(open_, "v").select("v", "label", "n", F.explode("shingles").alias("term"))
    # copies of a term under one label count once: only other labels matter
    common = terms.groupBy("term", "label").agg(F.min("n").alias("least")).groupBy("term")
    common = common.agg(F.count(F.lit(1)).alias("df"), F.min("least").alias("least")).where("df > 1")
    line, own = Window.partitionBy("v").orderBy("df", "term"), Window.partitionBy("v")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(line)  # shingles of one label alone come first
    ranked = terms.join(common, "term").select("v", "label", "n", "term", "least", place.alias("place"))
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    posts = ranked.where(F.col("place") <= F.col("n") - _need(F.col("n"), partner, percent) + 1)
    posts = put_down(posts.select("term", "label", "v", "n", "place"), "near-posts")
    # sizes of labels meet by their first places: only where sets can be near do the sets themselves meet
    first = posts.groupBy("term", "label", "n").agg(F.min("place").alias("place"))
    low, high = (first.select("term", F.col("label").alias(end), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"first_{x}")) for end, x in (("low", "a"), ("high", "b")))
    need = _need(F.col("n_a"), F.col("n_b"), percent)
    meet = low.join(high, "term").where("low < high").where((F.col("first_a") <= F.col("n_a") - need + 1) & (F.col("first_b") <= F.col("n_b") - need + 1))
    a, b = (posts.select("term", F.col("label").alias(end), *(F.col(c).alias(f"{c}_{x}") for c in ("v", "n", "place"))) for end, x in (("low", "a"), ("high", "b")))
    near = (F.col("place_a") <= F.col("n_a") - need + 1) & (F.col("place_b") <= F.col("n_b") - need + 1)
    met = meet.join(a, ["term", "low", "n_a"]).join(b, ["term", "high", "n_b"])
    return met.where(near).select(F.col("v_a").alias("a"), F.col("v_b").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of linked texts the row with the smallest id; all columns as they are.

    Texts are linked if the Jaccard similarity of their sets of word shingles is at least ``percent`` / 100; links are
    followed.  Texts without a word are alike.  A decision holds for an id and a text together: rows with a null id stay,
    and so do rows that repeat the smallest id within the group.

    Sets are kept as keys at first; only those that share a key, or are close by fingerprint, are written out.
    """
    with scope():
        own = put_down(signatures(docs, shingle), "near-signatures")
        # copies of a set are alike in all columns but their text
        distinct = own.select("v", "n", "keys", "text_hash").dropDuplicates(["v"])
        close = close_prints(own.select("v", "fp").distinct())
        every = distinct.select("v", F.explode("keys").alias("key"))
        shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        keyed = put_down(every.join(shared, "key"), "near-keys")
        ends = close.select(F.explode(F.array("a", "b")).alias("v"), F.lit(1).cast("long").alias("members"))
        weights = keyed.select("v", "members").union(ends).groupBy("v").agg(F.sum("members").alias("weight"))
        wanted = put_down(weights.join(distinct.select("v", "n", "text_hash"), "v"), "near-wanted")
        texts = docs.select(F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().cast("binary").alias("text"))
        texts = texts.join(wanted, F.col("hash") == F.col("text_hash")).dropDuplicates(["v"])
        sets = put_down(_shingled(texts, shingle), "near-sets")
        roots = connected_components(similar_links(keyed.select("v", "key"), sets, percent, close)).withColumnRenamed("v", "of")
        placed = own.select("doc_id", "text_hash", "v").join(roots, F.col("v") == F.col("of"), "left")
        placed = placed.select("doc_id", "text_hash", F.coalesce("root", "v").alias("root"))
        least = placed.groupBy("root").agg(F.min("doc_id").alias("least"))
        gone = placed.join(least, "root").where(F.col("least") < F.col("doc_id"))
        gone = put_down(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct(), "near-gone", kept=True)
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(text_or_empty()) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")
