"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance through pivot tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import put_down, text_or_empty
from wardline.llm.components import connected_components
from wardline.session import small

SEED = 42

#: Reference fingerprints of the pivot table: SplitMix64 outputs, so no two sizes of input see other pivots.
PIVOTS = 16

#: Blocks with more fingerprints than this are linked through shared neighbours and not pair by pair.
PAIR_BLOCK = 128


def splitmix(n: int, seed: int = SEED) -> list[int]:
    """``n`` pseudo-random 64-bit values."""
    out, mask = [], (1 << 64) - 1
    for i in range(1, n + 1):
        z = (seed + i * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of a text's word shingles, all repeats counted."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.array([hashed(joined[s:e], SEED) for s, e in spans], dtype="<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the fingerprint as a signed long.

    A-Z are lower-cased; words are runs of bytes other than space and U+0009 to U+000D.  A text of fewer words than a
    shingle is one shingle; a null text, or one without a word, has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [signed(fingerprint(t.as_py() or b"", shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def _blocks(n_blocks: int) -> list[int]:
    """Masks that share the 64 bits out as evenly as possible."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _block_count(n: int, distance: int) -> int:
    """Enough blocks that few unrelated fingerprints of ``n`` share a block key.  Any count finds every link."""
    for blocks in range(distance + 2, 4 * distance):
        if 64 * (blocks - distance) / blocks >= np.log2(max(n, 2)) + 8:
            return blocks
    return 4 * distance


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, distance: int = 4, pair_block: int = PAIR_BLOCK) -> DataFrame:
    """``a, b``: links between the distinct long values ``fp`` that connect all pairs within ``distance`` bits.

    *Candidates.*  The 64 bits are cut into blocks; two values within the distance agree on all but ``distance`` blocks,
    so they share the key of at least one choice of the remaining ones.  The two values of a key of two are its smallest
    and largest, and need no join.

    *References.*  The smallest and largest value of a larger group are its own references: a member within the distance
    of one is linked to it.  The components of these links are labels.  Pairs are looked at only between labels, each
    under the first choice that it shares, so a cloud of near copies does not list all its pairs.

    *Pivots.*  Every value carries its distances to fixed reference fingerprints.  By the triangle inequality a pair
    whose distances to any reference differ by more than ``distance`` cannot be linked: it is discarded by its largest
    coordinate difference, and only survivors are verified by their own distance.

    *Crowded keys.*  Where more than ``pair_block`` values share a key, members list every value within half the distance.
    Two values meet in such a neighbour exactly if they are within the distance, and at most C(64,0..d/2) values meet in
    one, so this grows with the group and not with its square.
    """
    if distance % 2:
        raise ValueError("an even distance is needed")
    masks = _blocks(_block_count(fps.count(), distance))
    choices = list(combinations(range(len(masks)), len(masks) - distance))
    wanted = [sum(masks[i] for i in choice) for choice in choices]
    keys = F.array(*(F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(wanted)))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key")
    groups = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    groups = put_down(groups.where("n > 1"), "simhash-keys")
    members = put_down(keyed.join(small(groups.where("n > 2")), ["choice", "key"]), "simhash-members")

    def pivoted(table: DataFrame, *values: str) -> DataFrame:
        pivots = [F.lit(signed(p)) for p in splitmix(PIVOTS)]
        return table.select("*", *(_apart(F.col(v), p).cast("byte").alias(f"{v}_{i}") for v in values for i, p in enumerate(pivots)))

    def within(x: str, y: str) -> Column:
        far = F.greatest(*(F.abs(F.col(f"{x}_{i}") - F.col(f"{y}_{i}")) for i in range(PIVOTS)))
        return (far <= distance) & (_apart(F.col(x), F.col(y)) <= distance)

    twos = pivoted(groups.where("n = 2"), "low", "high").where(within("low", "high")).select(F.col("low").alias("a"), F.col("high").alias("b"))

    reference = F.least(*(F.when(within("fp", end), F.col(end)) for end in ("low", "high")), F.col("fp"))
    told = pivoted(members, "fp", "low", "high").groupBy("fp").agg(F.min(reference).alias("label"), (F.max("n") > pair_block).alias("crowded"))
    told = put_down(told, "simhash-labels")
    labels = _relabelled(told, told.where("label <> fp").select(F.col("label").alias("a"), F.col("fp").alias("b")))

    shared = pivoted(members.where(F.col("n") <= pair_block).join(labels.select("fp", "label"), "fp"), "fp")
    x, y = (shared.select(*(F.col(c).alias(side + c.removeprefix("fp") if c.startswith("fp") else f"{side}_{c}") for c in shared.columns)) for side in ("x", "y"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(wanted)))
    same = (F.col("x_choice") == F.col("y_choice")) & (F.col("x_key") == F.col("y_key")) & (F.col("x") < F.col("y"))
    pairs = x.join(y, same & (F.col("x_label") != F.col("y_label")) & within("x", "y") & (first == F.col("x_choice")))
    pairs = pairs.select(F.col("x_label").alias("a"), F.col("y_label").alias("b"))

    own = labels.where("label <> fp").select(F.col("label").alias("a"), F.col("fp").alias("b"))
    return twos.union(own).union(pairs).union(_crowd_links(labels.where("crowded"), distance)).distinct()


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (``fp, label`` and more) with each label replaced by the root of its component in ``edges``."""
    roots = connected_components(edges)
    moved = labels.join(roots, F.col("label") == F.col("v"), "left").withColumn("label", F.coalesce("root", "label"))
    return put_down(moved.drop("v", "root"), "simhash-labels")


def _crowd_links(labels: DataFrame, distance: int) -> DataFrame:
    """``a, b``: a link from the smallest value of its component to each other value of ``labels`` (``fp, label``).

    Values that meet in a neighbour take its smallest label.  Only one new link for each label is followed, then labels
    become those of the components found and the rest is looked at again, so that links never outnumber values.
    """
    flips = [sum(1 << bit for bit in bits) for n in range(distance // 2 + 1) for bits in combinations(range(64), n)]
    flipped = F.array(*(F.lit(signed(f)) for f in flips))
    while True:
        near = labels.select("label", F.explode(F.transform(flipped, lambda f: f.bitwiseXOR(F.col("fp")))).alias("neighbour"))
        met = near.select("label", F.min("label").over(Window.partitionBy("neighbour")).alias("least"))
        steps = met.where("least < label").groupBy("label").agg(F.min("least").alias("least"))
        steps = put_down(steps, "simhash-steps")
        if steps.isEmpty():
            return labels.where("label <> fp").select(F.col("label").alias("a"), F.col("fp").alias("b"))
        labels = _relabelled(labels, steps.select(F.col("label").alias("a"), F.col("least").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints that differ in at most ``distance`` bits are linked; ``component_id`` is the smallest id in the
    connected component, the row's own id included.  ``fingerprint`` is written as 16 hex digits.

    Rows are folded to distinct fingerprints before linking, so copies cost nothing and cannot form pairs.  Null and
    empty texts have fingerprint zero and are linked like any other.  Null ids are passed over for ``component_id``,
    which is null only if a component has no other id.  Repeated rows share a component.  Other columns are ignored.
    """
    own = put_down(fingerprints(docs, shingle), "simhash")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(put_down(distinct.select("fp"), "simhash-distinct"), distance))
    placed = distinct.join(roots, F.col("fp") == F.col("v"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(ids, "root").select(F.col("fp").alias("c_fp"), "component_id")
    return own.join(of, F.col("fp") == F.col("c_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, that with the smallest id; all columns as they are.

    Rows with a null id stay, and so do rows that repeat the smallest id.  A decision holds for an id and a fingerprint
    together, so another text under the same id is not touched by it.
    """
    found = near_duplicates(docs, shingle, distance).where(F.col("component_id") < F.col("doc_id"))
    worse = found.select(F.col("doc_id").alias("gone_id"), F.col("fingerprint").alias("gone_fp")).distinct()
    row = F.struct("doc_id", F.xxhash64(text_or_empty()).alias("text_hash")).alias("doc_id")
    judged = fingerprints(docs.select(row, "text"), shingle)
    same = (F.col("doc_id.doc_id") == F.col("gone_id")) & (F.lower(F.lpad(F.hex("fp"), 16, "0")) == F.col("gone_fp"))
    gone = judged.join(worse, same).select("gone_id", F.col("doc_id.text_hash").alias("gone_text")).distinct()
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_text"])
    return docs.join(gone, same, "left_anti")
