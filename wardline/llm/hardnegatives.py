"""Hard-negative mining: score windows around each positive, searched in an STR-packed R-tree.

The tree has three levels.  *Trees* hold one label (small labels share one), *nodes* are the cells of a tree cut along two
coordinates, and *leaves* are cut inside a node's task.  The bounding box of a set of vectors bounds its inner products
with an anchor from both sides, coordinate by coordinate.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import put_down, scope
from wardline.llm.vectors import floored, matrix, whole_vectors
from wardline.session import small

#: Rows of a node and of a leaf as aimed at.  A node may hold twice as many before it is split by a hash.
NODE, LEAF = 8192, 256

#: Anchors that visit one copy of a node, anchors of a block and nodes of a chunk in the search of the directory.
VISITS, BLOCK, CHUNK = 4096, 1024, 4096

#: Cuts of a coordinate that are measured for a tree or slab.
GRID = 256

LEAST, MOST = -(1 << 63), (1 << 63) - 1


# Building the tree


def folded(rows: DataFrame, most: int) -> DataFrame:
    """``vec_id, label, x`` without repeats, and of rows with equal ``label`` and ``x`` only the ``most`` smallest ids.

    Equal vectors of a label have equal scores, and ties go to the smaller id, so no other one can be among the first.
    """
    once = rows.select("vec_id", "label", "x").distinct()
    nth = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def _slab(value: Column, cuts: Column, slabs: Column) -> Column:
    """Which of ``slabs`` equal shares of the cuts a value falls into."""
    return F.floor(F.size(F.filter(cuts, lambda c: c < value)) * slabs / GRID).cast("int")


def pack(rows: DataFrame, node_rows: int) -> DataFrame:
    """``rows`` with their ``node``: sort-tile-recursive cells of about ``node_rows`` rows.

    A label with ``node_rows`` rows has a tree of its own, smaller ones share trees.  A tree is cut into slabs along its
    coordinate of largest variance and each slab along the next one, at measured quantiles.  Where many rows fall on one
    cut, a cell is split by a hash of the id, so no cell grows with a crowd.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    labels = put_down(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "packed-labels")
    scattered = labels.where(F.col("n") < node_rows).agg(F.sum("n")).first()[0] or 0
    shared = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-scattered // node_rows))))
    tree = F.when(F.col("n") >= node_rows, F.xxhash64("label", F.lit("own"))).otherwise(shared)
    rows = rows.join(small(labels.select("label", tree.alias("tree"))), "label")

    spread = vector_to_array(Summarizer.metrics("variance").summary(array_to_vector(F.col("x").cast("array<double>")))["variance"])
    ranked = F.array_sort(F.transform(F.col("spread"), lambda v, i: F.struct((-v).alias("less"), i.alias("i"))))
    parts = F.ceil(F.col("n") / node_rows)
    first = F.ceil(F.sqrt(parts)).cast("int")
    trees = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), spread.alias("spread")).select(
        "tree", first.alias("slabs"), F.ceil(parts / first).cast("int").alias("cells"),
        F.get(ranked, F.lit(0))["i"].alias("major"), F.coalesce(F.get(ranked, F.lit(1))["i"], F.lit(0)).alias("minor"),
    )
    trees = put_down(trees, "packed-trees")

    def cuts(value: str) -> Column:
        return F.percentile_approx(value, [i / GRID for i in range(1, GRID)], 10 * GRID).alias("cuts")

    rows = rows.join(small(trees), "tree").withColumn("u", F.get("x", "major")).withColumn("v", F.get("x", "minor"))
    outer = put_down(rows.groupBy("tree").agg(cuts("u")), "packed-cuts")
    rows = rows.join(small(outer), "tree").withColumn("slab", _slab(F.col("u"), F.col("cuts"), F.col("slabs"))).drop("cuts")
    inner = put_down(rows.groupBy("tree", "slab").agg(cuts("v")), "packed-cuts")
    rows = rows.join(small(inner), ["tree", "slab"]).withColumn("cell", _slab(F.col("v"), F.col("cuts"), F.col("cells")))
    cells = rows.groupBy("tree", "slab", "cell").agg(F.count(F.lit(1)).alias("members"))
    rows = rows.join(small(put_down(cells, "packed-cells")), ["tree", "slab", "cell"])
    piece = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("members") / (2 * node_rows)))
    return rows.select("vec_id", "label", "x", F.xxhash64("tree", "slab", "cell", piece).alias("node"))


def directory(packed: DataFrame) -> DataFrame:
    """``node, label_low, label_high, low, high``: the bounding box of every node; tasks send partial boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(1).to_numpy(), matrix(batch.column(2))])
            nodes, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(nodes)))
            low, high = (f.reduceat(x[order], starts, axis=0) for f in (np.minimum, np.maximum))
            i = np.tile(np.arange(x.shape[1]), len(nodes))
            columns = [np.repeat(nodes, x.shape[1]), i, low.ravel(), high.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "i", "low", "high"])

    parts = packed.select("node", F.col("label").cast("long"), "x").mapInArrow(run, "node long, i long, low long, high long")
    sides = parts.groupBy("node", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    box = F.array_sort(F.collect_list(F.struct("i", "low", "high")))
    boxes = sides.groupBy("node").agg(box.alias("box"))
    low, high = F.col("box.low"), F.col("box.high")
    size = F.size("box") - 1
    return boxes.select(
        "node", F.get(low, F.lit(0)).alias("label_low"), F.get(high, F.lit(0)).alias("label_high"),
        F.slice(low, 2, size).alias("low"), F.slice(high, 2, size).alias("high"),
    )


# Bounds and the queue of a task


def _numbers(*tables: np.ndarray) -> list[np.ndarray]:
    """Whole-number matrices in a type in which their inner products are exact: doubles, or 64-bit integers."""
    sides = [int(np.abs(t).max()) if t.size else 0 for t in tables]
    bound = max(sides) * min(sides) * tables[0].shape[1]
    if bound >= 1 << 62:
        raise OverflowError("inner products do not fit 64 bits")
    return [t.astype(np.float64 if bound < 1 << 52 else np.int64) for t in tables]


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``q`` with any vector of each box, summed over coordinates."""
    q, low, high = _numbers(q, low, high)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def open_boxes(least, most, low, high, label, label_low, label_high, same: bool) -> np.ndarray:
    """Which boxes may hold a row for an anchor: of the right label, and meeting one of its windows ``low`` to ``high``."""
    right = (label_low <= label) & (label <= label_high) if same else (label_low != label) | (label_high != label)
    meets = (most[:, None] >= low[None, :]) & (least[:, None] <= high[None, :])
    return right & meets.any(axis=1)


def str_leaves(x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of sort-tile-recursive leaves: by label, then along the coordinates of largest variance."""
    keys = [labels, *(x[:, i] for i in np.argsort(-x.var(axis=0), kind="stable")[:3])]

    def tile(rows: np.ndarray, level: int) -> list[np.ndarray]:
        if len(rows) <= leaf or level == len(keys):
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        rows = rows[np.argsort(keys[level][rows], kind="stable")]
        if level == 0:
            return [t for part in np.split(rows, np.flatnonzero(np.diff(labels[rows])) + 1) for t in tile(part, 1)]
        slabs = int(np.ceil((len(rows) / leaf) ** (1 / (len(keys) - level))))
        return [t for part in np.array_split(rows, slabs) for t in tile(part, level + 1)]

    return tile(np.arange(len(x)), 0)


def best_first(q, own, label, low, high, same: bool, k: int, leaves, x, ids, labels, least, most, boxes):
    """``window, id, score`` of the first ``k`` rows of every window: the leaf of largest possible score comes first.

    ``low`` rises to the k-th score found.  A leaf that meets no window any more, or whose scores are all strictly below
    the k-th of each, is left out; once the queue's head is below every window, so is the rest.
    """
    low, best = low.copy(), [(np.empty(0, np.int64), np.empty(0, x.dtype)) for _ in low]
    queue = [(-most[t], t) for t in boxes]
    heapq.heapify(queue)
    while queue:
        top, t = heapq.heappop(queue)
        if -top < low.min():
            break
        if not ((most[t] >= low) & (least[t] <= high)).any():
            continue
        rows = leaves[t]
        fits = (labels[rows] == label) & (ids[rows] != own) if same else labels[rows] != label
        rows = rows[fits]
        scores = x[rows] @ q
        for w in range(len(low)):
            inside = (scores >= low[w]) & (scores <= high[w])
            if inside.any():
                kept, had = np.concatenate([best[w][0], ids[rows[inside]]]), np.concatenate([best[w][1], scores[inside]])
                order = np.lexsort((kept, -had))[:k]
                best[w] = kept[order], had[order]
                if len(order) == k:
                    low[w] = max(low[w], int(had[order[-1]]))
    return [(w, int(i), int(s)) for w, (kept, had) in enumerate(best) for i, s in zip(kept, had)]


# The search over all nodes


def _each(n: Column) -> Column:
    """A row for each whole number from 0 below ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _bounded(anchors: DataFrame, nodes: DataFrame, same: bool, first: bool) -> DataFrame:
    """``anchor, node, most``: the nodes that each anchor has to visit, or the one that comes ``first``.

    Blocks of anchors meet chunks of the directory, so a task holds a few thousand boxes and sends no box onwards.
    """
    blocks, chunks = -(-max(1, anchors.count()) // BLOCK), -(-max(1, nodes.count()) // CHUNK)
    every = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).withColumn(
        "chunk", _each(F.lit(chunks))
    )
    boxes = nodes.withColumn("chunk", F.pmod("node", F.lit(chunks))).withColumn("block", _each(F.lit(blocks)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"anchor": [], "node": [], "most": []}
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            node, label_low, label_high = (right[c].to_numpy() for c in ("node", "label_low", "label_high"))
            least, most = intervals(*(matrix(t[c].combine_chunks()) for t, c in ((left, "x"), (right, "low"), (right, "high"))))
            rows = zip(*(left[c].to_pylist() for c in ("anchor", "label", "low", "high", "seen")))
            for i, (anchor, label, low, high, seen) in enumerate(rows):
                low, high = np.array(low, np.int64), np.array(high, np.int64)
                found = np.flatnonzero(open_boxes(least[i], most[i], low, high, label, label_low, label_high, same) & (node != seen))
                if first and len(found):
                    found = found[[np.lexsort((node[found], -most[i][found]))[0]]]
                out["anchor"] += [anchor] * len(found)
                out["node"] += node[found].tolist()
                out["most"] += [int(v) for v in most[i][found]]
        return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    n = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = (t.repartition(n, "block", "chunk").groupBy("block", "chunk") for t in (every, boxes))
    return next(sides).cogroup(next(sides)).applyInArrow(run, "anchor long, node long, most long")


def _visited(visits: DataFrame, anchors: DataFrame, packed: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor, window, id, score``: the first ``k`` rows of every window within each visited node.

    A node with many visitors is copied, so that a task has a bounded number of rows and of anchors.
    """
    copies = put_down(visits.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / VISITS).alias("copies")), "node-copies")
    of = F.pmod(F.xxhash64("anchor"), F.col("copies")).alias("copy")
    asked = visits.join(small(copies), "node").select("anchor", "node", of).join(anchors, "anchor")
    held = packed.join(small(copies), "node").withColumn("copy", _each(F.col("copies")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
            q, x = _numbers(*(matrix(t["x"].combine_chunks()) for t in (left, right)))
            leaves = str_leaves(x, labels)
            low, high = (np.array([f(x[t], axis=0) for t in leaves]) for f in (np.min, np.max))
            label_low, label_high = (np.array([f(labels[t]) for t in leaves]) for f in (np.min, np.max))
            least, most = intervals(q, low, high)
            rows = zip(*(left[c].to_pylist() for c in ("anchor", "own", "label", "low", "high")))
            for i, (anchor, own, label, lows, highs) in enumerate(rows):
                lows, highs = np.array(lows, np.int64), np.array(highs, np.int64)
                boxes = np.flatnonzero(open_boxes(least[i], most[i], lows, highs, label, label_low, label_high, same))
                found = best_first(q[i], own, label, lows, highs, same, k, leaves, x, ids, labels, least[i], most[i], boxes)
                out += [(anchor, *row) for row in found]
        columns = zip(*out) if out else [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor", "window", "id", "score"])

    n = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, held = (t.repartition(n, "node", "copy").groupBy("node", "copy") for t in (asked, held))
    return asked.cogroup(held).applyInArrow(run, "anchor long, window long, id long, score long")


def search(anchors: DataFrame, packed: DataFrame, nodes: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor, window, id, score, rank``: for every window the first ``k`` rows of the same or of another label.

    ``anchors`` has ``anchor, own, label, x`` and the windows ``low``, ``high``.  Every anchor visits the node with the
    largest possible score first; its k-th scores there raise ``low``, and it then visits the nodes that still matter.
    """
    nothing = F.lit(None).cast("long")
    anchors = anchors.withColumn("seen", nothing)
    home = _bounded(anchors, nodes, same, first=True).groupBy("anchor").agg(F.max_by("node", F.struct("most", "node")).alias("node"))
    home = put_down(home, "home-nodes")
    near = put_down(_visited(home, anchors, packed, same, k), "home-rows")
    kth = near.groupBy("anchor", "window").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    raised = kth.groupBy(F.col("anchor").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))
    rest = anchors.drop("seen").join(home.withColumnRenamed("node", "seen"), "anchor").join(raised, F.col("anchor") == F.col("of"), "left")
    low = F.transform("low", lambda l, w: F.greatest(l, F.try_element_at("kth", w.cast("long"))))
    rest = put_down(rest.withColumn("low", F.coalesce(low, "low")).drop("of", "kth"), "open-anchors")
    visits = put_down(_bounded(rest, nodes, same, first=False).select("anchor", "node"), "node-visits")
    far = _visited(visits, rest, packed, same, k)
    nth = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return near.union(far).withColumn("rank", nth).where(F.col("rank") <= k)


def mine(
    table: DataFrame,
    is_anchor: Column,
    label: str | Column = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    node_rows: int = NODE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of hard negatives.

    Components become ``floor(scale * c)``; a score is the inner product of these whole numbers, exact or an error beyond
    64 bits.  Higher scores come first, ties by smaller ``vec_id``.  An anchor's positives are its first ``positives``
    other rows of its label; for each of them the first ``negatives`` rows of other labels follow whose score is within
    ``window`` per cent of the positive's, both ends included (none where that score is negative).

    Rows with a null id, null label or a vector that ``vectors.whole_vectors`` leaves out take no part.  Repeated rows are
    one row.  Rows are known by their id: no row with the anchor's own id is its positive; different rows under one id
    are ranked one by one, and each is an anchor where ``is_anchor`` holds.  No rows give no rows.  Other columns are
    ignored.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = whole_vectors(table, vector).select("vec_id", label.cast("long").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("is_anchor"))
    rows = rows.where("vec_id is not null and label is not null").withColumn("x", floored("vector", scale))
    with scope():
        key = F.monotonically_increasing_id().alias("anchor")
        anchors = rows.where("is_anchor").select("vec_id", "label", "x").distinct().select(key, F.col("vec_id").alias("own"), "label", "x")
        anchors = put_down(anchors, "anchors")
        distinct = put_down(folded(rows.select("vec_id", "label", "x"), max(positives + 1, negatives)), "mined-rows")
        packed = put_down(pack(distinct, node_rows), "packed-rows")
        nodes = put_down(directory(packed), "nodes")

        every = anchors.withColumn("low", F.array(F.lit(LEAST))).withColumn("high", F.array(F.lit(MOST)))
        close = put_down(search(every, packed, nodes, True, positives), "positives")
        low, high = (F.lit(w).cast("decimal(20,0)") * F.col("score") / 100 for w in window)
        ranges = close.where("score >= 0").select(
            "anchor", F.struct("rank", "id", "score", F.ceil(low).cast("long").alias("low"), F.floor(high).cast("long").alias("high")).alias("p")
        )
        ranges = put_down(ranges.groupBy("anchor").agg(F.array_sort(F.collect_list("p")).alias("p")), "windows", kept=True)
        asking = put_down(anchors.join(ranges.select("anchor", F.col("p.low").alias("low"), F.col("p.high").alias("high")), "anchor"), "asking")
        found = put_down(search(asking, packed, nodes, False, negatives), "negatives", kept=True)
        own = put_down(anchors.select("anchor", "own"), "anchor-ids", kept=True)
    of = F.get("p", F.col("window").cast("int"))
    return found.join(ranges, "anchor").join(own, "anchor").select(
        F.col("own").alias("anchor_id"), of["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), of["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
