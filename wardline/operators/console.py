"""Queries behind the analyst console: facets, queues, feeds, timelines, graphs, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floor_div

from ..functions.vocab import DECISIONS, OPEN_STATUSES, RESPONSE_KINDS
from ..plans.islands import bucket_islands
from ..plans.ranking import rank_within
from ..session import settle

# ---------------------------------------------------------------- cases


def filter_cases(
    df: DataFrame,
    severities: Sequence[str] = (),
    dispositions: Sequence[str] = (),
    tenants: Sequence[str] = (),
    tactics: Sequence[str] = (),
    unassigned_only: bool = False,
) -> DataFrame:
    """OR inside a facet, AND across facets; an empty facet does not restrict."""
    out = df
    for column, wanted in (("severity", severities), ("disposition", dispositions), ("tenant_id", tenants)):
        if wanted:
            out = out.filter(F.col(column).isin(list(wanted)))
    if tactics:
        out = out.filter(F.arrays_overlap("tactics", F.array(*[F.lit(t) for t in tactics])))
    if unassigned_only:
        out = out.filter(F.col("assignee").isNull())
    return out


def facet_counts(df: DataFrame) -> DataFrame:
    """(facet, value, cases) over all cases: one pass for the scalar facets, one for the tactics."""
    scalar = df.select("severity", "disposition", "tenant_id", F.when(F.col("assignee").isNull(), "unassigned").otherwise("assigned").alias("assignment"))
    names = ["severity", "disposition", "tenant_id", "assignment"]
    sets = [[F.col(n)] for n in names]
    grouped = scalar.groupingSets(sets, *names).agg(F.count(F.lit(1)).alias("cases"), F.grouping_id(*names).alias("_g"))
    # bit i of the grouping id (from the left) is 0 for the one grouped column
    facet = F.coalesce(*[F.when(F.col("_g") == (0b1111 ^ (0b1000 >> i)), F.lit(n)) for i, n in enumerate(names)])
    picked = grouped.select(facet.alias("facet"), F.coalesce(*names).alias("value"), "cases")
    tactics = df.select(F.explode("tactics").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("cases"))
    return picked.unionByName(tactics.select(F.lit("tactic").alias("facet"), "value", "cases"))


SORTABLE = {"id", "severity", "disposition", "tenant_id", "title", "risk_score", "claim_count", "created_at_ms", "updated_at_ms", "status", "assignee"}


def queue(df: DataFrame, sort: str = "risk_score", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Ranked queue; ties keep id order.  With ``limit`` this is a top-k, not a full sort."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort!r}")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    out = df.orderBy(key, F.col("id"))
    return out if limit is None else out.limit(limit)


DAY_MS = 86_400_000

# tile: (unit, period in days, good direction); a tile's period is cut into 12 trend points
TILES = {
    "open-cases": ("count", 1, "down"),
    "mttd": ("duration_s", 7, "down"),
    "mttr": ("duration_s", 7, "down"),
    "autonomous-close-rate": ("percent", 30, "up"),
    "drift-alerts": ("count", 1, "down"),
}


def _tile_points(cases: DataFrame, drifts: DataFrame) -> DataFrame:
    """(tile, at_ms, measure) points; one case gives up to four."""
    closed = F.col("closed_at_ms").isNotNull()

    def point(tile: str, when: Column, at: Column, measure: Column) -> Column:
        return F.when(when, F.struct(F.lit(tile).alias("tile"), at.cast("bigint").alias("at_ms"), measure.cast("double").alias("measure")))

    points = F.array_compact(
        F.array(
            point("open-cases", F.col("status").isin(OPEN_STATUSES), F.col("created_at_ms"), F.lit(1)),
            point("mttd", F.col("first_event_ms").isNotNull(), F.col("created_at_ms"), (F.col("created_at_ms") - F.col("first_event_ms")) / 1000),
            point("mttr", closed, F.col("closed_at_ms"), (F.col("closed_at_ms") - F.col("created_at_ms")) / 1000),
            point("autonomous-close-rate", closed, F.col("closed_at_ms"), F.when(F.col("closed_by") == "auto", 100).otherwise(0)),
        )
    )
    rows = cases.select(F.inline(points))
    return rows.unionByName(drifts.select(F.lit("drift-alerts").alias("tile"), F.col("swept_at_ms").cast("bigint").alias("at_ms"), F.lit(1.0).alias("measure")))


def stat_tiles(cases: DataFrame, drifts: DataFrame, now_ms: int) -> DataFrame:
    """(tile, unit, value, baseline, delta, trend, improved), trend oldest first.

    Counts and means cover the tile's period and are compared with the period before.  Open cases are a
    level: all open now, compared with those already there a period ago.  Points fold to at most 25
    buckets per tile before anything is put side by side.
    """
    now = F.lit(now_ms).cast("bigint")
    step = F.coalesce(*[F.when(F.col("tile") == t, F.lit(days * DAY_MS // 12)) for t, (_, days, _) in TILES.items()])
    age = F.floor((now - F.col("at_ms")) / step).cast("int")
    level = F.col("tile") == "open-cases"
    points = _tile_points(cases, drifts).filter(F.col("at_ms") <= now).withColumn("b", F.when(level, F.least(age, F.lit(12))).otherwise(age))
    buckets = points.filter("b < 24").groupBy("tile", "b").agg(F.sum("measure").alias("s"), F.count(F.lit(1)).alias("n"))
    by_tile = buckets.groupBy("tile").agg(F.collect_list(F.struct("b", "s", "n")).alias("bs"))

    def over(lo, hi, what: str) -> Column:
        kept = F.filter("bs", lambda x: (x["b"] >= lo) & (x["b"] < hi))
        return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x[what].cast("double"))

    count_tile = F.col("tile") == "drift-alerts"

    def figure(lo, hi) -> Column:
        mean = F.try_divide(over(lo, hi, "s"), over(lo, hi, "n"))
        return F.when(level, over(lo, F.lit(25), "n")).when(count_tile, over(lo, hi, "n")).otherwise(mean)

    trend = F.transform(F.sequence(F.lit(11), F.lit(0)), lambda i: figure(i, i + 1))
    unit = F.coalesce(*[F.when(F.col("tile") == t, F.lit(u)) for t, (u, _, _) in TILES.items()])
    good = F.coalesce(*[F.when(F.col("tile") == t, F.lit(g)) for t, (_, _, g) in TILES.items()])
    names = F.explode(F.array(*[F.lit(t) for t in TILES])).alias("tile")
    every = cases.sparkSession.range(1).select(names).join(by_tile, "tile", "left")  # five rows
    none = F.array().cast(by_tile.schema["bs"].dataType)
    out = every.withColumn("bs", F.coalesce("bs", none)).select(
        "tile",
        unit.alias("unit"),
        figure(F.lit(0), F.lit(12)).alias("value"),
        figure(F.lit(12), F.lit(24)).alias("baseline"),
        trend.alias("trend"),
        good.alias("good_direction"),
    ).withColumn("delta", F.col("value") - F.col("baseline"))
    return out.withColumn("improved", improved(F.col("delta"), F.col("good_direction")))


def improved(delta: Column, good_direction: Column) -> Column:
    """better, worse or flat."""
    up = delta > 0
    right_way = up == (good_direction == "up")
    return F.when(delta.isNull() | (delta == 0), "flat").when(right_way, "better").otherwise("worse")


# ---------------------------------------------------------------- feed


def fold_cases(snapshot: DataFrame, feed: DataFrame) -> DataFrame:
    """Latest version of every case after the feed's ``new`` and ``update`` messages.

    ``feed`` is (seq, kind, case struct); other kinds are ignored.  Folding is a partial aggregation, so
    a case with very many updates does not gather in one task.
    """
    cols = snapshot.columns
    base = snapshot.select(F.col("id"), F.lit(-1).cast("bigint").alias("seq"), F.struct(*cols).alias("case"))
    news = feed.filter(F.col("kind").isin("new", "update")).select(F.col("case.id").alias("id"), F.col("seq").cast("bigint").alias("seq"), F.struct(*[F.col(f"case.{c}").alias(c) for c in cols]).alias("case"))
    return base.unionByName(news).groupBy("id").agg(F.max_by("case", "seq").alias("case")).select("case.*")


def trailing_rate(fires: DataFrame, at: str = "at_ms", window_ms: int = 5000, by: Sequence[str] = ()) -> DataFrame:
    """(by, at, fires_in_window, rate_per_s) at every distinct fire time.

    Counts fires in the last ``window_ms``; one exactly that old is out.  Fires fold to one row per
    millisecond, each row is put into its own bucket and the next, and the range frame then spans at
    most two buckets of distinct milliseconds: there is no global window.
    """
    by = list(by)
    ticks = fires.groupBy(*by, F.col(at).cast("bigint").alias(at)).agg(F.count(F.lit(1)).alias("_n"))
    own = floor_div(F.col(at), window_ms)
    spread = ticks.withColumn("_own", own).withColumn("_b", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    frame = Window.partitionBy(*by, "_b").orderBy(at).rangeBetween(-(window_ms - 1), 0)
    counted = spread.withColumn("fires_in_window", F.sum("_n").over(frame)).filter("_b = _own")
    return counted.select(*by, at, "fires_in_window", (F.col("fires_in_window") / (window_ms / 1000)).alias("rate_per_s"))


def recent(fires: DataFrame, n: int = 40, at: str = "at_ms", tie: str = "id") -> DataFrame:
    return fires.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


# ---------------------------------------------------------------- timeline


def timeline(events: DataFrame, case_id: str | None = None) -> DataFrame:
    """Events of one case (or of all) in time order."""
    out = events if case_id is None else events.filter(F.col("case_id") == case_id)
    return out.orderBy("case_id", "at_ms", "id")


def timeline_bands(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id", "tactic").agg(
        F.count(F.lit(1)).alias("events"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms")
    )


IDLE_GAP_MS = 3_600_000
MIN_SEGMENT_PX = 4
GAP_PX = 24


def compress_idle(events: DataFrame, px_per_ms: float) -> DataFrame:
    """(case_id, segment, start_ms, end_ms, px_start, px_width): active stretches with idle gaps cut to a fixed width."""
    parts = bucket_islands(events, ["case_id"], "at_ms", IDLE_GAP_MS)
    segs = parts.groupBy("case_id", F.col("island").alias("segment")).agg(F.min("first").alias("start_ms"), F.max("last").alias("end_ms"))
    width = F.greatest(F.lit(float(MIN_SEGMENT_PX)), (F.col("end_ms") - F.col("start_ms")) * F.lit(float(px_per_ms)))
    before = Window.partitionBy("case_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("px_width").over(before), F.lit(0.0)) + F.col("segment") * GAP_PX
    return segs.withColumn("px_width", width).withColumn("px_start", start)


def idle_positions(events: DataFrame, px_per_ms: float) -> DataFrame:
    """Pixel position of every event on the compressed axis."""
    segs = compress_idle(events, px_per_ms).select("case_id", "segment", "start_ms", "px_start")
    where = bucket_islands(events, ["case_id"], "at_ms", IDLE_GAP_MS).select("case_id", "bucket", F.col("island").alias("segment"))
    placed = events.withColumn("bucket", floor_div(F.col("at_ms"), IDLE_GAP_MS))
    joined = placed.join(where.join(segs, ["case_id", "segment"]), ["case_id", "bucket"])
    px = F.col("px_start") + (F.col("at_ms") - F.col("start_ms")) * F.lit(float(px_per_ms))
    return joined.select(*events.columns, "segment", px.alias("px"))


# ---------------------------------------------------------------- graph

COLUMN_WIDTH = 160
ROW_HEIGHT = 28


def layout(nodes: DataFrame, columns: int) -> DataFrame:
    """Time-binned layout: column by first-seen, row by id inside the column."""
    ends = nodes.agg(F.min("first_seen_ms").alias("_lo"), F.max("first_seen_ms").alias("_hi"))
    span = F.greatest(F.lit(1), F.col("_hi") - F.col("_lo"))
    column = F.least(F.lit(columns - 1), F.floor((F.col("first_seen_ms") - F.col("_lo")) / span * columns)).cast("int")
    placed = nodes.crossJoin(F.broadcast(ends)).withColumn("column", column).drop("_lo", "_hi")  # one row
    ranked = rank_within(placed, ["column"], ["id"], out="row")
    return ranked.withColumn("x", F.col("column") * COLUMN_WIDTH).withColumn("y", F.col("row") * ROW_HEIGHT)


def neighbours(edges: DataFrame, node: str, limit: int = 60) -> DataFrame:
    """The first claims touching an entity, with direction and the other end."""
    touching = edges.filter((F.col("from_node_id") == node) | (F.col("to_node_id") == node))
    out = F.col("from_node_id") == node
    return touching.select(
        "id",
        "predicate",
        F.when(out, "out").otherwise("in").alias("direction"),
        F.when(out, F.col("to_node_id")).otherwise(F.col("from_node_id")).alias("other"),
    ).orderBy("id").limit(limit)


def graph_evidence(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode("evidence_ids").alias("evidence_id")).distinct().orderBy("evidence_id")


def in_box(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points inside the box, bounds included."""
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


LEAF_POINTS = 32


def _box_distance(near: bool) -> Column:
    """Squared distance from (qx, qy) to the nearest or farthest point of a cell's bounding box."""

    def axis(q: str, lo: str, hi: str) -> Column:
        below, above = F.col(lo) - F.col(q), F.col(q) - F.col(hi)
        if near:
            return F.greatest(F.lit(0.0), below, above)
        return F.greatest(F.abs(F.col(q) - F.col(lo)), F.abs(F.col(hi) - F.col(q)))

    dx, dy = axis("qx", "x_lo", "x_hi"), axis("qy", "y_lo", "y_hi")
    return dx * dx + dy * dy


def nearest_within(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(query_id, id, distance): the closest point at most ``radius`` away; ties go to the smallest id.

    ``points`` is (id, x, y), ``queries`` (query_id, x, y).  Equal coordinates are folded on both sides.
    A query starts with the up to nine occupied cells around it and goes down a grid that halves every
    level, keeping only cells that may still hold the nearest point: those no farther than the surest
    bound found so far.  The grid goes on until no cell holds more than a few distinct points, which halving
    always reaches, so a crowded cell is never paired with all its queries.
    """
    pts = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    pts = pts.groupBy("x", "y").agg(F.min("id").alias("id"))
    asked = queries.select("query_id", F.col("x").cast("double").alias("qx"), F.col("y").cast("double").alias("qy"))

    def cells(level: int) -> DataFrame:
        size = F.lit(radius / (1 << level))
        return pts.groupBy(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(
            F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"), F.count(F.lit(1)).alias("n")
        )

    reach = F.lit(radius * radius)
    per_query = Window.partitionBy("qx", "qy")

    def prune(cand: DataFrame) -> DataFrame:
        bound = F.least(reach, F.min(_box_distance(near=False)).over(per_query))
        return cand.withColumn("_bound", bound).filter(_box_distance(near=True) <= F.col("_bound")).select("qx", "qy", "cx", "cy")

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    start = asked.select("qx", "qy").distinct().withColumn("_o", F.explode(around))
    start = start.select(
        "qx", "qy", (F.floor(F.col("qx") / radius) + F.col("_o.i")).alias("cx"), (F.floor(F.col("qy") / radius) + F.col("_o.j")).alias("cy")
    )
    level, grid = 0, cells(0)
    cand = prune(start.join(grid, ["cx", "cy"]))
    while (grid.agg(F.max("n")).first()[0] or 0) > LEAF_POINTS:
        level += 1
        grid = cells(level)
        child = grid.withColumn("_px", F.shiftright("cx", 1)).withColumn("_py", F.shiftright("cy", 1))
        parent = cand.select("qx", "qy", F.col("cx").alias("_px"), F.col("cy").alias("_py"))
        cand = prune(parent.join(child, ["_px", "_py"]))
        if level % 4 == 0:
            cand = settle(cand)
    size = F.lit(radius / (1 << level))
    keyed = pts.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    found = cand.join(keyed, ["cx", "cy"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= reach)
    best = found.groupBy("qx", "qy").agg(F.min(F.struct("d2", "id")).alias("_b"))
    return asked.join(best, ["qx", "qy"]).select("query_id", F.col("_b.id").alias("id"), F.sqrt("_b.d2").alias("distance"))


# ---------------------------------------------------------------- ledger, drift and response views


def manifest_list(manifests: DataFrame, checked: DataFrame) -> DataFrame:
    """Newest first, with the chain state of each manifest (``checked`` is ``ledger.verify_manifests``)."""
    state = F.when(F.col("hash_ok") & F.col("link_ok"), "intact").otherwise("broken")
    joined = manifests.join(checked, ["tenant_id", "closed_seq"]).withColumn("chain_state", state)
    return joined.orderBy(F.col("completed_at_ns").desc(), "case_id")


def verify_cases(manifests: DataFrame, replayed: DataFrame, proofs: DataFrame) -> DataFrame:
    """Verification panel: evidence proofs and the re-scored verdict of each case, match or mismatch.

    ``replayed`` is ``drift.replay_pin``; ``proofs`` carries ``valid`` and the root each proof leads to.
    """
    roots = manifests.select("case_id", "epoch_root", *[c for c in ("evidence_count",) if c in manifests.columns])
    ok = F.col("valid") & (F.col("root") == F.col("epoch_root"))
    evidence = (
        proofs.join(roots, "case_id")
        .groupBy("case_id")
        .agg(F.count(F.lit(1)).alias("proofs"), F.count_if(ok).alias("proofs_ok"))
    )
    out = roots.join(evidence, "case_id", "left").join(replayed, "case_id", "full_outer")
    for c in ("proofs", "proofs_ok"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    # without proofs nothing is shown, unless the manifest says that there is no evidence; a case not replayed has no match
    told = F.col("proofs") > 0 if "evidence_count" not in manifests.columns else F.col("proofs").eqNullSafe(F.col("evidence_count"))
    fine = F.coalesce("verdict_hash_matches", F.lit(False)) & told & (F.col("proofs") == F.col("proofs_ok"))
    return out.select("case_id", "proofs", "proofs_ok", "verdict_hash_matches", F.when(fine, "match").otherwise("mismatch").alias("result"))


def drift_feed(drifts: DataFrame, at: str = "swept_at_ms") -> DataFrame:
    return drifts.orderBy(F.col(at).desc(), "case_id")


def response_candidates(cases: DataFrame, n: int = 40) -> DataFrame:
    """Proposed actions for the first ``n`` high or critical cases.  The kind follows from the case id."""
    first = cases.filter(F.col("severity").isin("high", "critical")).orderBy("created_at_ms", "id").limit(n)
    pick = F.conv(F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % len(RESPONSE_KINDS)
    kind = F.element_at(F.array(*[F.lit(k) for k in RESPONSE_KINDS]), pick.cast("int") + 1)
    rationale = F.concat(
        F.size("tactics").cast("string"), F.lit(" contributing tactic(s), risk score "), F.col("risk_score").cast("string"), F.lit("/10000 -- see case "), F.col("id"), F.lit(".")
    )
    return first.select(
        F.concat(F.lit("ra-"), "id").alias("id"),
        F.col("id").alias("case_id"),
        kind.alias("kind"),
        F.col("primary_entity").alias("target"),
        F.col("updated_at_ms").alias("proposed_at_ms"),
        rationale.alias("rationale"),
        F.lit("pending").alias("status"),
    )


def apply_decisions(actions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions with the latest valid decision applied, decisions refused with a problem).

    ``decisions`` is (action_id, seq, status).
    """
    valid = decisions.filter(F.col("status").isin(DECISIONS))
    latest = valid.groupBy("action_id").agg(F.max_by("status", "seq").alias("_new"))
    updated = actions.join(latest.withColumnRenamed("action_id", "id"), "id", "left")
    updated = updated.withColumn("status", F.coalesce("_new", "status")).select(*actions.columns)
    known = actions.select(F.col("id").alias("action_id"))
    unknown = valid.join(known, "action_id", "left_anti").select("action_id", "seq", "status", F.lit("unknown_action").alias("problem"))
    invalid = decisions.filter(~F.coalesce(F.col("status").isin(DECISIONS), F.lit(False)))
    return updated, unknown.unionByName(invalid.select("action_id", "seq", "status", F.lit("invalid_status").alias("problem")))


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows for the asked keys; a key the table lacks comes back with ``found`` false."""
    return ids.select(key).distinct().join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
