import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wardline.operators import analytics as N
from wardline.operators import console as C
from wardline.operators import identity as I
from wardline.plans import ranking as R
from wardline.sources import feed as FEED
from wardline.streaming import folds


def test_positions_lags_and_medians_in_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 40}", rng.randrange(200), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((v, i))
    want_rank, want_prev = {}, {}
    for g, xs in groups.items():
        for pos, (v, i) in enumerate(sorted(xs)):
            want_rank[i], want_prev[i] = pos, (sorted(xs)[pos - 1][1] if pos else None)
    assert {r.id: r.rank0 for r in R.rank_within(df, ["g"], ["v", "id"]).collect()} == want_rank
    got = R.lag_within(df, ["g"], ["v", "id"]).select("id", F.col("previous.id").alias("p")).collect()
    assert {r.id: r.p for r in got} == want_prev
    med = {r.g: r.median for r in R.exact_median(df, ["g"], "v").collect()}
    assert med == {g: statistics.median(v for v, _ in xs) for g, xs in groups.items()}


def test_trailing_rate_counts_an_open_five_second_window(spark):
    times = [0, 1, 1, 4999, 5000, 5001, 10_000, 123_456]
    out = C.trailing_rate(spark.createDataFrame([(t,) for t in times], "at_ms bigint")).collect()
    assert {r.at_ms: r.fires_in_window for r in out} == {t: sum(t - 5000 < x <= t for x in times) for t in set(times)}


def test_idle_gap_of_exactly_one_hour_does_not_split(spark):
    h = 3_600_000
    times = [0, h, 2 * h, 3 * h + 1, 3 * h + 2]
    ev = spark.createDataFrame([("c", t, i) for i, t in enumerate(times)], "case_id string, at_ms bigint, id int")
    segs = C.compress_idle(ev, 0.001).orderBy("segment").collect()
    assert [(s.start_ms, s.end_ms, s.px_width, s.px_start) for s in segs] == [(0, 2 * h, 7200.0, 0.0), (3 * h + 1, 3 * h + 2, 4.0, 7224.0)]
    assert {r.id: r.px for r in C.idle_positions(ev, 0.001).collect()}[4] == pytest.approx(7224.001)


@pytest.mark.parametrize("radius", [0.05, 0.6])
def test_nearest_with_a_crowded_cell(spark, radius):
    rng = random.Random(2)
    pts = [(i, rng.random() * 0.01, rng.random() * 0.01) for i in range(1500)] + [(2000 + i, rng.random() * 3, rng.random() * 3) for i in range(300)]
    pts += [(9000 + i, 0.5, 0.5) for i in range(50)]
    qs = [(i, rng.random() * 0.02, rng.random() * 0.02) for i in range(150)] + [(500 + i, rng.random() * 3, rng.random() * 3) for i in range(60)] + [(999, 0.5, 0.5)]
    want = {}
    for q, x, y in qs:
        d, i = min(((px - x) ** 2 + (py - y) ** 2, i) for i, px, py in pts)
        if d <= radius * radius:
            want[q] = (i, pytest.approx(math.sqrt(d)))
    out = C.nearest_within(spark.createDataFrame(pts, "id int, x double, y double"), spark.createDataFrame(qs, "query_id int, x double, y double"), radius)
    assert {r.query_id: (r.id, r.distance) for r in out.collect()} == want


def test_layout_uses_all_columns_and_ranks_by_id(spark):
    nodes = spark.createDataFrame([(f"n{i:02d}", i * 10) for i in range(25)], "id string, first_seen_ms bigint")
    got = {r.id: (r.column, r.row) for r in C.layout(nodes, 5).collect()}
    cols = {f"n{i:02d}": min(4, int(i * 10 / 240 * 5)) for i in range(25)}
    assert got == {n: (c, sum(m < n and cols[m] == c for m in cols)) for n, c in cols.items()}
    assert C.layout(nodes.limit(1), 5).first().column == 0


def test_filters_and_decisions(spark):
    df = spark.createDataFrame([("a", "high", "benign", "t", ["x"], None), ("b", "low", "benign", "t", ["y"], "me")], "id string, severity string, disposition string, tenant_id string, tactics array<string>, assignee string")
    assert [r.id for r in C.filter_cases(df, ["high", "low"], tactics=["x", "z"]).collect()] == ["a"]
    assert C.filter_cases(df, ["high"], tactics=["y"]).count() == 0 and C.filter_cases(df).count() == 2
    actions = spark.createDataFrame([("r1", "pending"), ("r2", "pending")], "id string, status string")
    said = spark.createDataFrame([("r1", 1, "approved"), ("r1", 2, "rejected"), ("r1", 3, "whatever"), ("zz", 1, "approved"), ("r2", 1, None)], "action_id string, seq int, status string")
    updated, refused = C.apply_decisions(actions, said)
    assert {r.id: r.status for r in updated.collect()} == {"r1": "rejected", "r2": "pending"}
    assert {(r.action_id, r.seq, r.problem) for r in refused.collect()} == {("r1", 3, "invalid_status"), ("zz", 1, "unknown_action"), ("r2", 1, "invalid_status")}


def test_both_within_matches_all_pairs(spark):
    rng = random.Random(8)
    rows = [(f"h{rng.randrange(4)}", rng.choice("ABC"), rng.randrange(4000)) for _ in range(300)]
    out = N.both_within(spark.createDataFrame(rows, "h string, k string, time bigint"), "h", "k", "A", "B", 7)
    want = {(h, max(t, u) // 7) for h, k, t in rows for g, m, u in rows if h == g and k == "A" and m == "B" and abs(t - u) <= 7}
    assert {(r.h, r.bucket) for r in out.collect()} == want


def test_entropy(spark):
    df = spark.createDataFrame([("aaaa",), ("ab",), ("abcd",), ("",)], "s string")
    assert [r[0] for r in df.select(N.entropy_bits(F.col("s"))).collect()] == pytest.approx([0.0, 1.0, 2.0, 0.0])


CASE = {"tenant_id": "t", "title": "", "primary_entity": "", "severity": "low", "disposition": "benign", "tactics": [], "created_at_ms": 1, "updated_at_ms": 1, "status": "open", "assignee": None}


def test_feed_folds_over_several_micro_batches_and_a_restart(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()

    def deliver(name, msgs):
        lines = [json.dumps({"seq": s, "kind": k, "case": {"id": c, "risk_score": r, **CASE}}) for s, k, c, r in msgs]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    def run():
        feed = FEED.read_case_feed(spark, str(tmp_path / "in"), max_files=1)
        folds.fold_feed(feed, initial.columns, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        return {r.id: r.risk_score for r in folds.current_cases(spark, str(tmp_path / "out"), initial).collect()}

    initial = spark.createDataFrame([("a", 1)], "id string, risk_score int")
    deliver("1.json", [(1, "update", "a", 5), (2, "new", "b", 7), (3, "fire", "z", 9)])
    deliver("2.json", [(4, "update", "a", 6)])
    assert run() == {"a": 6, "b": 7}
    deliver("3.json", [(6, "update", "b", 1), (5, "update", "b", 2)])
    assert run() == {"a": 6, "b": 1}


def test_streamed_dedup_keeps_one_copy(spark, tmp_path):
    rows = [(f"e{i % 7}", i) for i in range(70)]
    spark.createDataFrame(rows, "evidence_id string, s bigint").withColumn("at", F.timestamp_seconds("s")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("evidence_id string, s bigint, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = I.dedup_evidence_stream(stream, "at", "1 hour").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select evidence_id from deduped").count() == 7


def test_streamed_rate_closes_windows(spark, tmp_path):
    spark.range(60).selectExpr("id * 1000 as at_ms").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at_ms bigint").parquet(str(tmp_path / "in"))
    q = folds.rate_per_window(stream).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rates = [r.rate_per_s for r in spark.sql("select * from rates where fires_in_window = 5").collect()]
    assert len(rates) > 30 and set(rates) == {1.0}


def test_floor_division_is_exact_beyond_doubles(spark):
    from wardline.functions.scalar import floor_div

    xs = [1_704_553_130_025_999_999, 1_704_553_130_026_000_000, -1, -1_000_000, -1_000_001, 0, 2**63 - 1]
    out = spark.createDataFrame([(x,) for x in xs], "x bigint").select(floor_div(F.col("x"), 1_000_000)).collect()
    assert [r[0] for r in out] == [x // 1_000_000 for x in xs]


def test_islands_in_nanoseconds_and_before_the_epoch(spark):
    from wardline.plans.islands import islands

    gap = 3_600_000_000_000
    t0 = 1_704_553_130_025_999_999
    times = [-gap, -1, 0, 5, t0, t0 + gap, t0 + 2 * gap + 1]
    out = islands(spark.createDataFrame([("k", t) for t in times], "k string, t bigint"), ["k"], "t", gap).orderBy("start").collect()
    assert [(r.start, r.end, r.events) for r in out] == [(-gap, 5, 4), (t0, t0 + gap, 2), (t0 + 2 * gap + 1, t0 + 2 * gap + 1, 1)]


def test_median_beside_infinite_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", math.inf), ("b", -math.inf), ("b", 3.0), ("b", 4.0), ("b", 5.0)]
    med = {r.g: r.median for r in R.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert med == {"a": 2.0, "b": 3.5}


def test_panel_does_not_pass_by_omission(spark):
    manifests = spark.createDataFrame([(c, "r", 1) for c in "abc"], "case_id string, epoch_root string, evidence_count bigint")
    replayed = spark.createDataFrame([("a", True), ("b", True)], "case_id string, verdict_hash_matches boolean")
    proofs = spark.createDataFrame([("a", True, "r"), ("c", True, "r")], "case_id string, valid boolean, root string")
    got = {r.case_id: r.result for r in C.verify_cases(manifests, replayed, proofs).collect()}
    assert got == {"a": "match", "b": "mismatch", "c": "mismatch"}
    without = {r.case_id: r.result for r in C.verify_cases(manifests.drop("evidence_count"), replayed, proofs).collect()}
    assert without == got


def test_every_tile_is_there_without_points(spark):
    cases = spark.createDataFrame([], "status string, created_at_ms bigint, first_event_ms bigint, closed_at_ms bigint, closed_by string, updated_at_ms bigint, disposition string")
    drifts = spark.createDataFrame([], "swept_at_ms bigint")
    tiles = {r.tile: r for r in C.stat_tiles(cases, drifts, 10**12).collect()}
    assert set(tiles) == set(C.TILES)
    assert tiles["open-cases"].value == 0 and tiles["mttd"].value is None and tiles["mttd"].improved == "flat"
