"""Rule fixtures: positive and negative cases of the six shipped rules."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from wardline.operators import detect as D
from wardline.plans import catalog, rules
from wardline.streaming import windows as W

SCHEMA = """event_id bigint, time bigint, activity_id bigint, status_id bigint, actor_user_uid string, actor_user_type string, src_endpoint_ip string,
  cloud_asn string, session_id string, distance_from_prev_km bigint, host_uid string, is_run_key boolean, app_name string, src_host_uid string, dst_host_uid string"""
FIELDS = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(",")]
SEC = 1_000_000_000
T0 = 1_700_000_000 * SEC


def events(spark, rows):
    return spark.createDataFrame([tuple({"event_id": i, "activity_id": 1, **r}.get(f) for f in FIELDS) for i, r in enumerate(rows)], SCHEMA)


def login(uid, at, status=1, **more):
    return {"actor_user_uid": uid, "time": T0 + at * SEC, "status_id": status, "actor_user_type": "user", "src_endpoint_ip": "192.0.2.1", **more}


def found(df):
    return {(r.predicate, r.entity, r.observed) for r in df.collect()}


def test_burst_then_success(spark):
    ev = events(spark, [login("jdoe", i, 2) for i in range(10)] + [login("jdoe", 10)])
    assert found(D.auth_burst(ev)) == {("AUTH_FAILED_BURST", "jdoe", "10"), ("AUTH_SUCCEEDED_AFTER_FAILURES", "jdoe", str(SEC))}


def test_success_without_failures_is_quiet(spark):
    assert found(D.auth_burst(events(spark, [login("a", 1), login("a", 2)]))) == set()


def test_service_account_is_suppressed_with_reason(spark):
    ev = events(spark, [login("ci", i, 2, actor_user_type="service", src_endpoint_ip="198.51.100.9") for i in range(10)])
    assert found(D.auth_burst(ev)) == set()
    assert [r.suppress_reason for r in rules.suppressed(catalog.AUTH_BURST, ev).collect()] == ["CI runners retry aggressively by design"]


@pytest.mark.parametrize("asn,want", [("AS99999", {("AUTH_FROM_NEW_ASN", "u", "AS99999")}), ("AS1", set())])
def test_new_asn(spark, asn, want):
    history = events(spark, [login("u", -i - 1, cloud_asn="AS1") for i in range(3)])
    assert found(D.auth_new_asn(events(spark, [login("u", 5, cloud_asn=asn)]), history)) == want


def test_short_history_is_never_novel(spark):
    history = events(spark, [login("u", -1, cloud_asn="AS1")])
    assert found(D.auth_new_asn(events(spark, [login("u", 5, cloud_asn="AS2")]), history)) == set()


@pytest.mark.parametrize("km,want", [(2000, {("TRAVEL_IMPOSSIBLE", "u", "2000.0")}), (200, set())])
def test_travel(spark, km, want):
    ev = events(spark, [login("u", 0), login("u", 3600, distance_from_prev_km=km)])
    assert found(D.impossible_travel(ev)) == want


def test_travel_single_login_and_egress(spark):
    one = events(spark, [login("u", 0, distance_from_prev_km=9000)])
    vpn = events(spark, [login("u", 0), login("u", 3600, distance_from_prev_km=9000, src_endpoint_ip="203.0.113.44")])
    assert found(D.impossible_travel(one)) == set() and found(D.impossible_travel(vpn)) == set()


@pytest.mark.parametrize("ips,want", [(["a", "b"], {("TOKEN_REPLAYED", "s1", "2")}), (["a", "a"], set())])
def test_token_replay(spark, ips, want):
    ev = events(spark, [{"session_id": "s1", "status_id": 1, "time": T0 + i, "src_endpoint_ip": ip} for i, ip in enumerate(ips)])
    assert found(D.token_replayed(ev)) == want


@pytest.mark.parametrize("key,want", [(True, {("PERSISTENCE_INSTALLED", "h1", "1")}), (False, set()), (None, set())])
def test_run_key(spark, key, want):
    assert found(D.persistence(events(spark, [{"host_uid": "h1", "is_run_key": key, "time": T0}]))) == want


@pytest.mark.parametrize("dst,want", [("WIN-03", {("RDP_INTERNAL_FIRST_TIME", "WIN-01", "WIN-03")}), ("WIN-02", set())])
def test_rdp_pair(spark, dst, want):
    pair = lambda d, at: {"app_name": "rdp", "src_host_uid": "WIN-01", "dst_host_uid": d, "time": T0 + at}
    history = events(spark, [pair("WIN-02", -2), pair("WIN-02", -1)])
    assert found(D.rdp_first_time(events(spark, [pair(dst, 1)]), history)) == want


def test_benign_corpus_has_no_false_positive(spark):
    rows = [login(u, i * 600) for i, u in enumerate(["b", "b", "c", "d", "d", "d"])]
    rows += [{"session_id": "s", "status_id": 1, "src_endpoint_ip": "x", "time": T0 + i} for i in range(3)]
    rows += [{"host_uid": "h", "is_run_key": False, "time": T0 + i} for i in range(3)]
    rows += [{"app_name": "rdp", "src_host_uid": "h", "dst_host_uid": "k", "time": T0 + i} for i in range(3)]
    rows += [login("e", i, cloud_asn="AS1") for i in range(2)]
    out = D.fp_rate(catalog.ALL_RULES, events(spark, rows)).collect()
    assert len(out) == 6 and all(r.claims == 0 for r in out)


def test_last_value_skips_absent_and_ties_break_by_id(spark):
    ev = events(spark, [login("u", 1, cloud_asn="old"), login("u", 1, cloud_asn="new"), login("u", 2)])
    row = rules.source_aggregates(ev, catalog.AUTH_NEW_ASN.sources["auths"]).first()
    assert row.last_cloud_asn == "new" and row["count"] == 3


def test_rows_with_null_keys_anchor_no_case_but_feed_coarser_sources(spark):
    ev = events(spark, [login("u", i, 2) for i in range(10)] + [login("u", 20, src_endpoint_ip=None)])
    assert ("AUTH_SUCCEEDED_AFTER_FAILURES", "u", str(11 * SEC)) in found(D.auth_burst(ev))
    assert rules.cases(ev, catalog.AUTH_BURST.sources).count() == 1


def test_unknown_name_fails_at_analysis(spark):
    bad = rules.Rule("r", 1, "host_uid", {"s": rules.Source("true", ("host_uid",))}, (rules.Emit("P", "s.nothing > 1"),))
    with pytest.raises(Exception, match="nothing"):
        rules.evaluate(bad, events(spark, [{"host_uid": "h", "time": T0}]))


def test_order_and_partitioning_do_not_matter(spark):
    rows = [login(f"u{i % 7}", i, 2 if i % 3 else 1) for i in range(400)]
    ev = events(spark, rows)
    other = ev.repartition(7, "event_id").orderBy(F.rand(3))
    assert found(D.auth_burst(ev)) == found(D.auth_burst(other)) != set()


def streamed(spark, folder, rows, order, delay):
    """Detections of a stream over five files of consecutive times that arrive in the given order."""
    size = -(-len(rows) // 5)
    for nth, k in enumerate(order):
        ev = events(spark, rows).filter(F.col("event_id").between(k * size, k * size + size - 1))
        ev.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for file in os.listdir(f"{folder}/in"):  # the source goes by modification times, here a second apart
            path = f"{folder}/in/{file}"
            if os.stat(path).st_mtime > 10**9 + 1000:
                os.utime(path, (10**9 + nth, 10**9 + nth))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def emit(df, batch_id):
        df.write.mode("overwrite").parquet(f"{folder}/out/b={batch_id}")

    W.stream_detections(catalog.TOKEN_REPLAYED, stream, emit, f"{folder}/ck", delay=delay).awaitTermination()
    return {(str(r.window_start), r.entity, r.observed) for r in spark.read.parquet(f"{folder}/out").collect()}


REPLAYS = [
    {"session_id": f"s{i % 9}", "status_id": 1, "src_endpoint_ip": f"ip{i % 4 if i % 9 < 5 else 0}", "time": T0 + i * 40 * SEC} for i in range(300)
]


def test_stream_equals_batch(spark, tmp_path):
    got = streamed(spark, tmp_path, REPLAYS, range(5), "3 hours")
    batch = W.windowed_detections(catalog.TOKEN_REPLAYED, events(spark, REPLAYS))
    last = batch.agg(F.max("window_start")).first()[0]
    want = {(str(r.window_start), r.entity, r.observed) for r in batch.collect()}
    assert got and got <= want
    # what the stream has not emitted yet lies inside the watermark delay
    held = [datetime.datetime.fromisoformat(w[0]) for w in want - got]
    assert all((last - at).total_seconds() <= 3 * 3600 + 900 for at in held)


def test_late_files_are_dropped_beyond_the_delay(spark, tmp_path):
    want = {(str(r.window_start), r.entity, r.observed) for r in W.windowed_detections(catalog.TOKEN_REPLAYED, events(spark, REPLAYS)).collect()}
    waited = streamed(spark, tmp_path / "a", REPLAYS, (1, 0, 2, 3, 4), "2 hours")
    hasty = streamed(spark, tmp_path / "b", REPLAYS, (4, 0, 1, 2, 3), "1 minute")
    assert waited and waited <= want
    # the watermark of a micro-batch holds from the second one after it, so only the files between came too late
    windows = {w for w, _, _ in hasty}
    assert not {w for w in windows if "2023-11-14 23:00:00" <= w <= "2023-11-15 00:30:00"} and min(windows) < "2023-11-14 23"
