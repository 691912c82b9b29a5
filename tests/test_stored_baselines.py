import random

from pyspark.sql import functions as F

from wardline.operators import sketches as K
from wardline.operators.analytics import DAY_NS, retro_hunt
from wardline.plans import catalog
from wardline.sources import history as H
from test_claimindex import files_read

EVENTS = "host string, user string, time bigint, bytes double"


def volumes(spark):
    rng = random.Random(3)
    # host 'hot' has over a third of all rows; on day 2 nobody has a value
    rows = [("hot" if i % 5 < 2 else f"h{i % 7}", f"u{rng.randrange(900)}", i % 6 * DAY_NS + i, None if i % 6 == 2 else rng.lognormvariate(8, 2)) for i in range(12_000)]
    rows += [("nan", "u1", DAY_NS, float("nan")), ("nan", None, DAY_NS, None), ("h1", "u2", None, 5.0), ("old", "u3", -1, 5.0)]
    return rows, spark.createDataFrame(rows, EVENTS)


def test_merged_days_equal_a_full_pass(spark, tmp_path):
    rows, df = volumes(spark)
    K.store_days(K.daily_sketches(df, ["host"], "bytes", "user"), str(tmp_path))
    merged = K.merge_sketches(K.read_days(spark, str(tmp_path), 1, 4), ["host"])
    got = {r.host: r for r in K.with_estimates(merged, [0.5, 0.99]).collect()}
    want = {}
    for host, user, time, value in rows:
        if time is not None and DAY_NS <= time < 5 * DAY_NS:
            want.setdefault(host, []).append((user, value))
    assert set(got) == set(want)
    for host, held in want.items():
        values = sorted(v for _, v in held if v is not None and v == v)
        users = len({u for u, _ in held if u is not None})
        r = got[host]
        assert (r.events, r.n) == (len(held), len(values)) and abs(r.distinct_entities - users) <= max(1, users * 0.03)
        if not values:
            assert r.percentiles is None and r.lowest is None
            continue
        assert (r.lowest, r.highest) == (values[0], values[-1])
        for p, q in zip((0.5, 0.99), r.percentiles):
            assert sum(v < q for v in values) / len(values) - 0.01 <= p <= sum(v <= q for v in values) / len(values) + 0.01
    assert spark.read.parquet(str(tmp_path)).agg(F.min("day")).first()[0] == -1
    # groups merge too, and all of one host's values rank as they do in a full pass
    both = K.merge_sketches(K.read_days(spark, str(tmp_path), 0, 5), [])
    assert both.first().events == sum(t is not None and t >= 0 for _, _, t, _ in rows)
    now = spark.createDataFrame([("hot", 1e12), ("hot", 1.0), ("nan", 9.0), ("none", 9.0)], "host string, bytes double")
    assert [(r.host, r.bytes, r.usual < 1e12) for r in K.unusual_volume(now, merged, ["host"], "bytes").collect()] == [("hot", 1e12, True)]


def test_a_day_is_replaced_alone_and_others_are_not_opened(spark, tmp_path):
    _, df = volumes(spark)
    days = K.daily_sketches(df, ["host"], "bytes", "user")
    K.store_days(days, str(tmp_path))
    K.store_days(days.filter("day = 3 and host = 'hot'"), str(tmp_path))
    kept = {(r.day, r.host) for r in spark.read.parquet(str(tmp_path)).select("day", "host").collect()}
    assert {h for d, h in kept if d == 3} == {"hot"} and len({h for d, h in kept if d == 4}) > 5
    assert files_read(K.read_days(spark, str(tmp_path), 3, 3)) == 1
    assert K.daily_sketches(df.limit(0), ["host"], "bytes", "user").count() == 0


def test_history_opens_the_days_asked_for(spark, tmp_path):
    rows = [(f"s{i % 11 if i % 3 else 0}", 1, f"ip{i % 7}", i % 40 * DAY_NS + i) for i in range(4000)] + [("s1", 1, "ip1", None)]
    ev = spark.createDataFrame(rows, "session_id string, status_id int, src_endpoint_ip string, time bigint").withColumn("activity_id", F.lit(1))
    H.write_history(ev, str(tmp_path), "session_id", files=8)
    end = 40 * DAY_NS
    counts = [files_read(H.read_history(spark, str(tmp_path), end - n * DAY_NS, end)) for n in (1, 5, 40)]
    assert counts[0] < counts[1] < counts[2] and counts[0] <= 3
    read = H.read_history(spark, str(tmp_path), end - 5 * DAY_NS, end)
    assert read.count() == sum(t is not None and t >= end - 5 * DAY_NS for *_, t in rows)
    hunt = lambda df: sorted(map(tuple, retro_hunt(catalog.TOKEN_REPLAYED, df, end, 5).collect()))
    assert hunt(read) == hunt(ev) and hunt(read)
    # the middle of a day: rows outside the hours asked for are left out
    half = H.read_history(spark, str(tmp_path), 38 * DAY_NS + 2000, 39 * DAY_NS + 1)
    assert half.count() == sum(t is not None and 38 * DAY_NS + 2000 <= t < 39 * DAY_NS + 1 for *_, t in rows)
    # all rows are stored, the one without a time too
    assert spark.read.parquet(str(tmp_path)).count() == len(rows)
