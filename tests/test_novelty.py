"""Baselines that grow with the events: batch against brute force, stream against batch."""

import os
import random
from collections import defaultdict

import pytest

from wardline.streaming import folds
from wardline.streaming import novelty as V

SCHEMA = V.SIGHT


def brute(rows, threshold, prior=(), ttl=None):
    counts, seen, out = defaultdict(int), {}, []
    for e, a, v, n, last in prior:
        counts[e, a] += n
        seen[e, a, v] = last
    for e, a, v, t, i in sorted(rows, key=lambda r: (r[3], r[4])):
        before = seen.get((e, a, v))
        if counts[e, a] >= threshold and (before is None or (ttl is not None and t - before > ttl)):
            out.append((e, a, v, t, i))
        counts[e, a] += 1
        seen[e, a, v] = t if before is None else max(before, t)
    return sorted(out)


def sample(seed=1, n=400):
    rng = random.Random(seed)
    return [(rng.choice("aaaaab") + "x", rng.choice(["asn", "host"]), f"v{min(rng.randrange(60), rng.randrange(60))}", 10**12 + 1000 * (i // 2), i) for i in range(n)]


PRIOR = [("ax", "asn", "v1", 1, 10**12 - 50_000), ("ax", "asn", "v50", 1, 10**12 - 10**9), ("bx", "host", "v3", 4, 10**12 - 1)]


def frames(spark, rows, prior):
    known = spark.createDataFrame(prior, "entity string, attribute string, value string, times_seen bigint, last_seen bigint") if prior else None
    return spark.createDataFrame(rows, SCHEMA), known


@pytest.mark.parametrize("ttl", [None, 40_000])
@pytest.mark.parametrize("prior", [[], PRIOR])
def test_batch_against_brute_force(spark, ttl, prior):
    rows = sample()
    observed, known = frames(spark, rows, prior)
    for threshold in (0, 3):
        got = sorted(map(tuple, V.first_sights(observed, threshold, known, ttl).collect()))
        assert got == brute(rows, threshold, prior, ttl)


def written(spark, rows, folder, files=6):
    """Files of consecutive times, written one after another so that a stream meets them in order."""
    size = -(-len(rows) // files)
    for k in range(files):
        name = f"{folder}/in"
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(name)
        for file in os.listdir(name):  # a second apart
            if file.endswith(".parquet") and os.stat(f"{name}/{file}").st_mtime > 10**9 + 1000:
                os.utime(f"{name}/{file}", (10**9 + k, 10**9 + k))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@pytest.mark.parametrize("ttl", [None, 40_000])
def test_second_sight_on_a_stream_is_silent(spark, tmp_path, ttl):
    rows = sample(2, 180)
    _, known = frames(spark, rows, PRIOR)
    stream = written(spark, rows, tmp_path)

    def emit(df, batch_id):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")

    V.stream_first_sights(stream, emit, f"{tmp_path}/state", 3, known, ttl).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").select("entity", "attribute", "value", "time", "event_id").collect()))
    assert got == brute(rows, 3, PRIOR, ttl)
    assert len(list((tmp_path / "out").iterdir())) >= 6
    # a restart goes on from the stored state: what was seen stays seen
    again = [(e, a, v, t + 10_000, i + 1000) for e, a, v, t, i in rows[-30:]]
    spark.createDataFrame(again, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    V.stream_first_sights(stream, emit, f"{tmp_path}/state", 3, known, ttl).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").select("entity", "attribute", "value", "time", "event_id").collect()))
    assert got == brute(rows + again, 3, PRIOR, ttl)


def test_evidence_is_stored_once_for_ever(spark, tmp_path):
    schema = "evidence_id string, at bigint"
    for start in (0, 20, 5, 10**15):  # ids of any earlier run come again, however far the time has moved
        rows = [(f"e{i % 40}", start + i) for i in range(start % 1000, start % 1000 + 30)] * 2
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        folds.store_evidence(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    ids = [r["evidence_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(ids) == sorted({f"e{i}" for i in range(40)})
