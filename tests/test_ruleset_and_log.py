"""Rules evaluated together equal rules evaluated alone; the change log stays small and whole."""

import random

import pytest

from tests.test_rules import T0, SEC, events
from wardline.operators import detect as D
from wardline.plans import catalog, rules, ruleset
from wardline.plans.rules import Emit, Rule, Source
from wardline.streaming.changelog import ChangeLog


def traffic(spark, n=500, seed=3):
    rng = random.Random(seed)

    def one(i):
        return {
            "time": T0 + rng.randrange(10_000) * SEC, "status_id": rng.choice([1, 2, 2]), "actor_user_uid": rng.choice(["a", "b", "c", None]),
            "actor_user_type": rng.choice(["user", "service", None]), "src_endpoint_ip": rng.choice(["192.0.2.1", "198.51.100.9", None]),
            "cloud_asn": f"AS{rng.randrange(9)}", "session_id": rng.choice(["s1", "s2", None]), "distance_from_prev_km": rng.choice([None, 9_000]),
            "host_uid": rng.choice(["h1", "h2", None]), "is_run_key": rng.random() < 0.1, "app_name": rng.choice(["rdp", "web"]),
            "src_host_uid": rng.choice(["h1", "h3"]), "dst_host_uid": f"d{rng.randrange(500)}",
        }

    return events(spark, [one(i) for i in range(n)])


COUNTED = Rule(
    "test.addresses", 1, "actor_user_uid",
    {"ok": Source(catalog.LOGIN_OK, ("actor_user_uid",), track_distinct=("session_id", "src_endpoint_ip")), "bad": Source(catalog.LOGIN_FAILED, ("actor_user_uid",))},
    (Emit("MANY", "ok.distinct_session_id >= 1", "ok.distinct_src_endpoint_ip + bad.count"),),
)


def test_together_as_alone(spark):
    ev, hist = traffic(spark), traffic(spark, 40, 9)
    every = (*catalog.ALL_RULES, COUNTED)
    alone = []
    for rule in every:
        base = D.warm_up(hist, rule.entity, rule.observations) if rule.novelty else None
        alone += [tuple(r) for r in D.claim_keys(rules.evaluate(rule, ev, base)).collect()]
    together = [tuple(r) for r in D.detections_of(every, ev, hist).collect()]
    assert sorted(together, key=repr) == sorted(alone, key=repr) and {r[3] for r in alone} >= {r.id for r in catalog.ALL_RULES[3:]} | {COUNTED.id}


def test_one_scan_for_each_set_of_keys(spark, monkeypatch):
    groups = ruleset.key_groups(catalog.ALL_RULES)
    assert [len(g.rules) for g in groups] == [1, 2, 1, 1, 1]
    # alike conditions are one aggregate
    assert len(ruleset.KeyGroup(("actor_user_uid",), (catalog.AUTH_NEW_ASN, catalog.AUTH_NEW_ASN)).conditions()) == 1
    made = []
    shared = ruleset.shared_aggregate
    monkeypatch.setattr(ruleset, "shared_aggregate", lambda group, ev: made.append(group) or shared(group, ev))
    rates = D.fp_rate(catalog.ALL_RULES, traffic(spark), traffic(spark, 40, 9))
    assert len(made) == 5
    assert rates.count() == 6
    assert {r["rule_id"]: r["cases"] for r in rates.collect()}["cdl.credential.token-replayed"] == 2


@pytest.mark.parametrize("fanout", [2, 3])
def test_log_of_many_batches_stays_small(spark, tmp_path, fanout):
    log = ChangeLog(spark, str(tmp_path / "log"), "id", "seq", fanout)
    assert log.read() is None
    rng, want = random.Random(fanout), {}
    for batch in range(20):
        rows = [(f"k{rng.randrange(12)}", 100 * batch + i) for i in range(4)]
        want |= dict(sorted(rows, key=lambda r: r[1]))
        frame = spark.createDataFrame([(k, s, f"v{s}") for k, s in rows], "id string, seq bigint, value string").coalesce(1)
        version = log.append(frame, batch)
        assert log.append(frame.limit(0), batch) == version  # a repeated micro-batch changes nothing
        log.clean()
        levels = [level for level, _ in version.folders]
        assert levels == sorted(levels, reverse=True) and max(map(levels.count, levels)) < fanout
    assert {r["id"]: r["value"] for r in log.read().collect()} == {k: f"v{s}" for k, s in want.items()}
    assert log.versions() == [18, 19] and log.read(18).count() <= 12
    on_disk = [p for level in (tmp_path / "log").glob("level=*") for p in level.iterdir()]
    assert len(on_disk) <= 2 * len(version.folders) + fanout


def test_a_reader_keeps_its_version(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "id", "seq")
    row = "id string, seq bigint, value string"
    log.append(spark.createDataFrame([("a", 1, "old")], row), 0)
    before = log.read()
    log.append(spark.createDataFrame([("a", 2, "new"), ("b", 1, "b")], row), 1)
    assert [r["value"] for r in before.collect()] == ["old"]
    assert sorted(r["value"] for r in log.read().collect()) == ["b", "new"]
