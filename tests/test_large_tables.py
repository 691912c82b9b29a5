"""What a query does not do on large tables: a row per line at the driver, hashes as digits through many shuffles."""

import datetime as dt
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry

from wardline.operators import chains as C
from wardline.operators import drift as D
from wardline.operators import gate as G
from wardline.operators import merkle as M
from wardline.plans import digest
from wardline.sources import bundles as B


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"[- ]Exchange (?:hash|range|single)", plan_of(df)))


def test_envelope_sends_no_row_per_line_to_the_driver(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 0, 0, 11, 172425)
    rows = [(i, at, i % 5, "view", 1.5, '{"k": 7}') for i in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    df = entry.queries()["a05_envelope"](spark, str(tmp_path))
    assert "BroadcastExchange" not in plan_of(df)
    got = df.collect()
    assert len(got) == 52 and all(r.new_identity and r.mapping_version == "2" for r in got)


def test_small_batches_are_sealed_in_one_shuffle(spark):
    df = spark.range(500).selectExpr("concat('b', id % 50) as batch", "concat('e', id) as evidence_id")
    assert exchanges(M.seal_batches(df, "batch").batches) == 1


def test_crowded_keys_are_spread_and_hash_the_same(spark, monkeypatch):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 40)) as g", "sha2(cast(id % 2900 as string), 256) as v")
    df = df.unionByName(spark.createDataFrame([("hot", "no digits"), ("hot", None), ("g1", "0" * 31), ("g1", None), (None, "ab")], "g string, v string"))
    want = {r.g: (r.digest, r.n) for r in digest.set_digest(df, ["g"], F.col("v"), count="n", hashed=True).collect()}
    light = digest.set_digest(df, ["g"], F.col("v"), count="n", hashed=True, colocate=["g"])
    assert exchanges(light) == 1
    assert {r.g: (r.digest, r.n) for r in light.collect()} == want
    tree = {tuple(r) for r in M.seal_batches(df.filter("g is not null and v is not null"), "g", id_col="v").batches.collect()}
    monkeypatch.setattr(digest, "CROWDED", 200)
    assert digest.crowded(df, ["g"])[0]
    spread = digest.set_digest(df, ["g"], F.col("v"), count="n", hashed=True, colocate=["g"])
    assert {r.g: (r.digest, r.n) for r in spread.collect()} == want
    assert {tuple(r) for r in M.seal_batches(df.filter("g is not null and v is not null"), "g", id_col="v").batches.collect()} == tree


def test_verified_chain_is_not_dealt_by_element(spark):
    df = spark.range(40).selectExpr("if(id < 30, 'a', 'b') as t", "id as seq", "sha2(cast(id as string), 256) as content")
    sealed = df.join(C.chain(df, ["t"], "seq", "content", size=8), ["t", "seq"])
    twice = sealed.unionByName(sealed.filter("seq = 12"))
    checked = C.verify_chain(sealed, ["t"], "seq", "content", size=8)
    assert not re.search(r"hashpartitioning\(t#\d+, seq", plan_of(checked.select("t", "seq", "hash_ok", "link_ok")))
    rows = checked.collect()
    assert len(rows) == 40 and all(r.hash_ok and r.link_ok for r in rows)
    assert C.verify_chain(twice, ["t"], "seq", "content", size=8).filter("seq = 12").count() == 4


def test_bundles_are_compressed_and_proofs_dealt_once(spark, tmp_path):
    df = spark.createDataFrame([("c1", 1), ("c2", 2)], "case_id string, n int")
    B._write(df, f"{tmp_path}/manifests")
    names = [p.name for p in tmp_path.rglob("part-*")]
    assert names and all(n.endswith(".json.gz") for n in names)
    dealt = B._dealt(df)
    assert {r.bucket for r in dealt.collect()} == {r.b for r in df.select(B.bucket_of(F.col("case_id")).alias("b")).collect()}


def test_few_unknown_ids_are_found_without_a_shuffle_by_claim(spark, monkeypatch):
    claims = spark.createDataFrame(
        [("c1", "i1", "P", 1, 2, ["e1", "x2", "x1", "x1"]), ("c1", "i2", "P", 1, 2, ["e1"]), ("c1", "i3", "P", 1, 2, []), ("c2", "i4", "Q", 1, 2, ["e1"]),
         ("c2", "i5", "P", 3, 2, ["e1", None]), ("c3", "i6", "P", 1, 2, ["e1"]), ("c2", "i7", "P", 1, 99, ["e1"]), (None, "i8", "P", 1, 2, ["x1"]), ("c1", "i9", "P", 1, 2, None)],
        "case_id string, claim_id string, predicate string, interval_start_ns bigint, interval_end_ns bigint, evidence array<string>",
    )
    pinned = spark.createDataFrame([("e1",)], "evidence_id string")
    registry = spark.createDataFrame([("P",)], "predicate string")
    windows = spark.createDataFrame([("c1", 0, 9), ("c2", 0, 9)], "case_id string, window_start_ns bigint, window_end_ns bigint")

    def judged():
        return G.judge(claims, pinned, registry, windows).select("claim_id", "reason", "unknown_evidence")

    assert "claim_id" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan_of(judged())))
    got = {r.claim_id: (r.reason, r.unknown_evidence) for r in judged().collect()}
    assert got["i1"] == (G.UNKNOWN, ["x1", "x2"]) and got["i2"] == (None, None) and got["i3"][0] == got["i9"][0] == G.EMPTY
    assert [got[i][0] for i in ("i4", "i5", "i6", "i7", "i8")] == [G.PREDICATE, G.INVERTED, G.OUTSIDE, G.OUTSIDE, G.OUTSIDE]
    monkeypatch.setattr(G, "FEW_UNKNOWN", 0)
    assert {r.claim_id: (r.reason, r.unknown_evidence) for r in judged().collect()} == got


ASSERTED = "case_id string, predicate string, subject string, object string, interval_start_ns bigint, interval_end_ns bigint, evidence array<string>, polarity string"


def test_rederived_claims_meet_in_one_shuffle(spark, monkeypatch):
    rows = [(f"c{i % 3}", "P", f"s{i}", None, 1, 2, ["b", "a"], "supports") for i in range(9)] + [(None, "P", "s", None, 1, 2, None, "supports")]
    old = spark.createDataFrame(rows, ASSERTED)
    new = spark.createDataFrame(rows[1:] + rows[1:2] + [("c0", "Q", "s0", None, 1, 2, [], "supports")], ASSERTED)

    def changes():
        return D.rederive_claims(old, new)

    assert exchanges(changes()) == 1 and "Join" not in plan_of(changes())
    want = sorted((str(r.case_id), r.change) for r in changes().collect())
    assert want == sorted([("c0", "removed"), ("c0", "added"), ("None", "added"), ("None", "removed")] + [(f"c{i % 3}", "unchanged") for i in range(1, 9)])
    monkeypatch.setattr(digest, "CROWDED", 2)
    assert sorted((str(r.case_id), r.change) for r in changes().collect()) == want


def test_claims_of_other_predicates_do_not_meet_the_corpus(spark):
    claims = spark.createDataFrame([("c1", "i1", 1, "P", "o1"), ("c1", "i2", 2, "Q", "o1"), ("c2", "i3", 1, "P", None)], "case_id string, claim_id string, claim_seq int, predicate string, object string")
    corpus = spark.createDataFrame([("v", 1, "P", "o1", 5, ["T"]), ("v", 2, "P", "o1", 6, ["T"]), ("w", 1, "Q", "o1", 5, ["T"])], "corpus_version string, position int, predicate string, value string, weight bigint, techniques array<string>")
    hit = D.match_indicators(claims, corpus, "v")
    assert "LeftSemi" in plan_of(hit)
    assert [(r.claim_id, r.weight) for r in hit.collect()] == [("i1", 5)]
