import pytest
from pyspark.sql import functions as F

from wardline.operators import adjudicate as A
from wardline.operators import drift as D
from wardline.operators import gate as G
from wardline.operators import identity as I
from wardline.operators import ledger as L
from wardline.sources import bundles as B

CLAIM = """case_id string, claim_seq int, predicate string, subject string, object string, interval_start_ns bigint, interval_end_ns bigint,
  evidence array<string>, extractor_kind string, extractor_id string, extractor_version string, observed_value bigint, polarity string, hypothesis_ref string"""
TIERS = [("info", 0), ("low", 2000), ("medium", 5000), ("high", 8000), ("critical", 12000)]


def claim(case, predicate, seq=0, object=None, evidence=("e1",), polarity="supports", observed=None, subject="s"):
    return (case, seq, predicate, subject, object, 0, 10, list(evidence), "rule", "x", "1", observed, polarity, None)


def claims_df(spark, rows):
    return spark.createDataFrame(rows, CLAIM)


def cases_df(spark, ids, version="p"):
    return spark.createDataFrame([(i, version) for i in ids], "case_id string, policy_version string")


def policy(spark, weights, chains=(), tiers=TIERS, version="p"):
    return A.policy_from_rows(
        spark,
        [(version, p, t, w, list(te)) for p, (t, w, te) in weights.items()],
        [(version, a, b, x) for a, b, x in chains] or spark.createDataFrame([], "policy_version string, from_tactic string, to_tactic string, bonus bigint").collect(),
        [(version, i, t, s) for i, (s, t) in enumerate(tiers)],
    )


INTRUSION = {
    "AUTH_FAILED_BURST": ("credential-access", 2000, ["T1110.001"]),
    "AUTH_SUCCEEDED_AFTER_FAILURES": ("credential-access", 1000, ["T1078"]),
    "INTERPRETER_SPAWNED_BY": ("execution", 1500, ["T1059.001"]),
    "ENCODED_COMMAND": ("execution", 1500, ["T1059.001"]),
    "INTERPRETER_NETWORK_EGRESS": ("command-and-control", 2000, ["T1071.001"]),
    "CONNECTED_TO_INDICATOR": ("command-and-control", 0, ["T1071.001"]),
}


def verdicts(spark, rows, pol, ids=None):
    out = A.adjudicate(cases_df(spark, ids or sorted({r[0] for r in rows})), claims_df(spark, rows), pol, "k")
    return {r.case_id: r for r in out.collect()}


def test_six_claim_intrusion_and_priced_indicator(spark):
    rows = [claim("c", p) for p in INTRUSION]
    before = verdicts(spark, rows, policy(spark, INTRUSION))["c"]
    after = verdicts(spark, rows, policy(spark, {**INTRUSION, "CONNECTED_TO_INDICATOR": ("command-and-control", 5000, ["T1071.001"])}))["c"]
    assert (before.severity, before.disposition, before.confidence) == ("high", "malicious", 8000)
    assert (after.severity, after.confidence, after.total_score) == ("critical", 10000, 13000)
    assert before.attack_techniques == ["T1059.001", "T1071.001", "T1078", "T1110.001"]
    assert before.verdict_hash != after.verdict_hash and before.contributing_count == 6


@pytest.mark.parametrize("bonus,score", [(500, 2500), (0, 2000)])
def test_adjacent_tactics(spark, bonus, score):
    w = {"A": ("execution", 1000, []), "B": ("persistence", 1000, [])}
    v = verdicts(spark, [claim("c", "A"), claim("c", "B")], policy(spark, w, [("execution", "persistence", bonus)]))["c"]
    assert v.total_score == score


def test_bonus_needs_entry_and_adjacency_and_counts_weight_zero_tactics(spark):
    w = {"A": ("execution", 0, []), "B": ("persistence", 1000, []), "C": ("credential-access", 10, []), "D": ("lateral-movement", 10, [])}
    chains = [("execution", "persistence", 300), ("credential-access", "lateral-movement", 9000), ("persistence", "execution", 7)]
    v = verdicts(spark, [claim("x", "A"), claim("x", "B"), claim("y", "C"), claim("y", "D"), claim("z", "B")], policy(spark, w, chains))
    assert (v["x"].total_score, v["y"].total_score, v["z"].total_score) == (1300, 20, 1000)


def test_incomplete_never_benign(spark):
    rows = [claim("unknown", "NOPE"), claim("noevidence", "ENCODED_COMMAND", evidence=[])]
    v = verdicts(spark, rows, policy(spark, INTRUSION), ["unknown", "noevidence", "empty"])
    assert {(r.disposition, r.severity, r.confidence) for r in v.values()} == {("incomplete", "info", 0)} and len(v) == 3


def test_refutes_copies_and_negative_totals(spark):
    rows = [claim("r", "ENCODED_COMMAND", polarity="refutes"), *[claim("d", "ENCODED_COMMAND")] * 2, claim("zero", "CONNECTED_TO_INDICATOR")]
    v = verdicts(spark, rows, policy(spark, INTRUSION))
    assert (v["r"].total_score, v["r"].confidence, v["r"].severity, v["r"].disposition) == (-1500, 0, "info", "benign")
    assert v["d"].total_score == 3000 and v["d"].contributing_count == 2
    assert v["zero"].disposition == "benign"


def test_scores_stay_inside_int64(spark):
    big = 2**63 - 1
    w = {"A": ("execution", big, []), "B": ("persistence", big, []), "N": ("impact", -(2**63), [])}
    v = verdicts(spark, [claim("c", "A"), claim("c", "A"), claim("c", "B"), claim("n", "N"), claim("m", "N", polarity="refutes")], policy(spark, w))
    assert v["c"].total_score == big and v["n"].total_score == -(2**63) and v["m"].total_score == big


def test_verdicts_do_not_depend_on_order_or_partitioning(spark):
    rows = [claim(f"c{i % 11}", list(INTRUSION)[i % 6], seq=i, evidence=[f"e{i % 5}", "e0"], observed=i % 3) for i in range(500)]
    pol, cases = policy(spark, INTRUSION), cases_df(spark, [f"c{i}" for i in range(11)])
    base = {(r.case_id, r.verdict_hash) for r in A.adjudicate(cases, claims_df(spark, rows), pol, "k").collect()}
    for n in (1, 3, 9):
        shuffled = claims_df(spark, rows).repartition(n).orderBy(F.rand(n)).withColumn("evidence", F.reverse("evidence"))
        assert {(r.case_id, r.verdict_hash) for r in A.adjudicate(cases, shuffled, pol, "k").collect()} == base


def test_one_case_with_a_third_of_all_claims(spark):
    df = spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('c', id % 500)) as case_id", "cast(id as int) as claim_seq", "'ENCODED_COMMAND' as predicate",
        "concat('s', if(id % 2 = 0, 0, id)) as subject", "cast(null as string) as object", "0L as interval_start_ns", "1L as interval_end_ns",
        "array('e') as evidence", "'rule' as extractor_kind", "'x' as extractor_id", "'1' as extractor_version", "cast(null as bigint) as observed_value",
        "'supports' as polarity", "cast(null as string) as hypothesis_ref",
    )
    hot = A.adjudicate(cases_df(spark, ["hot"]), df, policy(spark, INTRUSION), "k").first()
    assert hot.contributing_count == 20_000 and hot.total_score == 20_000 * 1500


def test_claim_id_covers_every_field_and_not_the_evidence_order(spark):
    base = claim("c", "P", evidence=["a", "b"])
    same = claim("c", "P", evidence=["b", "a"])
    split = claim("c", "P", subject="ab", object="c"), claim("c", "P", subject="a", object="bc")
    ids = [r.claim_id for r in I.with_claim_id(claims_df(spark, [base, same, *split])).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_policy_problems(spark):
    pol = policy(spark, {"A": ("nowhere", 1, [])}, [("execution", "moon", 1)], [("info", 5), ("odd", 5)])
    got = {(r.problem, r.detail) for r in A.check_policy(pol).collect()}
    assert got == {("not_ascending", "5"), ("unknown_severity", "odd"), ("unknown_tactic", "nowhere"), ("unknown_tactic", "moon")}


def test_blast_radius(spark):
    rows = [
        ("dc", [], ["dc01"], []),
        ("service", [], ["h"], ["dc01"]),
        ("six", ["p"] , ["h"] * 5, []),
        ("fifty", [], ["h"] * 51, []),
        ("five", ["p"], ["h"] * 4, []),
    ]
    actions = spark.createDataFrame(rows, "action_id string, principals array<string>, hosts array<string>, services array<string>")
    out = A.blast_radius(actions, A.action_targets(actions), spark.createDataFrame([("dc01",)], "asset string"))
    assert {r.action_id: r.risk_tier for r in out.collect()} == {"dc": "critical", "service": "low", "six": "medium", "fifty": "high", "five": "low"}


# ---------------------------------------------------------------- gate


def test_gate_reports_the_first_failing_check(spark):
    def row(seq, pred="ENCODED_COMMAND", ev=("ev1",), start=0, end=10):
        return ("c", seq, pred, "s", None, start, end, list(ev), "llm", "x", "1", None, "supports", None)

    rows = [row(0), row(1, ev=[], pred="NOPE"), row(2, ev=["ev1", "evX"], pred="NOPE"), row(3, pred="NOPE", start=5, end=1), row(4, start=5, end=1), row(5, end=2000), row(6, start=-1)]
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    windows = spark.createDataFrame([("c", 0, 1000)], "case_id string, window_start_ns bigint, window_end_ns bigint")
    good, bad = G.admit(claims_df(spark, rows), one(["ev1", "ev2"], "evidence_id"), one(["ENCODED_COMMAND"], "predicate"), windows)
    assert [r.claim_seq for r in good.collect()] == [0]
    assert {r.claim_seq: r.reason for r in bad.collect()} == {1: G.EMPTY, 2: G.UNKNOWN, 3: G.PREDICATE, 4: G.INVERTED, 5: G.OUTSIDE, 6: G.OUTSIDE}
    assert [r.unknown_evidence for r in bad.filter("claim_seq = 2").collect()] == [["evX"]]


def test_turns_that_do_not_parse_propose_nothing(spark):
    ok = '{"proposed_claims":[{"predicate":"P","subject":"s","interval_start_ns":1,"interval_end_ns":2,"evidence":["e"],"extractor":{"kind":"llm","id":"m","version":"1"}}],"tool_calls":[{"name":"t"}]}'
    bad = [ok.replace('"llm"', '"magic"'), ok.replace('"subject":"s",', ""), "[1]", "I think it is fine", ok.replace('"name":"t"', '"x":1'), ok.replace('"predicate":"P"', '"predicate":"P","polarity":"maybe"')]
    texts = [ok, "{}", *bad]
    out = G.parse_turns(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [(r.valid, len(r.proposed_claims), r.tool_calls) for r in out] == [(True, 1, 1), (True, 0, 0)] + [(False, 0, 0)] * len(bad)
    assert [r.narrative for r in out[2:]] == bad


def test_budget(spark):
    def run(calls, **kw):
        log = spark.createDataFrame([("i", t, c, 1, ["H1" if t % 2 else "H2"]) for t, c in enumerate(calls)], "investigation_id string, turn int, tool_calls bigint, claims bigint, hypotheses array<string>")
        r = G.rollup_investigations(log, **kw).first()
        return r.turns, r.claims, r.budget_exhausted, r.multi_hypothesis

    assert run([1, 1, 0, 5]) == (3, 3, False, True)
    assert run([20, 10, 1]) == (2, 2, True, True)
    assert run([24, 0]) == (2, 2, False, True)
    assert run([1] * 12) == (10, 10, True, True)
    assert run([0]) == (1, 1, False, False)


# ---------------------------------------------------------------- drift

WEIGHTS = {"AUTH_FAILED_BURST": ("credential-access", 2000, ["T1110"]), "CONNECTED_TO_INDICATOR": ("command-and-control", 0, ["T1071"]), "ENCODED_COMMAND": ("execution", 100, ["T1059"])}
SWEEP_TIERS = [("info", 0), ("low", 1000), ("medium", 2000), ("high", 3000)]


VERSION = "v1"


def corpus(spark, rows):
    return spark.createDataFrame([(VERSION, i, p, v, w, t) for i, (p, v, w, t) in enumerate(rows)], "corpus_version string, position int, predicate string, value string, weight bigint, techniques array<string>")


def closed_df(spark, claims, pol, ids):
    done = A.adjudicate(cases_df(spark, ids), claims, pol, "k")
    return done.withColumn("tenant_id", F.concat(F.lit("t"), F.length("case_id") % 3)).withColumn("completed_at_ns", F.lit(1))


def test_sweep_flips_exactly_the_hot_cases(spark):
    rows = []
    for kind, n in (("hot", 200), ("cold", 150), ("plain", 150)):
        for i in range(n):
            rows.append(claim(f"{kind}-{i}", "AUTH_FAILED_BURST"))
            if kind != "plain":
                rows.append(claim(f"{kind}-{i}", "CONNECTED_TO_INDICATOR", seq=1, object="bad" if kind == "hot" else "other"))
    claims, pol = claims_df(spark, rows), policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    closed = closed_df(spark, claims, pol, sorted({r[0] for r in rows}))
    feed = corpus(spark, [("CONNECTED_TO_INDICATOR", "bad", 5000, []), ("CONNECTED_TO_INDICATOR", "bad", 1, [])])
    drifts = D.drift_sweep(closed, claims, pol, "p", feed, VERSION, "k").collect()
    assert sorted(r.case_id for r in drifts) == sorted(f"hot-{i}" for i in range(200))
    assert {(r.old_disposition, r.new_disposition, r.responsible_count) for r in drifts} == {("suspicious", "malicious", 1)}
    assert {tuple(r.policy_deltas[0]) for r in drifts} == {("CONNECTED_TO_INDICATOR", 0, 5000, 1)}
    assert all(x.verdict_hash_matches for x in D.replay_pin(closed, A.claim_groups(claims), pol).collect())


def test_conflicts_are_reported_and_their_cases_left_alone(spark):
    rows = [
        claim("two", "CONNECTED_TO_INDICATOR", object="a"), claim("two", "CONNECTED_TO_INDICATOR", seq=1, object="b"),
        claim("alien", "NOT_PRICED", object="a"), claim("alien", "CONNECTED_TO_INDICATOR", seq=1, object="a"),
        claim("same", "CONNECTED_TO_INDICATOR", object="a"), claim("same", "CONNECTED_TO_INDICATOR", seq=1, object="c"),
        claim("null", "CONNECTED_TO_INDICATOR"),
    ]
    feed = corpus(spark, [("CONNECTED_TO_INDICATOR", "a", 5000, ["TA"]), ("CONNECTED_TO_INDICATOR", "b", 7000, []), ("NOT_PRICED", "a", 1, []), ("CONNECTED_TO_INDICATOR", "c", 5000, ["TC"])])
    pol = policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    matches = D.match_indicators(claims_df(spark, rows), feed, VERSION)
    got = {(r.case_id, r.problem) for r in D.reprice_conflicts(matches, pol.weights, "p").collect()}
    assert got == {("two", "conflicting_weights"), ("alien", "not_in_policy")}
    priced = D.reprice(matches, pol.weights, "p").collect()
    assert [(r.case_id, r.new_weight, r.new_techniques, r.tactic) for r in priced] == [("same", 5000, ["TC"], "command-and-control")]


def test_rederive_ignores_bookkeeping(spark):
    a = [claim("c", "AUTH_FAILED_BURST", evidence=["x", "y"]), claim("c", "ENCODED_COMMAND")]
    b = [claim("c", "AUTH_FAILED_BURST", evidence=["y", "x"], observed=9), claim("c", "CONNECTED_TO_INDICATOR")]
    pol = policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    closed = closed_df(spark, claims_df(spark, a), pol, ["c"])
    r = D.replay_rederive(closed, claims_df(spark, a), claims_df(spark, b), pol, "k").first()
    assert (r.added, r.removed, r.unchanged, r.disposition_changed) == (1, 1, 1, False)


# ---------------------------------------------------------------- bundles


def test_bundle_checks_catch_tampering(spark, tmp_path):
    rows = [claim(f"c{i}", "AUTH_FAILED_BURST", evidence=[f"e{i}", f"e{i + 1}", "z"]) for i in range(6)]
    claims, pol = claims_df(spark, rows), policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    cases = spark.createDataFrame(
        [(f"c{i}", f"t{i % 2}", i // 2, f"i{i}", "p", 1, 2, ("local", "m", "", None), (3, 2)) for i in range(6)],
        "case_id string, tenant_id string, closed_seq bigint, investigation_id string, policy_version string, started_at_ns bigint, completed_at_ns bigint, "
        "inference struct<provider:string,model_id:string,weights_digest:string,seed:bigint>, budget_consumed struct<tool_calls:bigint,turns:bigint>",
    )
    sealed = L.chain_manifests(A.close_cases(cases, claims, pol, "k")).drop("content_hash", "evidence_count")
    B.export_bundles(sealed, claims, pol, str(tmp_path / "good"))
    assert {(r.case_id, r.ok) for r in B.verify_bundles(spark, str(tmp_path / "good")).collect()} == {(f"c{i}", True) for i in range(6)}

    edited = claims.withColumn("polarity", F.when(F.col("case_id") == "c1", "refutes").otherwise(F.col("polarity")))
    manifests = sealed.withColumn("verdict_confidence", F.when(F.col("case_id") == "c2", 9999).otherwise(F.col("verdict_confidence")).cast("bigint"))
    manifests = manifests.withColumn("epoch_root", F.when(F.col("case_id") == "c3", F.lit("ab" * 32)).otherwise(F.col("epoch_root")))
    B.export_bundles(manifests, edited, pol, str(tmp_path / "bad"))
    out = {r.case_id: r for r in B.verify_bundles(spark, str(tmp_path / "bad")).collect()}
    assert [c for c, r in sorted(out.items()) if not r.ok] == ["c1", "c2", "c3"]
    assert not out["c1"].verdict_hash_matches and out["c1"].manifest_hash_valid
    assert not out["c2"].manifest_hash_valid and out["c2"].verdict_hash_matches
    assert not out["c3"].evidence_inclusion_valid and not out["c3"].manifest_hash_valid


def test_gate_rejects_missing_evidence_lists(spark):
    row = list(claim("c", "ENCODED_COMMAND"))
    row[7] = None
    one = lambda v, n: spark.createDataFrame([(v,)], f"{n} string")
    windows = spark.createDataFrame([("c", 0, 100)], "case_id string, window_start_ns bigint, window_end_ns bigint")
    claims = claims_df(spark, [tuple(row)])
    good, bad = G.admit(claims, one("e1", "evidence_id"), one("ENCODED_COMMAND", "predicate"), windows)
    assert good.count() == 0 and [r.reason for r in bad.collect()] == [G.EMPTY]
    row[7] = []
    assert I.with_claim_id(claims).first().claim_id == I.with_claim_id(claims_df(spark, [tuple(row)])).first().claim_id


def test_replay_uses_each_cases_kernel_version(spark):
    rows = [claim(f"c{i}", "AUTH_FAILED_BURST") for i in range(4)]
    claims, pol = claims_df(spark, rows), policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    cases = cases_df(spark, [f"c{i}" for i in range(4)]).withColumn("kernel_version", F.concat(F.lit("k"), F.length("case_id") + F.expr("cast(substr(case_id, 2) as int) % 2")))
    closed = A.adjudicate(cases, claims, pol)
    assert closed.select("kernel_version").distinct().count() == 2
    assert all(r.verdict_hash_matches for r in D.replay_pin(closed, A.claim_groups(claims), pol).collect())
    other = A.adjudicate(cases, claims, pol, "k9")
    assert not any(r.verdict_hash_matches for r in D.replay_pin(other.withColumn("kernel_version", F.lit("k8")), A.claim_groups(claims), pol).collect())


def test_sweep_reads_one_corpus_version_and_none_finds_nothing(spark):
    rows = [claim("c", "AUTH_FAILED_BURST"), claim("c", "CONNECTED_TO_INDICATOR", seq=1, object="bad")]
    claims, pol = claims_df(spark, rows), policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    closed = closed_df(spark, claims, pol, ["c"])
    feed = corpus(spark, [("CONNECTED_TO_INDICATOR", "bad", 5000, [])])
    both = feed.union(feed.withColumn("corpus_version", F.lit("v2")).withColumn("weight", F.lit(1).cast("bigint")))
    found = D.drift_sweep(closed, claims, pol, "p", both, VERSION, "k").collect()
    assert [(r.responsible_count, r.indicator_corpus_version) for r in found] == [(1, VERSION)]
    assert D.drift_sweep(closed, claims, pol, "p", feed.limit(0), VERSION, "k").collect() == []
    assert D.drift_sweep(closed, claims, pol, "p", feed, "v3", "k").collect() == []


def test_bundle_without_a_proof_fails(spark, tmp_path):
    rows = [claim(f"c{i}", "AUTH_FAILED_BURST", evidence=[f"e{i}", "z"]) for i in range(3)]
    claims, pol = claims_df(spark, rows), policy(spark, WEIGHTS, tiers=SWEEP_TIERS)
    cases = spark.createDataFrame(
        [(f"c{i}", "t", i, f"i{i}", "p", 1, 2, ("local", "m", "", None), (3, 2)) for i in range(3)],
        "case_id string, tenant_id string, closed_seq bigint, investigation_id string, policy_version string, started_at_ns bigint, completed_at_ns bigint, "
        "inference struct<provider:string,model_id:string,weights_digest:string,seed:bigint>, budget_consumed struct<tool_calls:bigint,turns:bigint>",
    )
    sealed = L.chain_manifests(A.close_cases(cases, claims, pol, "k")).drop("content_hash", "evidence_count")
    B.export_bundles(sealed, claims, pol, str(tmp_path / "b"))
    proofs = spark.read.json(str(tmp_path / "b" / "proofs"))
    lost = proofs.filter("not (case_id = 'c1' and evidence_id = 'z')")
    lost.write.partitionBy("bucket").json(str(tmp_path / "proofs"))
    (tmp_path / "b" / "proofs").rename(tmp_path / "b" / "all-proofs")
    (tmp_path / "proofs").rename(tmp_path / "b" / "proofs")
    out = {r.case_id: r for r in B.verify_bundles(spark, str(tmp_path / "b")).collect()}
    assert out["c0"].ok and out["c2"].ok and out["c1"].errors == ["cited evidence has no proof"]
