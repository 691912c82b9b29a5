"""Replay, drift and bundles (H, A9, A10) over closed orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import adjudicate as A
from ..operators import claimindex as X
from ..operators import drift as D
from ..operators import identity as I
from ..operators import ledger as L
from ..session import scratch_path, settle, stored
from ..sources import bundles as B
from .policies import KERNEL, sample_policy
from .registry import query
from .scoring import BASE, CHAINED, CORPUS, VERDICTS, closed_manifests, verdict_sql
from .views import CORPUS_VERSION, INDICATORS, cases, claims, indicators

CURRENT = "policy.v2"


def closed(spark, d):
    """Cases closed under their own policy version."""
    done = A.adjudicate(cases(spark, d), claims(spark, d), sample_policy(spark), KERNEL)
    meta = cases(spark, d).select("case_id", "tenant_id", "completed_at_ns", "closed_seq")
    return meta.join(done, "case_id")


TWO_KERNELS = "case when substr(case_id, 6)::bigint % 4 = 3 then '0.9.0' else '1.0.0' end"


def _two_kernels(spark, d):
    """Cases closed under their own policy and kernel version."""
    kernel = F.when(F.expr("cast(substr(case_id, 6) as bigint) % 4 = 3"), "0.9.0").otherwise(KERNEL)
    return A.adjudicate(cases(spark, d).withColumn("kernel_version", kernel), claims(spark, d), sample_policy(spark))


@query(
    "h01_replay_pin",
    f"""with {BASE}, {verdict_sql('', 'cases', 'claims', kernel=TWO_KERNELS)},
        edited as (select * replace (case when l_orderkey % 8 = 1 and claim_seq = 1 then 'supports' else polarity end as polarity,
          case when l_orderkey % 8 = 1 and claim_seq = 1 then claim_id || '!' else claim_id end as claim_id) from claims),
        {verdict_sql('r_', 'cases', 'edited', kernel=TWO_KERNELS)}
        select v.case_id, v.verdict_hash as original_verdict_hash, r.verdict_hash = v.verdict_hash as verdict_hash_matches from verdicts v join r_verdicts r using (case_id)""",
)
def replay_pin(spark, d):
    """Scored again from the stored claims in another physical order; one claim in some cases was changed meanwhile."""
    stored = I.with_claim_id(claims(spark, d))
    tampered = F.expr("l_orderkey % 8 = 1 and claim_seq = 1")
    stored = stored.withColumn("polarity", F.when(tampered, "supports").otherwise(F.col("polarity")))
    stored = stored.withColumn("claim_id", F.when(tampered, F.concat("claim_id", F.lit("!"))).otherwise(F.col("claim_id")))
    shuffled = stored.repartition(5, "subject").sortWithinPartitions(F.desc("subject"))
    out = D.replay_pin(_two_kernels(spark, d), A.claim_groups(shuffled), sample_policy(spark))
    return out.drop("replayed_verdict_hash")


REDERIVED = """rederived as (
    select * replace (case when l_orderkey % 4 = 0 and claim_seq = 2 then 'ENCODED_COMMAND' else predicate end as predicate,
       case when claim_seq = 3 then 'H9' else hypothesis_ref end as hypothesis_ref) from claims where not (l_orderkey % 5 = 0 and claim_seq = 1))"""


def _rederived(spark, d):
    c = claims(spark, d).filter("not (l_orderkey % 5 = 0 and claim_seq = 1)")
    pred = F.when(F.expr("l_orderkey % 4 = 0 and claim_seq = 2"), F.lit("ENCODED_COMMAND")).otherwise(F.col("predicate"))
    return c.withColumn("predicate", pred).withColumn("hypothesis_ref", F.when(F.col("claim_seq") == 3, "H9").otherwise(F.col("hypothesis_ref")))


ASSERT = "case_id || '~' || predicate || '~' || subject || '~' || coalesce(object, '-') || '~' || interval_start_ns || '~' || interval_end_ns || '~' || array_to_string(list_sort(evidence), ',') || '~' || polarity"


@query(
    "h02_rederive",
    f"""with {VERDICTS}, {REDERIVED}, {verdict_sql('r_', 'cases', 'rederived')},
        a as (select distinct case_id, {ASSERT} as k from claims), b as (select distinct case_id, {ASSERT} as k from rederived),
        j as (select coalesce(a.case_id, b.case_id) as case_id, a.k is not null as ina, b.k is not null as inb from a full join b on a.k = b.k),
        c as (select case_id, count_if(not ina)::bigint as added, count_if(not inb)::bigint as removed, count_if(ina and inb)::bigint as unchanged from j group by all)
        select v.case_id, v.disposition as original_disposition, r.disposition as rederived_disposition, coalesce(added, 0) as added, coalesce(removed, 0) as removed,
          coalesce(unchanged, 0) as unchanged, v.disposition <> r.disposition as disposition_changed
        from verdicts v join r_verdicts r using (case_id) left join c using (case_id)""",
)
def rederive(spark, d):
    return D.replay_rederive(closed(spark, d), claims(spark, d), _rederived(spark, d), sample_policy(spark), KERNEL)


MATCH = f"""{INDICATORS},
  entries as (select corpus_version, predicate, value, min_by(weight, position) as weight, min_by(techniques, position) as techniques from indicators group by all),
  matches as (select c.case_id, c.claim_id, c.claim_seq, c.predicate, c.object as indicator_value, e.weight, e.techniques, e.corpus_version
    from claims c join entries e on e.predicate = c.predicate and e.value = c.object)"""


@query("h03_indicator_match", f"with {BASE}, {MATCH} select case_id, claim_id, predicate, indicator_value, weight::bigint as weight, array_to_string(techniques, ',') as techniques from matches")
def indicator_match(spark, d):
    m = D.match_indicators(claims(spark, d), indicators(spark, d), CORPUS_VERSION)
    return m.select("case_id", "claim_id", "predicate", "indicator_value", "weight", F.array_join("techniques", ",").alias("techniques"))


REPRICE = f"""{MATCH},
  conflicts as (select case_id, predicate, 'conflicting_weights' as problem from matches group by all having count(distinct weight) > 1
    union all select distinct case_id, predicate, 'not_in_policy' from matches where predicate not in (select predicate from weights where policy_version = '{CURRENT}')),
  overlay as (select m.case_id, m.predicate, max(m.weight) as new_weight, max_by(m.techniques, (claim_seq, claim_id)) as new_techniques, count(*) as matches
    from matches m where m.case_id not in (select case_id from conflicts) group by all)"""


@query(
    "h04_reprice",
    f"""with {BASE}, {REPRICE} select case_id, o.predicate, w.tactic, w.weight::bigint as old_weight, new_weight::bigint as new_weight,
        array_to_string(case when len(new_techniques) > 0 then new_techniques else w.techniques end, ',') as techniques, o.matches::bigint as matches
        from overlay o join weights w on w.policy_version = '{CURRENT}' and w.predicate = o.predicate""",
)
def reprice(spark, d):
    m = D.match_indicators(claims(spark, d), indicators(spark, d), CORPUS_VERSION)
    out = D.reprice(m, sample_policy(spark).weights, CURRENT)
    return out.withColumn("techniques", F.array_join("new_techniques", ",")).drop("new_techniques")


@query("h05_reprice_conflicts", f"with {BASE}, {REPRICE} select * from conflicts")
def reprice_conflicts(spark, d):
    m = D.match_indicators(claims(spark, d), indicators(spark, d), CORPUS_VERSION)
    return D.reprice_conflicts(m, sample_policy(spark).weights, CURRENT)


SWEEP = f"""{VERDICTS}, {REPRICE},
  again as (select distinct case_id, '{CURRENT}' as policy_version from overlay),
  {verdict_sql('d_', 'again', 'claims', 'coalesce(o.new_weight, w.weight)', 'case when len(o.new_techniques) > 0 then o.new_techniques else w.techniques end',
               'left join overlay o on o.case_id = g.case_id and o.predicate = g.predicate')},
  drifts as (select c.tenant_id, v.case_id, v.severity as old_severity, d.severity as new_severity, v.disposition as old_disposition, d.disposition as new_disposition,
      v.verdict_hash as old_verdict_hash, d.verdict_hash as new_verdict_hash
    from verdicts v join d_verdicts d using (case_id) join cases c using (case_id) where v.severity <> d.severity or v.disposition <> d.disposition),
  {CORPUS.replace(INDICATORS + ',', '')}"""


def _drifts(spark, d):
    return D.drift_sweep(closed(spark, d), claims(spark, d), sample_policy(spark), CURRENT, indicators(spark, d), CORPUS_VERSION, KERNEL)


DRIFT = ["tenant_id", "case_id", "old_severity", "new_severity", "old_disposition", "new_disposition", "old_verdict_hash", "new_verdict_hash"]


@query("h06_drift_sweep", f"with {SWEEP} select * from drifts")
def drift_sweep(spark, d):
    return _drifts(spark, d).select(*DRIFT)


@query(
    "h06_incremental_sweep",
    f"""with {SWEEP}, delta as (select predicate, value from indicators where position % 20 in (0, 7)
          union select predicate, 'supplier:' || substr(value, 6) from indicators where position % 20 = 1 and value like 'idle:%'),
        touched as (select distinct case_id from claims c join delta e on e.predicate = c.predicate and e.value = c.object)
        select drifts.*, case_id not in (select case_id from touched) as carried from drifts""",
)
def incremental_sweep(spark, d):
    """A twentieth of the entries is new, as many have another weight, and some were taken out of the version before."""
    now = indicators(spark, d).filter(F.col("corpus_version") == CORPUS_VERSION)
    kind = F.col("position") % 20
    gone = (kind == 1) & F.col("value").startswith("idle:")
    then = (
        now.filter(kind != 0)
        .withColumn("weight", F.when(kind == 7, F.col("weight") + 4000).otherwise(F.col("weight")))
        .withColumn("value", F.when(gone, F.concat(F.lit("supplier:"), F.substring("value", 6, 20))).otherwise(F.col("value")))
        .withColumn("corpus_version", F.lit("corpus.before"))
    )
    corpus = now.unionByName(then)
    done, held = stored(closed(spark, d), "closed"), sample_policy(spark)
    index = X.ClaimIndex(spark, scratch_path(spark, f"claim-index-{uuid.uuid4().hex}"), buckets=16)
    index.append(claims(spark, d), 0)
    before = D.drift_sweep(done, claims(spark, d), held, CURRENT, corpus, "corpus.before", KERNEL)
    out = X.incremental_sweep(done, index, held, CURRENT, corpus, "corpus.before", CORPUS_VERSION, before, KERNEL)
    return out.select(*DRIFT, "carried")


@query(
    "h07_drift_attribution",
    f"""with {SWEEP}, dl as (select case_id, string_agg(predicate || ':' || (select weight from weights w where w.policy_version = '{CURRENT}' and w.predicate = overlay.predicate) || '>' || new_weight || 'x' || matches, ',' order by predicate) as deltas,
          sum(matches)::bigint as responsible_count from overlay group by case_id)
        select case_id, deltas, responsible_count, 'corpus.1' as indicator_corpus_version, (select sha256(corpus_version || '|' || digest) from corp where corpus_version = 'corpus.1') as indicator_corpus_hash
        from drifts join dl using (case_id)""",
)
def drift_attribution(spark, d):
    one = F.transform("policy_deltas", lambda p: F.concat(p["predicate"], F.lit(":"), p["old_weight"], F.lit(">"), p["new_weight"], F.lit("x"), p["matches"]))
    return _drifts(spark, d).select(
        "case_id", F.array_join(one, ",").alias("deltas"), "responsible_count", "indicator_corpus_version", "indicator_corpus_hash"
    )


@query(
    "h07_responsible_claims",
    f"""with {SWEEP} select m.case_id, m.claim_id, m.predicate, m.indicator_value, w.weight::bigint as old_weight, m.weight::bigint as new_weight
        from matches m join drifts using (case_id) join weights w on w.policy_version = '{CURRENT}' and w.predicate = m.predicate""",
)
def responsible_claims(spark, d):
    return D.responsible_claims(_drifts(spark, d), claims(spark, d), indicators(spark, d), CORPUS_VERSION, sample_policy(spark).weights, CURRENT)


def _attrib_sql(name, version, weight):
    return f"""{name} as (select c.case_id, c.claim_id, c.predicate, ({weight} * case when polarity = 'refutes' then -1 else 1 end)::bigint as w
      from (select distinct case_id, claim_id, predicate, polarity from claims where len(evidence) > 0) c join verdicts v using (case_id)
      join weights w on w.policy_version = {version} and w.predicate = c.predicate)"""


@query(
    "h08_attribution_diff",
    f"""with {VERDICTS}, {_attrib_sql('a', 'v.policy_version', 'w.weight')}, {_attrib_sql('b', "'policy.v2'", 'w.weight')}
        select coalesce(a.case_id, b.case_id) as case_id, coalesce(a.claim_id, b.claim_id) as claim_id, coalesce(a.predicate, b.predicate) as predicate, a.w as weight_before, b.w as weight_after
        from a full join b on a.case_id = b.case_id and a.claim_id = b.claim_id""",
)
def attribution_diff(spark, d):
    """Every case attributed under the policy version it was closed under and under the second one."""
    policy = sample_policy(spark)
    first = cases(spark, d)
    second = first.withColumn("policy_version", F.lit("policy.v2"))
    stored = closed(spark, d)
    recomputed = A.score_groups(first.select("case_id", "policy_version"), A.claim_groups(claims(spark, d)), policy, KERNEL)
    named = I.with_claim_id(claims(spark, d))
    return D.attribution_diff(A.contributing_claims(first, named, policy), A.contributing_claims(second, named, policy), stored, recomputed)


@query(
    "h09_reopened",
    f"""with {SWEEP} select v.case_id, v.severity, d.case_id is not null as is_reopened, d.new_severity from verdicts v left join drifts d using (case_id)""",
)
def reopened(spark, d):
    """Two sweeps are recorded; the later one counts, and the closed rows do not change."""
    found = _drifts(spark, d).select("case_id", "new_severity")
    log = found.withColumn("new_severity", F.lit("stale")).withColumn("swept_at", F.lit(1)).unionByName(found.withColumn("swept_at", F.lit(2)))
    out = D.reopened(closed(spark, d), log)
    return out.select("case_id", "severity", "is_reopened", F.col("drift.new_severity").alias("new_severity"))


@query("h10_closed_in_window", f"with {BASE} select case_id, tenant_id, completed_at_ns from cases where completed_at_ns >= 852076800000000000 and completed_at_ns < 883612800000000000")
def closed_in_window(spark, d):
    rows = cases(spark, d).select("case_id", "tenant_id", "completed_at_ns")
    return D.closed_cases(rows, 852_076_800_000_000_000, 883_612_800_000_000_000)


@query(
    "h11_sweep_summary",
    f"with {SWEEP} select (select count(*) from verdicts)::bigint as cases_swept, (select count(*) from drifts)::bigint as drifted, true as measured",
)
def sweep_summary(spark, d):
    """The sweep times itself; the time differs from run to run, so only its relation to the rate is compared."""
    args = (claims(spark, d), sample_policy(spark), CURRENT, indicators(spark, d), CORPUS_VERSION, KERNEL)
    out = D.measured_sweep(settle(closed(spark, d)), *args)[1]
    rate = F.abs(F.col("cases_per_second") * F.col("elapsed_seconds") / F.col("cases_swept") - 1) < 1e-9
    return out.select("cases_swept", "drifted", ((F.col("elapsed_seconds") > 0) & rate).alias("measured"))


def _exported(spark, d, before=lambda closed: closed, after=lambda sealed: sealed):
    """A bundle folder; cases can be changed before they are sealed and after."""
    path = scratch_path(spark, f"bundles-{uuid.uuid4().hex}")
    sealed = stored(L.chain_manifests(before(closed_manifests(spark, d))).drop("content_hash", "evidence_count"), "sealed")
    B.export_bundles(after(sealed), claims(spark, d), sample_policy(spark), path)
    return path


@query(
    "a09_export_bundles",
    f"""with {CHAINED}, n as (select case_id, count(*) as claims from claims group by all)
        select case_id, coalesce(n.claims, 0)::bigint as claims, m.evidence_count as proofs, coalesce(n.claims, 0) = m.claim_count as claims_counted, m.epoch_root, m.claim_set_hash,
          m.verdict_hash, w.hash as manifest_hash, (select count(*) from weights)::bigint as priced
        from manifests m join walk w using (tenant_id, closed_seq) left join n using (case_id)""",
)
def export_bundles(spark, d):
    """All four tables as they are read back: sealed manifests, claims, a proof for each cited id, the policy's weights."""
    path = _exported(spark, d)
    held = spark.read.schema(B.CLAIM_SCHEMA).json(f"{path}/claims").groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"))
    proofs = spark.read.schema(B.PROOF_SCHEMA).json(f"{path}/proofs").groupBy("case_id", F.col("root").alias("epoch_root")).agg(F.count(F.lit(1)).alias("proofs"))
    priced = spark.read.schema(B.POLICY_SCHEMAS["weights"]).json(f"{path}/policy/weights").agg(F.count(F.lit(1)).alias("priced"))
    out = spark.read.schema(B.MANIFEST_SCHEMA).json(f"{path}/manifests").join(held, "case_id", "left").join(proofs, ["case_id", "epoch_root"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("claims", "proofs")}).withColumn("claims_counted", F.col("claims") == F.col("claim_count"))
    fields = ["case_id", "claims", "proofs", "claims_counted", "epoch_root", "claim_set_hash", "verdict_hash", "manifest_hash"]
    return out.select(*fields).crossJoin(priced)  # priced is one row


@query("a10_verify_bundles", f"""with {BASE} select tenant_id, case_id, o_orderkey % 11 not in (3, 4) as manifest_hash_valid, o_orderkey % 11 <> 5 as verdict_hash_matches,
    o_orderkey % 11 <> 4 or case_id not in (select case_id from claims where len(evidence) > 0) as evidence_inclusion_valid, o_orderkey % 11 not in (3, 4, 5) as ok from cases""")
def verify_bundles(spark, d):
    """Some cases are sealed with a verdict hash that is not their claims'; their manifests are sound in themselves.

    After sealing, some manifests get another confidence and some another evidence root.
    """
    key = F.substring("case_id", 6, 20).cast("bigint") % 11

    def misjudge(closed):
        return closed.withColumn("verdict_hash", F.when(key == 5, F.repeat(F.lit("cd"), F.lit(32))).otherwise(F.col("verdict_hash")))

    def tamper(sealed):
        confidence = F.when(key == 3, F.col("verdict_confidence") + 1).otherwise(F.col("verdict_confidence"))
        root = F.when(key == 4, F.repeat(F.lit("ab"), F.lit(32))).otherwise(F.col("epoch_root"))
        return sealed.withColumn("verdict_confidence", confidence).withColumn("epoch_root", root)

    return B.verify_bundles(spark, _exported(spark, d, misjudge, tamper)).drop("errors")
