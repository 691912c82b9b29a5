"""Claim identities, the gate, adjudication and case closing (B, F, G) over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import KNOWN_PREDICATES, TACTICS
from ..operators import adjudicate as A
from ..operators import gate as G
from ..operators import identity as I
from ..operators import ledger as L
from ..session import stored
from .ledgering import digest_sql, tree_sql
from .policies import KERNEL, POLICY, sample_policy, values
from .registry import query
from .views import CASES, CLAIMS, INDICATORS, cases, claims, indicators, table

TACTIC_LIST = "[" + ", ".join(f"'{t}'" for t in TACTICS) + "]"


def verdict_sql(p: str, cases_cte: str, claims_cte: str, weight_expr: str = "w.weight", tech_expr: str = "w.techniques", extra: str = "", kernel: str = f"'{KERNEL}'") -> str:
    """CTEs ending in ``{p}verdicts``; ``extra`` may join an overlay ``o`` on case and predicate."""
    return f"""
  {p}items as (select case_id, predicate, polarity, claim_id as item from {claims_cte} where len(evidence) > 0),
  {digest_sql(p + 'items', ['case_id', 'predicate', 'polarity'], p + 'grp', True)},
  {p}priced as (select g.case_id, c.policy_version, g.predicate, g.polarity, g.n, g.digest, w.tactic, list_position({TACTIC_LIST}, w.tactic) - 1 as ord,
      {weight_expr} * case when g.polarity = 'refutes' then -1 else 1 end as aw, {tech_expr} as techniques
    from {p}grp g join {cases_cte} c using (case_id) join weights w on w.policy_version = c.policy_version and w.predicate = g.predicate {extra}),
  {p}tac as (select case_id, policy_version, tactic, ord, sum(aw * n)::bigint as score from {p}priced group by all),
  {p}bonus as (select a.case_id, sum(k.bonus)::bigint as bonus from {p}tac a join {p}tac b on b.case_id = a.case_id and b.ord = a.ord + 1
    join chains k on k.policy_version = a.policy_version and k.from_tactic = a.tactic and k.to_tactic = b.tactic group by a.case_id),
  {p}tech as (select case_id, list_sort(list_distinct(flatten(list(techniques)))) as techs from {p}priced group by case_id),
  {p}contrib as (select case_id, sum(n)::bigint as cnt, sha256(string_agg(predicate || '|' || polarity || '|' || aw || '|' || n || '|' || digest, ',' order by predicate || '|' || polarity || '|' || aw || '|' || n || '|' || digest)) as dig from {p}priced group by case_id),
  {p}total as (select t.case_id, t.policy_version, sum(score)::bigint as base, coalesce(max(bonus), 0)::bigint as bonus, (sum(score) + coalesce(max(bonus), 0))::bigint as total
    from {p}tac t left join {p}bonus using (case_id) group by t.case_id, t.policy_version),
  {p}sev as (select t.case_id, coalesce(max_by(severity, threshold) filter (threshold <= total), min_by(severity, threshold)) as severity
    from {p}total t join tiers using (policy_version) group by t.case_id),
  {p}v0 as (select c.case_id, c.policy_version, coalesce(s.severity, 'info') as severity,
      case when s.severity is null then 'incomplete' when s.severity in ('info', 'low') then 'benign' when s.severity = 'medium' then 'suspicious' else 'malicious' end as disposition,
      case when t.total is null then 0 else greatest(0, least(10000, t.total)) end::bigint as confidence, t.total as total_score, t.base as base_score, t.bonus, coalesce(x.techs, []) as techs,
      coalesce(k.cnt, 0)::bigint as contributing_count, coalesce(k.dig, repeat('00', 32)) as contributing_digest
    from {cases_cte} c left join {p}total t using (case_id) left join {p}sev s using (case_id) left join {p}tech x using (case_id) left join {p}contrib k using (case_id)),
  {p}verdicts as (select *, sha256('{{"severity":"' || severity || '","confidence":' || confidence || ',"disposition":"' || disposition || '","attack_techniques":['
      || case when len(techs) = 0 then '' else '"' || array_to_string(techs, '","') || '"' end || '],"contributing_count":' || contributing_count || ',"contributing_digest":"' || contributing_digest
      || '","policy_version":"' || policy_version || '","kernel_version":"' || {kernel} || '"}}') as verdict_hash from {p}v0)"""


BASE = f"{CASES}, {CLAIMS}, {POLICY}"
VERDICTS = f"{BASE}, {verdict_sql('', 'cases', 'claims')}"


@query("b02_claim_id", f"with {CLAIMS} select case_id, claim_seq, claim_id from claims")
def claim_ids(spark, d):
    return I.with_claim_id(claims(spark, d)).select("case_id", "claim_seq", "claim_id")


SETS = f"{CLAIMS}, cs as (select case_id, claim_id as item from claims), {digest_sql('cs', ['case_id'], 'sets', True)}"


@query("b03_claim_set_hash", f"with {SETS} select case_id, digest as claim_set_hash, n as claim_count from sets")
def claim_set_hashes(spark, d):
    return I.claim_set_hash(claims(spark, d))


CORPUS = f"""{INDICATORS},
  ent as (select corpus_version, '{{"predicate":"' || predicate || '","value":"' || value || '","weight":' || weight || ',"techniques":['
    || case when len(techniques) = 0 then '' else '"' || array_to_string(list_sort(techniques), '","') || '"' end || ']}}' as item from all_indicators),
  {digest_sql('ent', ['corpus_version'], 'corp')}"""


@query("b04_corpus_hash", f"with {CORPUS} select corpus_version, n as entries, sha256(corpus_version || '|' || digest) as corpus_hash from corp")
def corpus_hashes(spark, d):
    return I.corpus_hash(indicators(spark, d))


@query("b05_verdict_hash", f"with {VERDICTS} select case_id, verdict_hash from verdicts")
def verdict_hashes(spark, d):
    return _verdicts(spark, d).select("case_id", "verdict_hash")


def _verdicts(spark, d):
    return A.adjudicate(cases(spark, d), claims(spark, d), sample_policy(spark), KERNEL)


def _priced(spark, d):
    groups = A.claim_groups(claims(spark, d)).join(cases(spark, d).select("case_id", "policy_version"), "case_id")
    return A.price(groups, sample_policy(spark).weights)


@query("g01_price", f"with {VERDICTS} select case_id, predicate, polarity, tactic, aw::bigint as attributed_weight, n as claims, (aw * n)::bigint as contribution from priced")
def price(spark, d):
    return _priced(spark, d).select(
        "case_id", "predicate", "polarity", "tactic", "attributed_weight", "claims", F.col("contribution").cast("bigint").alias("contribution")
    )


@query("g02_tactic_scores", f"with {VERDICTS} select case_id, policy_version, tactic, score from tac")
def tactic_scores(spark, d):
    return A.tactic_scores(_priced(spark, d))


@query("g03_chain_bonus", f"with {VERDICTS} select t.case_id, t.policy_version, b.bonus from (select distinct case_id, policy_version from tac) t join bonus b using (case_id)")
def chain_bonus(spark, d):
    return A.chain_bonus(A.tactic_scores(_priced(spark, d)), sample_policy(spark).chains)


@query(
    "g04_classify",
    f"""with {VERDICTS} select case_id, policy_version, base_score as total_score, sev2 as severity from (
        select v.case_id, v.policy_version, v.base_score, coalesce(max_by(t.severity, t.threshold) filter (t.threshold <= v.base_score), min_by(t.severity, t.threshold)) as sev2
        from verdicts v join tiers t using (policy_version) where v.base_score is not null group by all)""",
)
def classify(spark, d):
    scores = A.tactic_scores(_priced(spark, d)).groupBy("case_id", "policy_version").agg(F.sum("score").alias("total_score"))
    return A.classify(scores, sample_policy(spark).thresholds).select("case_id", "policy_version", "total_score", "severity")


@query("g05_disposition", f"with {VERDICTS} select disposition, severity, count(*)::bigint as cases from verdicts group by all")
def dispositions(spark, d):
    return _verdicts(spark, d).groupBy("disposition", "severity").agg(F.count(F.lit(1)).alias("cases"))


@query("g06_incomplete", f"with {VERDICTS} select case_id, severity, confidence from verdicts where disposition = 'incomplete'")
def incomplete(spark, d):
    return _verdicts(spark, d).filter("disposition = 'incomplete'").select("case_id", "severity", "confidence")


@query("g07_confidence", f"with {VERDICTS} select case_id, total_score, confidence from verdicts")
def confidences(spark, d):
    return _verdicts(spark, d).select("case_id", "total_score", "confidence")


@query(
    "g08_contributing_claims",
    f"""with {BASE} select c.case_id, claim_id, c.predicate, (w.weight * case when polarity = 'refutes' then -1 else 1 end)::bigint as attributed_weight, count(*)::bigint as copies
        from claims c join cases k using (case_id) join weights w on w.policy_version = k.policy_version and w.predicate = c.predicate where len(evidence) > 0 group by all""",
)
def contributing(spark, d):
    return A.contributing_claims(cases(spark, d), claims(spark, d), sample_policy(spark))


@query("g08_techniques", f"with {VERDICTS} select case_id, array_to_string(techs, ',') as techniques, contributing_count from verdicts")
def techniques(spark, d):
    return _verdicts(spark, d).select("case_id", F.array_join("attack_techniques", ",").alias("techniques"), "contributing_count")


VERDICT_COLS = ["case_id", "policy_version", "severity", "disposition", "confidence", "total_score", "bonus", "contributing_count", "verdict_hash"]


@query("g09_adjudicate", f"with {VERDICTS} select {', '.join(VERDICT_COLS)} from verdicts")
def adjudicate(spark, d):
    return _verdicts(spark, d).select(*VERDICT_COLS)


@query(
    "g10_policy_check",
    """with p as (select 'nation-' || n_nationkey as policy_version, n_nationkey as k, n_name from nation),
       t as (select policy_version, 0 as position, 0 as threshold, 'info' as severity from p where k % 5 <> 0
         union all select policy_version, 1, case when k % 3 = 0 then 0 else 100 end, case when k % 7 = 1 then n_name else 'high' end from p where k % 5 <> 0)
       select policy_version, 'no_thresholds' as problem, '' as detail from p where k % 5 = 0
       union all select policy_version, 'not_ascending', '0' from p where k % 5 <> 0 and k % 3 = 0
       union all select policy_version, 'unknown_severity', n_name from p where k % 5 <> 0 and k % 7 = 1
       union all select policy_version, 'unknown_tactic', n_name from p where k % 4 = 0""",
)
def policy_check(spark, d):
    """One candidate policy per nation, with the defects its key decides."""
    n = table(spark, d, "nation").selectExpr("concat('nation-', n_nationkey) as policy_version", "n_nationkey as k", "n_name")
    weights = n.selectExpr("policy_version", "'P' as predicate", "if(k % 4 = 0, n_name, 'impact') as tactic", "1L as weight", "array('T1') as techniques")
    tiers = n.filter("k % 5 <> 0").selectExpr(
        "policy_version",
        "inline(array(struct(0 as position, 0L as threshold, 'info' as severity), struct(1 as position, if(k % 3 = 0, 0L, 100L) as threshold, if(k % 7 = 1, n_name, 'high') as severity)))",
    )
    chains = n.selectExpr("policy_version", "'execution' as from_tactic", "'persistence' as to_tactic", "1L as bonus")
    return A.check_policy(A.Policy(weights, chains, tiers))


@query(
    "g11_blast_radius",
    """with a as (select o_orderkey as action_id, o_custkey, count(*) as n, max((l_partkey % 50 = 0)::int) as hit
         from orders join lineitem on l_orderkey = o_orderkey group by all)
       select action_id, 1::bigint as principal_count, n::bigint as host_count, (n * 9)::bigint as dependent_service_count, hit = 1 or o_custkey % 100 = 0 as touches_critical_asset,
         case when hit = 1 or o_custkey % 100 = 0 then 'critical' when 1 + n * 10 > 50 then 'high' when 1 + n * 10 > 5 then 'medium' else 'low' end as risk_tier from a""",
)
def blast_radius(spark, d):
    """An action per order: its customer is the principal, its parts are hosts, nine services per part."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("action_id"), "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.concat(F.lit("part-"), "l_partkey").alias("target"))
    actions = orders.join(li.select("action_id"), "action_id", "left_semi")
    hosts = li.withColumn("kind", F.lit("host"))
    services = li.select("action_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("i"), "target").select(
        "action_id", F.concat_ws("/", "target", F.col("i").cast("string")).alias("target"), F.lit("service").alias("kind")
    )
    people = actions.select("action_id", F.concat(F.lit("cust-"), "o_custkey").alias("target"), F.lit("principal").alias("kind"))
    parts = table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("part-"), "p_partkey").alias("asset"))
    custs = table(spark, d, "customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("cust-"), "c_custkey").alias("asset"))
    targets = people.unionByName(hosts).unionByName(services)
    out = A.blast_radius(actions.select("action_id"), targets, parts.unionByName(custs))
    return out.select("action_id", "principal_count", "host_count", "dependent_service_count", "touches_critical_asset", "risk_tier")


# --------------------------------------------------------------------------- closing, manifests, chains

CLOSED = f"""{VERDICTS},
  cset as (select case_id, claim_id as item from claims), {digest_sql('cset', ['case_id'], 'csets', True)},
  cited as (select case_id, unnest(evidence) as id from claims), {tree_sql('cited', 'case_id', 6)},
  closed as (select k.*, coalesce(r.root, '') as epoch_root, coalesce(s.digest, repeat('00', 32)) as claim_set_hash, coalesce(s.n, 0) as claim_count,
      v.severity, v.confidence, v.disposition, v.verdict_hash, coalesce(z.n, 0)::bigint as evidence_count
    from cases k join verdicts v using (case_id) left join csets s using (case_id) left join roots r using (case_id) left join sizes z using (case_id)),
  manifests as (select *, sha256('{{"investigation_id":"' || investigation_id || '","tenant_id":"' || tenant_id || '","case_id":"' || case_id || '","epoch_root":"' || epoch_root
      || '","epoch_id":1,"claim_set_hash":"' || claim_set_hash || '","claim_count":' || claim_count || ',"inference":' || inference || ',"policy_version":"' || policy_version
      || '","kernel_version":"{KERNEL}","verdict_severity":"' || severity || '","verdict_confidence":' || confidence || ',"verdict_disposition":"' || disposition
      || '","verdict_hash":"' || verdict_hash || '","budget_consumed":' || budget_consumed || ',"started_at_ns":' || started_at_ns || ',"completed_at_ns":' || completed_at_ns || '}}') as content_hash
    from closed)"""

ZERO = "repeat('00', 32)"
# walks each tenant's chain in order; the anchor moves on where a segment of 256 begins
CHAINED = f"""recursive {CLOSED},
  walk as (
    select tenant_id, closed_seq, {ZERO} as prev, sha256(unhex({ZERO}) || unhex({ZERO}) || unhex(content_hash)) as hash,
      sha256(unhex({ZERO}) || unhex(content_hash)) as fold, {ZERO} as anchor, true as opens from manifests where closed_seq = 0
    union all
    select tenant_id, closed_seq, before, sha256(unhex(here) || unhex(case when first then {ZERO} else before end) || unhex(content_hash)),
      sha256(unhex(case when first then {ZERO} else fold end) || unhex(content_hash)), here, first from (
      select m.tenant_id, m.closed_seq, m.content_hash, m.closed_seq % 256 = 0 as first, w.hash as before, w.fold,
        case when m.closed_seq % 256 = 0 then sha256(unhex(w.anchor) || unhex(w.fold)) else w.anchor end as here
      from walk w join manifests m on m.tenant_id = w.tenant_id and m.closed_seq = w.closed_seq + 1))"""


def closed_manifests(spark, d):
    return A.close_cases(cases(spark, d), claims(spark, d), sample_policy(spark), KERNEL)


@query("g12_close_cases", f"with {CLOSED} select case_id, tenant_id, epoch_root, claim_set_hash, claim_count, evidence_count, severity as verdict_severity, verdict_hash from closed")
def close_cases(spark, d):
    return closed_manifests(spark, d).select(
        "case_id", "tenant_id", "epoch_root", "claim_set_hash", "claim_count", "evidence_count", "verdict_severity", "verdict_hash"
    )


@query("b06_manifest_hash", f"with {CLOSED} select case_id, sha256(unhex({ZERO}) || unhex({ZERO}) || unhex(content_hash)) as manifest_hash from manifests")
def manifest_hashes(spark, d):
    zero = F.repeat(F.lit("00"), F.lit(32))
    unlinked = closed_manifests(spark, d).withColumns({"prev_manifest_hash": zero, "anchor_hash": zero, "opens_segment": F.lit(True)})
    return I.with_manifest_hash(unlinked).select("case_id", "manifest_hash")


@query("c09_manifest_chain", f"with {CHAINED} select tenant_id, closed_seq, anchor as anchor_hash, opens as opens_segment, prev as prev_manifest_hash, hash as manifest_hash from walk")
def manifest_chain(spark, d):
    return L.chain_manifests(closed_manifests(spark, d)).select("tenant_id", "closed_seq", "anchor_hash", "opens_segment", "prev_manifest_hash", "manifest_hash")


@query(
    "c10_verify_chain",
    f"""with {CASES}, edited as (select *, coalesce(bool_or(o_orderkey % 101 = 3) over (partition by tenant_id order by closed_seq // 256 range between unbounded preceding and 1 preceding), false) as earlier from cases)
        select tenant_id, closed_seq, not (o_orderkey % 101 = 3) as hash_ok, not earlier as link_ok from edited""",
)
def verify_chain(spark, d):
    """After sealing, every case whose key is 3 modulo 101 gets another confidence.

    Exactly those rows' hashes fail, and the links of all later segments, whose anchors commit to all
    earlier contents.
    """
    sealed = stored(L.chain_manifests(closed_manifests(spark, d)), "sealed")
    hit = F.substring("case_id", 6, 20).cast("bigint") % 101 == 3
    edited = sealed.withColumn("verdict_confidence", F.when(hit, F.col("verdict_confidence") + 1).otherwise(F.col("verdict_confidence")))
    return L.verify_manifests(edited)


@query("c11_chain_tips", f"with {CHAINED} select tenant_id, max_by(hash, closed_seq) as tip, max(closed_seq)::bigint as tip_seq from walk group by tenant_id")
def chain_tips(spark, d):
    return L.chain_tips(L.chain_manifests(closed_manifests(spark, d)))


# --------------------------------------------------------------------------- the gate

REGISTRY = values([(p,) for p in KNOWN_PREDICATES], "registry", "predicate")

GATE = f"""{CASES}, {CLAIMS}, {REGISTRY},
  pinned as (select 'ev-' || s_suppkey as evidence_id from supplier union select 'ev-' || (p_partkey % 90) from part),
  windows as (select case_id, started_at_ns - 40000000000000000 as ws, started_at_ns + 100000000000000000 as we from cases),
  bent as (select *, case when claim_seq = 6 then interval_start_ns - 1 else interval_end_ns end as iend from claims),
  cited as (select distinct case_id, claim_id, unnest(evidence) as evidence_id from claims),
  missing as (select case_id, claim_id, string_agg(evidence_id, ',' order by evidence_id) as unknown from cited where evidence_id not in (select evidence_id from pinned) group by all),
  judged as (select b.case_id, b.claim_seq, b.predicate, b.iend, m.unknown, case
      when len(b.evidence) = 0 then '{G.EMPTY}' when m.unknown is not null then '{G.UNKNOWN}'
      when b.predicate not in (select predicate from registry) then '{G.PREDICATE}'
      when b.iend < b.interval_start_ns then '{G.INVERTED}'
      when b.interval_start_ns < w.ws or b.iend > w.we then '{G.OUTSIDE}' end as reason
    from bent b left join missing m using (case_id, claim_id) left join windows w using (case_id))"""


def _gate(spark, d):
    """Intervals of every sixth line are turned round after the claim id was taken."""
    proposed = I.with_claim_id(claims(spark, d))
    proposed = proposed.withColumn(
        "interval_end_ns", F.when(F.col("claim_seq") == 6, F.col("interval_start_ns") - 1).otherwise(F.col("interval_end_ns"))
    )
    pinned = (
        table(spark, d, "supplier").select(F.concat(F.lit("ev-"), "s_suppkey").alias("evidence_id"))
        .union(table(spark, d, "part").select(F.concat(F.lit("ev-"), F.col("p_partkey") % 90)))
        .distinct()
    )
    registry = spark.createDataFrame([(p,) for p in KNOWN_PREDICATES], "predicate string")
    windows = cases(spark, d).select(
        "case_id",
        (F.col("started_at_ns") - F.lit(40_000_000_000_000_000)).alias("window_start_ns"),
        (F.col("started_at_ns") + F.lit(100_000_000_000_000_000)).alias("window_end_ns"),
    )
    return G.admit(proposed, pinned, registry, windows)


@query("f01_admit", f"with {GATE} select case_id, claim_seq, predicate, iend::bigint as interval_end_ns from judged where reason is null")
def admit(spark, d):
    return _gate(spark, d)[0].select("case_id", "claim_seq", "predicate", "interval_end_ns")


@query("f02_rejections", f"with {GATE} select case_id, claim_seq, reason, case when reason = '{G.UNKNOWN}' then unknown end as unknown from judged where reason is not null")
def rejections(spark, d):
    unknown = F.when(F.col("reason") == G.UNKNOWN, F.array_join("unknown_evidence", ","))
    return _gate(spark, d)[1].select("case_id", "claim_seq", "reason", unknown.alias("unknown"))


# --------------------------------------------------------------------------- investigation logs from conversations

ANSWER = """to_json(named_struct('tool_calls', transform(sequence(1, cast(1 + conv_id % 9 as int)), i -> named_struct('name', 'fetch_evidence')),
  'proposed_claims', array(named_struct('predicate', 'ENCODED_COMMAND', 'subject', concat('conv:', conv_id), 'interval_start_ns', turn, 'interval_end_ns', turn + 1,
     'evidence', array(concat('ev-', turn)), 'extractor', named_struct('kind', if(conv_id % 5 = 4, 'guess', 'llm'), 'id', 'm', 'version', '1'), 'hypothesis_ref', concat('H', turn % 3))),
  'narrative', role))"""


def _turns(spark, d):
    """Even turns answer in structure (kind invalid in every fifth conversation), odd ones in prose."""
    conv = table(spark, d, "conversations")
    return conv.selectExpr("conv_id", "turn", "role", f"if(turn % 2 = 0, {ANSWER}, text) as text")


@query(
    "f03_parse_turns",
    """select conv_id, turn, turn % 2 = 0 and conv_id % 5 <> 4 as valid,
         case when turn % 2 = 0 and conv_id % 5 <> 4 then 1 + conv_id % 9 else 0 end::bigint as tool_calls,
         case when turn % 2 = 0 and conv_id % 5 <> 4 then 1 else 0 end::bigint as claims,
         case when turn % 2 = 0 and conv_id % 5 <> 4 then role when turn % 2 = 0 then 'unparsed' else text end as narrative
       from conversations""",
)
def parse_turns(spark, d):
    parsed = G.parse_turns(_turns(spark, d))
    unparsed = ~F.col("valid") & (F.col("turn") % 2 == 0)
    return parsed.select(
        "conv_id", "turn", "valid", "tool_calls", F.size("proposed_claims").cast("bigint").alias("claims"),
        F.when(unparsed, F.lit("unparsed")).otherwise(F.col("narrative")).alias("narrative"),
    )


def _log(spark, d):
    conv = table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").cast("bigint").alias("n"))
    return conv.selectExpr(
        "conv_id as investigation_id",
        "turn",
        "if(n % 7 = 0, 0L, n % 9) as tool_calls",
        "n % 4 as claims",
        "array(if(n % 3 = 0, 'H1', if(n % 3 = 1, 'H2', '')), if(n % 5 = 0, 'H3', null)) as hypotheses",
    )


LOG = """log as (select conv_id as investigation_id, turn, case when n % 7 = 0 then 0 else n % 9 end::bigint as tool_calls, n % 4 as claims, n from (select *, length(text) as n from conversations)),
  run as (select *, sum(tool_calls) over (partition by investigation_id order by turn) as calls from log where turn < 4),
  flag as (select *, coalesce(max((tool_calls = 0 or calls > 12)::int) over (partition by investigation_id order by turn rows between unbounded preceding and 1 preceding), 0) as stopped from run),
  used as (select * from flag where stopped = 0),
  hyp as (select distinct investigation_id, case when n % 3 = 0 then 'H1' else 'H2' end as h from used where n % 3 < 2 union select distinct investigation_id, 'H3' from used where n % 5 = 0),
  hc as (select investigation_id, count(*)::bigint as hypothesis_count from hyp group by all),
  roll as (select investigation_id, count(*)::bigint as turns, sum(tool_calls)::bigint as tool_calls, sum(claims)::bigint as claims,
      max(calls) > 12 or (max((tool_calls = 0)::int) = 0 and count(*) >= 4) as budget_exhausted from used group by all)"""


@query("f05_investigation_rollup", f"with {LOG} select * from roll")
def investigation_rollup(spark, d):
    return G.rollup_investigations(_log(spark, d), max_calls=12, max_turns=4).drop("hypothesis_count", "multi_hypothesis")


@query("f06_competing_hypotheses", f"with {LOG} select investigation_id, coalesce(hypothesis_count, 0)::bigint as hypothesis_count, coalesce(hypothesis_count, 0) >= 2 as multi_hypothesis from roll left join hc using (investigation_id)")
def competing_hypotheses(spark, d):
    return G.rollup_investigations(_log(spark, d), max_calls=12, max_turns=4).select("investigation_id", "hypothesis_count", "multi_hypothesis")


@query(
    "f07_flatten_claims",
    """select conv_id, turn, 'ENCODED_COMMAND' as predicate, 'conv:' || conv_id as subject, 'llm' as extractor_kind, 'm' as extractor_id, '1' as extractor_version,
         'supports' as polarity, 'H' || (turn % 3) as hypothesis_ref, 'ev-' || turn as evidence from conversations where turn % 2 = 0 and conv_id % 5 <> 4""",
)
def flatten_claims(spark, d):
    rows = G.parse_turns(_turns(spark, d)).select("conv_id", "turn", F.explode("proposed_claims").alias("claim"))
    flat = G.flatten_claims(rows)
    return flat.select(
        "conv_id", "turn", "predicate", "subject", "extractor_kind", "extractor_id", "extractor_version", "polarity", "hypothesis_ref", F.array_join("evidence", ",").alias("evidence")
    )
