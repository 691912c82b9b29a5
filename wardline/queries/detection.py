"""Detection (section D, E) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.vocab import ASSET_GROUPS
from ..operators import detect as D
from ..plans import catalog, rules
from ..session import local_table
from .registry import query
from .views import AUTH, EVIDENCE, SPLIT_NS, auth_events, stored_events

FAILURES = catalog.AUTH_BURST.sources["failures"]
SESSIONS = catalog.TOKEN_REPLAYED.sources["sessions"]


def _history(spark, d):
    ev = auth_events(spark, d)
    return ev.filter(F.col("time") < SPLIT_NS), ev.filter(F.col("time") >= SPLIT_NS)


HIST = AUTH + f", hist as (select * from auth where time < {SPLIT_NS}), cur as (select * from auth where time >= {SPLIT_NS})"


@query(
    "d01_source_filter",
    f"with {AUTH} select event_id, actor_user_uid, src_endpoint_ip from auth where activity_id = 1 and status_id = 2",
)
def source_filter(spark, d):
    return auth_events(spark, d).filter(FAILURES.where).select("event_id", "actor_user_uid", "src_endpoint_ip")


@query(
    "d02_group_aggregates",
    f"""with {AUTH} select actor_user_uid, src_endpoint_ip, count(*)::bigint as count, true as exists,
        min(time)::bigint as first_ts, max(time)::bigint as last_ts
        from auth where status_id = 2 group by all""",
)
def group_aggregates(spark, d):
    src = rules.Source(FAILURES.where, FAILURES.group_by)
    return rules.source_aggregates(auth_events(spark, d), src)


@query(
    "d03_tracked_distinct",
    f"""with {AUTH} select session_id, count(*)::bigint as events, count(distinct src_endpoint_ip)::bigint as distinct_ips
        from auth where status_id = 1 and session_id is not null group by all""",
)
def tracked_distinct(spark, d):
    agg = rules.source_aggregates(auth_events(spark, d), SESSIONS)
    return agg.select("session_id", F.col("count").alias("events"), F.col("distinct_src_endpoint_ip").alias("distinct_ips"))


@query(
    "d04_tracked_last",
    f"""with {AUTH} select actor_user_uid,
        max_by(distance_from_prev_km, (time, event_id)) filter (distance_from_prev_km is not null) as last_km,
        max_by(src_endpoint_ip, (time, event_id)) as last_ip
        from auth where status_id = 1 group by all""",
)
def tracked_last(spark, d):
    agg = rules.source_aggregates(auth_events(spark, d), catalog.IMPOSSIBLE_TRAVEL.sources["auths"])
    return agg.select(
        "actor_user_uid", F.col("last_distance_from_prev_km").alias("last_km"), F.col("last_src_endpoint_ip").alias("last_ip")
    )


@query(
    "d05_case_enumeration",
    f"with {AUTH} select distinct actor_user_uid, src_endpoint_ip from auth where actor_user_uid is not null and src_endpoint_ip is not null",
)
def case_enumeration(spark, d):
    return rules.cases(auth_events(spark, d), catalog.AUTH_BURST.sources)


CORRELATED = f"""{AUTH},
  cases as (select distinct actor_user_uid, src_endpoint_ip from auth),
  failures as (select actor_user_uid, src_endpoint_ip, count(*)::bigint c, min(time) f, max(time) l,
      max_by(actor_user_type, (time, event_id)) last_type from auth where status_id = 2 group by all),
  success as (select actor_user_uid, count(*)::bigint c, min(time) f, max(time) l from auth where status_id = 1 group by all),
  corr as (select cases.*, coalesce(failures.c, 0) fc, failures.f ff, failures.l fl, failures.last_type,
      coalesce(success.c, 0) sc, success.f sf, success.l sl
    from cases left join failures using (actor_user_uid, src_endpoint_ip) left join success using (actor_user_uid))"""


@query(
    "d06_source_correlation",
    f"""with {CORRELATED} select actor_user_uid, src_endpoint_ip, fc as failures, fl::bigint as last_failure, sc as successes, sl::bigint as last_success from corr""",
)
def source_correlation(spark, d):
    frame = rules.correlate(catalog.AUTH_BURST, auth_events(spark, d))
    return frame.select(
        "actor_user_uid",
        "src_endpoint_ip",
        F.col("failures.count").alias("failures"),
        F.col("failures.last_ts").alias("last_failure"),
        F.col("success.count").alias("successes"),
        F.col("success.last_ts").alias("last_success"),
    )


BURST = f"""{CORRELATED},
  live as (select * from corr where not coalesce(last_type = 'service' and src_endpoint_ip = '198.51.100.9', false)),
  burst as (
    select 'AUTH_FAILED_BURST' as predicate, actor_user_uid as entity, fc::varchar as observed, src_endpoint_ip, ff, fl, sf, sl from live where fc >= 10
    union all
    select 'AUTH_SUCCEEDED_AFTER_FAILURES', actor_user_uid, (sl - fl)::varchar, src_endpoint_ip, ff, fl, sf, sl from live where fc > 0 and sc > 0 and sl > fl)"""

BURST_ROWS = """select predicate, entity, observed, 'cdl.credential.auth-burst-then-success' as rule_id, 1 as rule_version from burst"""


@query(
    "d07_emits",
    f"""with {BURST} select predicate, entity, src_endpoint_ip, observed,
        least(ff, coalesce(sf, ff))::bigint as first_ts, greatest(fl, coalesce(sl, fl))::bigint as last_ts from burst""",
)
def emits(spark, d):
    hits = rules.evaluate(catalog.AUTH_BURST, auth_events(spark, d))
    return hits.select("predicate", "entity", F.col("case_key.src_endpoint_ip").alias("src_endpoint_ip"), "observed", "first_ts", "last_ts")


@query(
    "d08_suppression",
    f"""with {CORRELATED} select 'cdl.credential.auth-burst-then-success' as rule_id, actor_user_uid, src_endpoint_ip,
        'CI runners retry aggressively by design' as suppress_reason
        from corr where last_type = 'service' and src_endpoint_ip = '198.51.100.9'""",
)
def suppression(spark, d):
    return rules.suppressed(catalog.AUTH_BURST, auth_events(spark, d))


@query(
    "d09_asset_group",
    f"""with {AUTH} select src_endpoint_ip, src_endpoint_ip in ('198.51.100.9') as is_ci_runner,
        src_endpoint_ip in ('203.0.113.44') as is_egress, count(*)::bigint as events from auth group by all""",
)
def asset_group(spark, d):
    ev = auth_events(spark, d)
    ip = F.col("src_endpoint_ip")
    return ev.groupBy(
        "src_endpoint_ip",
        S.in_asset_group(ip, ASSET_GROUPS, "ci-runners").alias("is_ci_runner"),
        S.in_asset_group(ip, ASSET_GROUPS, "corporate-egress").alias("is_egress"),
    ).agg(F.count(F.lit(1)).alias("events"))


@query(
    "d09_asset_group_table",
    f"with {AUTH} select event_id, src_endpoint_ip from auth where src_endpoint_ip = '203.0.113.44'",
)
def asset_group_table(spark, d):
    groups = local_table(spark, [(g, m) for g, ms in ASSET_GROUPS.items() for m in ms], "group_name string, member string")
    return S.members_of_group(auth_events(spark, d), "src_endpoint_ip", groups, "corporate-egress").select("event_id", "src_endpoint_ip")


SEEN = f"""{HIST},
  obs as (select actor_user_uid as entity, 'asn' as attribute, cloud_asn as value from hist
          union all select actor_user_uid, 'ip', src_endpoint_ip from hist),
  seen as (select entity, attribute, value, count(*)::bigint as times_seen from obs where value is not null group by all),
  counts as (select entity, attribute, sum(times_seen)::bigint as observations from seen group by all)"""

ATTRS = {"asn": "cloud_asn", "ip": "src_endpoint_ip"}


@query(
    "d10_baseline_warm_up",
    f"with {SEEN} select entity, attribute, count(*)::bigint as values_seen, max(observations)::bigint as observations from seen join counts using (entity, attribute) group by all",
)
def baseline_warm_up(spark, d):
    hist, _ = _history(spark, d)
    seen, counts = D.warm_up(hist, "actor_user_uid", ATTRS)
    return (
        seen.join(counts, ["entity", "attribute"])
        .groupBy("entity", "attribute")
        .agg(F.count(F.lit(1)).alias("values_seen"), F.max("observations").alias("observations"))
    )


@query(
    "d11_first_seen_novelty",
    f"""with {SEEN}, fresh as (select distinct actor_user_uid as entity, 'asn' as attribute, cloud_asn as value from cur
          union select distinct actor_user_uid, 'ip', src_endpoint_ip from cur)
        select f.entity, f.attribute, f.value from fresh f left join counts c using (entity, attribute)
        where coalesce(c.observations, 0) >= 3 and not exists
          (select 1 from seen s where s.entity = f.entity and s.attribute = f.attribute and s.value = f.value)""",
)
def first_seen_novelty(spark, d):
    hist, cur = _history(spark, d)
    seen, counts = D.warm_up(hist, "actor_user_uid", ATTRS)
    return D.novel(D.observations(cur, "actor_user_uid", ATTRS), seen, counts, 3)


@query("d12_claim_keys", f"with {BURST} {BURST_ROWS}")
def claim_keys(spark, d):
    return D.claim_keys(rules.evaluate(catalog.AUTH_BURST, auth_events(spark, d)))


@query("d12_predicate_set", f"with {BURST} select distinct predicate from burst")
def predicate_set(spark, d):
    return D.predicate_set(rules.evaluate(catalog.AUTH_BURST, auth_events(spark, d)))


@query(
    "d13_claim_set_comparison",
    f"""with {BURST}, a as ({BURST_ROWS}),
        b as (select predicate, actor_user_uid as entity, observed, rule_id, rule_version from (
            select 'AUTH_FAILED_BURST' as predicate, actor_user_uid, fc::varchar as observed, fc,
              'cdl.credential.auth-burst-then-success' as rule_id, 1 as rule_version from corr) where fc >= 10),
        d as (select *, count(*) as n, 1 as sgn from a group by all union all select *, count(*), -1 from b group by all)
        select predicate, entity, observed, rule_id, rule_version,
          case when sum(n * sgn) > 0 then 'only_left' else 'only_right' end as side, abs(sum(n * sgn))::bigint as copies
        from d group by predicate, entity, observed, rule_id, rule_version having sum(n * sgn) <> 0""",
)
def claim_set_comparison(spark, d):
    ev = auth_events(spark, d)
    full = catalog.AUTH_BURST
    burst_only = rules.Rule(full.id, full.version, full.entity, full.sources, full.emits[:1])
    return D.compare_claims(D.claim_keys(rules.evaluate(full, ev)), D.claim_keys(rules.evaluate(burst_only, ev)))


@query(
    "d14_expectation_report",
    f"""with {BURST}, got as (select distinct 'cdl.credential.auth-burst-then-success' as rule_id, entity as fixture, predicate from burst),
        want as (select distinct 'cdl.credential.auth-burst-then-success' as rule_id, actor_user_uid as fixture, 'AUTH_FAILED_BURST' as predicate from auth),
        j as (select coalesce(g.rule_id, w.rule_id) rule_id, coalesce(g.fixture, w.fixture) fixture,
            coalesce(g.predicate, w.predicate) predicate, g.predicate is not null got, w.predicate is not null want
          from got g full join want w on g.rule_id = w.rule_id and g.fixture = w.fixture and g.predicate = w.predicate)
        select rule_id, fixture, coalesce(string_agg(predicate, ',' order by predicate) filter (not got), '') as missing,
          coalesce(string_agg(predicate, ',' order by predicate) filter (not want), '') as unexpected,
          bool_and(got and want) as passed from j group by rule_id, fixture""",
)
def expectation_report(spark, d):
    """Every user is a fixture that is expected to show a burst and nothing else."""
    ev = auth_events(spark, d)
    got = D.claim_keys(rules.evaluate(catalog.AUTH_BURST, ev)).select("rule_id", F.col("entity").alias("fixture"), "predicate")
    want = ev.select(F.lit(catalog.AUTH_BURST.id).alias("rule_id"), F.col("actor_user_uid").alias("fixture"), F.lit("AUTH_FAILED_BURST").alias("predicate"))
    out = D.expectations(got, want)
    return out.select("rule_id", "fixture", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), "passed")


TRAVEL = f"""{AUTH},
  travel as (select actor_user_uid as entity, last_km / ((l - f) / 3600000000000.0::double) as speed from (
      select actor_user_uid, count(*) c, min(time) f, max(time) l,
        max_by(distance_from_prev_km, (time, event_id)) filter (distance_from_prev_km is not null) as last_km,
        max_by(src_endpoint_ip, (time, event_id)) as last_ip
      from auth where status_id = 1 group by all)
    where c >= 2 and last_km is not null and l > f and last_ip <> '203.0.113.44')"""

REPLAYED = f"""{AUTH}, replayed as (select session_id as entity, count(distinct src_endpoint_ip)::bigint as n
    from auth where status_id = 1 and session_id is not null group by all having count(distinct src_endpoint_ip) >= 2)"""

RUNKEY = f"{AUTH}, runkey as (select host_uid as entity, count(*)::bigint as n from auth where is_run_key and host_uid is not null group by all)"


def _novel_cases(last: str, entity: str, threshold: int, where: str) -> str:
    """Entities whose last value is new to the history, for SQL that already has ``hist`` and ``cur``."""
    return f"""select c.entity from
        (select {entity} as entity, max_by({last}, (time, event_id)) filter ({last} is not null) as value from cur where {where} and {entity} is not null group by all) c
        left join (select {entity} as entity, count({last}) as n from hist group by all) cnt using (entity)
      where c.value is not null and coalesce(cnt.n, 0) >= {threshold}
        and not exists (select 1 from hist h where h.{entity} = c.entity and h.{last} = c.value)"""


def _later(sql: str) -> str:
    """The named tables of ``sql``, over the detection period alone."""
    return sql.replace(AUTH + ",", "").replace("from auth", "from cur")


@query(
    "d15_false_positive_rate",
    f"""with {HIST}, {_later(BURST)}, {_later(TRAVEL)}, {_later(REPLAYED)}, {_later(RUNKEY)},
        asn as ({_novel_cases("cloud_asn", "actor_user_uid", 3, "status_id = 1")}),
        rdp as ({_novel_cases("dst_host_uid", "src_host_uid", 2, "app_name = 'rdp'")}),
        r as (
          select 'cdl.credential.auth-burst-then-success' as rule_id, (select count(*) from burst) as claims, (select count(*) from cases) as cases
          union all select 'cdl.credential.auth-from-new-asn', (select count(*) from asn), (select count(distinct actor_user_uid) from cur)
          union all select 'cdl.impossible-travel', (select count(*) from travel where speed > 900), (select count(distinct actor_user_uid) from cur)
          union all select 'cdl.credential.token-replayed', (select count(*) from replayed), (select count(distinct session_id) from cur)
          union all select 'cdl.persistence.registry-run-key-installed', (select count(*) from runkey), (select count(distinct host_uid) from cur)
          union all select 'cdl.lateral-movement.rdp-internal-first-time', (select count(*) from rdp), (select count(distinct src_host_uid) from cur))
        select rule_id, claims::bigint as claims, cases::bigint as cases, round(claims::double / cases, 9) as fp_rate from r""",
)
def false_positive_rate(spark, d):
    """All six rules over the detection period; the days before it are the baseline of the two novelty rules."""
    hist, cur = _history(spark, d)
    return D.fp_rate(catalog.ALL_RULES, cur, hist).withColumn("fp_rate", F.round("fp_rate", 9))


@query(
    "d12_all_rules",
    f"""with {HIST}, {_later(BURST)}, {_later(TRAVEL)}, {_later(REPLAYED)}, {_later(RUNKEY)},
        asn as ({_novel_cases("cloud_asn", "actor_user_uid", 3, "status_id = 1")}),
        rdp as ({_novel_cases("dst_host_uid", "src_host_uid", 2, "app_name = 'rdp'")})
        select predicate, entity, count(*)::bigint as claims from (
          select predicate, entity from burst
          union all select 'AUTH_FROM_NEW_ASN', entity from asn
          union all select 'TRAVEL_IMPOSSIBLE', entity from travel where speed > 900
          union all select 'TOKEN_REPLAYED', entity from replayed
          union all select 'PERSISTENCE_INSTALLED', entity from runkey
          union all select 'RDP_INTERNAL_FIRST_TIME', entity from rdp) group by all""",
)
def all_rules(spark, d):
    """The claims of all six rules, from one scan for each set of keys."""
    hist, cur = _history(spark, d)
    return D.detections_of(catalog.ALL_RULES, cur, hist).groupBy("predicate", "entity").agg(F.count(F.lit(1)).alias("claims"))


@query("d16_auth_burst", f"with {BURST} {BURST_ROWS}")
def auth_burst(spark, d):
    return D.claim_keys(D.auth_burst(auth_events(spark, d)))


def _novel_sql(last: str, attr: str, entity: str, threshold: int, where: str) -> str:
    return f"""{HIST},
      cand as (select {entity} as entity, max_by({last}, (time, event_id)) filter ({last} is not null) as value
        from cur where {where} and {entity} is not null group by all),
      cnt as (select {entity} as entity, count({last}) as n from hist group by all)
      select '{attr}' as predicate, c.entity, c.value as observed from cand c left join cnt using (entity)
      where c.value is not null and coalesce(cnt.n, 0) >= {threshold}
        and not exists (select 1 from hist h where h.{entity} = c.entity and h.{last} = c.value)"""


@query("d17_auth_new_asn", "with " + _novel_sql("cloud_asn", "AUTH_FROM_NEW_ASN", "actor_user_uid", 3, "status_id = 1"))
def auth_new_asn(spark, d):
    hist, cur = _history(spark, d)
    return D.auth_new_asn(cur, hist).select("predicate", "entity", "observed")


@query("d18_impossible_travel", f"with {TRAVEL} select 'TRAVEL_IMPOSSIBLE' as predicate, entity, round(speed, 4) as km_per_hour from travel where speed > 900")
def impossible_travel(spark, d):
    hits = D.impossible_travel(auth_events(spark, d))
    return hits.select("predicate", "entity", F.round(F.col("observed").cast("double"), 4).alias("km_per_hour"))


@query("d19_token_replayed", f"with {REPLAYED} select 'TOKEN_REPLAYED' as predicate, entity, n as addresses from replayed")
def token_replayed(spark, d):
    return D.token_replayed(auth_events(spark, d)).select("predicate", "entity", F.col("observed").cast("bigint").alias("addresses"))


@query("d20_persistence", f"with {RUNKEY} select 'PERSISTENCE_INSTALLED' as predicate, entity, n as observed from runkey")
def persistence(spark, d):
    return D.persistence(auth_events(spark, d)).select("predicate", "entity", F.col("observed").cast("bigint").alias("observed"))


@query("d21_rdp_first_time", "with " + _novel_sql("dst_host_uid", "RDP_INTERNAL_FIRST_TIME", "src_host_uid", 2, "app_name = 'rdp'"))
def rdp_first_time(spark, d):
    hist, cur = _history(spark, d)
    return D.rdp_first_time(cur, hist).select("predicate", "entity", "observed")


# --------------------------------------------------------------------------- E: expression semantics


@query(
    "e01_boolean_logic",
    f"""with {AUTH} select event_id from auth where coalesce(session_id is not null and distance_from_prev_km > 500000, false)
        or not coalesce(host_uid = 'host-1', false) and status_id = 2""",
)
def boolean_logic(spark, d):
    c = F.col
    strong = S.all_of(c("session_id").isNotNull(), c("distance_from_prev_km") > 500000)
    other = S.all_of(S.negate(c("host_uid") == "host-1"), c("status_id") == 2)
    return auth_events(spark, d).filter(S.any_of(strong, other)).select("event_id")


@query(
    "e02_null_safe_equality",
    f"""with {AUTH} select event_id, host_uid is not distinct from 'host-1' as same, host_uid is distinct from 'host-1' as differs,
        host_uid is null as absent from auth""",
)
def null_safe_equality(spark, d):
    host = F.col("host_uid")
    return auth_events(spark, d).select("event_id", S.eq(host, "host-1").alias("same"), S.ne(host, "host-1").alias("differs"), host.isNull().alias("absent"))


@query(
    "e03_numeric_comparison",
    f"""with {AUTH} select count_if(distance_from_prev_km > 500000)::bigint as gt, count_if(distance_from_prev_km >= 500000)::bigint as ge,
        count_if(distance_from_prev_km < 500000)::bigint as lt, count_if(distance_from_prev_km <= 500000)::bigint as le from auth""",
)
def numeric_comparison(spark, d):
    km = F.col("distance_from_prev_km")
    return auth_events(spark, d).agg(
        F.count_if(km > 500000).alias("gt"), F.count_if(km >= 500000).alias("ge"), F.count_if(km < 500000).alias("lt"), F.count_if(km <= 500000).alias("le")
    )


@query(
    "e04_integer_arithmetic",
    f"with {AUTH} select event_id, (time + 1 - 2 * k)::bigint as mixed, (-k)::bigint as negated from auth",
)
def integer_arithmetic(spark, d):
    return auth_events(spark, d).select("event_id", (F.col("time") + 1 - F.lit(2) * F.col("k")).alias("mixed"), (-F.col("k")).alias("negated"))


@query(
    "e05_floating_division",
    f"with {AUTH} select event_id, round(k::double / 8, 6) as eighth, case when status_id = 0 then null else round(k::double / status_id, 6) end as guarded from auth",
)
def floating_division(spark, d):
    return auth_events(spark, d).select(
        "event_id",
        F.round(S.ratio(F.col("k"), F.lit(8)), 6).alias("eighth"),
        F.round(S.try_ratio(F.col("k"), F.col("status_id")), 6).alias("guarded"),
    )


@query("e06_membership", f"with {AUTH} select event_id from auth where event_type in ('error', 'signup') and not coalesce(host_uid in ('host-1', 'host-2'), false)")
def membership(spark, d):
    ev = auth_events(spark, d)
    return ev.filter(S.member(F.col("event_type"), ["error", "signup"]) & ~S.member(F.col("host_uid"), ["host-1", "host-2"])).select("event_id")


@query(
    "e08_aggregate_fields",
    f"""with {CORRELATED} select actor_user_uid, src_endpoint_ip, fc as n, fc > 0 as any_failure, ff::bigint as first_ts, fl::bigint as last_ts, last_type as last_user_type,
        sc > 0 as any_success from corr""",
)
def aggregate_fields(spark, d):
    frame = rules.correlate(catalog.AUTH_BURST, auth_events(spark, d))
    return frame.selectExpr(
        "failures.actor_user_uid",
        "failures.src_endpoint_ip",
        "failures.count as n",
        "failures.exists as any_failure",
        "failures.first_ts",
        "failures.last_ts",
        "failures.last_actor_user_type as last_user_type",
        "success.exists as any_success",
    )


@query("e09_asset_group_condition", f"with {AUTH} select event_id, src_endpoint_ip in ('198.51.100.9') as in_group from auth")
def asset_group_condition(spark, d):
    return auth_events(spark, d).select("event_id", F.expr(S.in_group_sql("src_endpoint_ip", ASSET_GROUPS, "ci-runners")).alias("in_group"))


@query(
    "e10_baseline_condition",
    f"""with {HIST}, cand as (select actor_user_uid as entity, max_by(cloud_asn, (time, event_id)) as value from cur where status_id = 1 group by all),
        cnt as (select actor_user_uid as entity, count(*) as n from hist group by all),
        allc as (select distinct actor_user_uid as entity from cur)
        select a.entity, coalesce(c.value is not null and coalesce(cnt.n, 0) >= 3 and
          not exists (select 1 from hist h where h.actor_user_uid = c.entity and h.cloud_asn = c.value), false) as asn_is_new
        from allc a left join cand c using (entity) left join cnt using (entity)""",
)
def baseline_condition(spark, d):
    hist, cur = _history(spark, d)
    rule = catalog.AUTH_NEW_ASN
    frame = rules.judged(rule, cur, D.warm_up(hist, rule.entity, rule.observations))
    return frame.select(F.col("actor_user_uid").alias("entity"), "asn_is_new")


@query(
    "e11_scalar_rendering",
    f"with {AUTH} select event_id, k::varchar as number, case when is_run_key then 'true' else 'false' end as flag, host_uid as text from auth",
)
def scalar_rendering(spark, d):
    return auth_events(spark, d).select(
        "event_id", S.render_key(F.col("k")).alias("number"), S.render_key(F.col("is_run_key")).alias("flag"), S.render_key(F.col("host_uid")).alias("text")
    )


@query(
    "j18_detections_to_claims",
    f"""with {BURST.replace(AUTH, AUTH + ',' + EVIDENCE)},
        hits as (select b.predicate, b.entity, b.src_endpoint_ip, b.observed, s.evidence_id, b.ff, b.fl, b.sf, b.sl from burst b join stored s on s.actor_user_uid = b.entity
          and ((s.status_id = 2 and s.src_endpoint_ip = b.src_endpoint_ip) or s.status_id = 1))
        select predicate, entity as subject, count(distinct evidence_id)::bigint as evidence_count,
          max(try_cast(observed as bigint)) as observed_value,
          max(least(ff, coalesce(sf, ff)))::bigint as interval_start_ns, max(greatest(fl, coalesce(sl, fl)))::bigint as interval_end_ns,
          'rule' as extractor_kind, '1' as extractor_version, 'supports' as polarity
        from hits group by predicate, entity, src_endpoint_ip""",
)
def detections_to_claims(spark, d):
    ev = stored_events(spark, d)
    hits = rules.evaluate(catalog.AUTH_BURST, ev)
    sets = D.evidence_sets(D.matched_evidence(catalog.AUTH_BURST, ev, hits))
    claims = D.detections_to_claims(catalog.AUTH_BURST, hits, sets)
    return claims.select(
        "predicate", "subject", "evidence_count", "observed_value", "interval_start_ns", "interval_end_ns", "extractor_kind", "extractor_version", "polarity"
    )
