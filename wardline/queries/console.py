"""Console queries (section I) over orders, customers, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..functions.vocab import CASE_STATUSES, RESPONSE_KINDS, TACTICS
from ..operators import adjudicate as A
from ..operators import console as C
from ..operators import drift as D
from ..operators import ledger as L
from ..operators import merkle as M
from ..session import stored
from .drifting import _drifts, closed
from .policies import KERNEL, sample_policy
from .registry import query
from .scoring import CHAINED, CLOSED, closed_manifests
from .drifting import SWEEP
from .views import CASES, CLAIMS, cases as case_keys, claims, nanos, table

T_LIST = ", ".join(f"'{t}'" for t in TACTICS)
S_LIST = ", ".join(f"'{s}'" for s in CASE_STATUSES)
K_LIST = ", ".join(f"'{k}'" for k in RESPONSE_KINDS)
NOW_MS = 896_659_200_000  # 1998-06-01, inside the span of order dates

BOARD = f"""
board as (
  select 'case-' || o_orderkey as id, o_orderkey, 'nation-' || c_nationkey as tenant_id, 'cust:' || o_custkey as primary_entity,
    case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'info' else 'low' end as severity,
    case o_orderstatus when 'F' then 'benign' when 'O' then 'suspicious' else 'malicious' end as disposition,
    (floor(o_totalprice / 50)::bigint % 10001)::int as risk_score,
    list_distinct([([{T_LIST}])[(o_orderkey % 12)::int + 1], ([{T_LIST}])[(o_orderkey * 7 % 12)::int + 1]]) as tactics,
    epoch_us(o_orderdate) // 1000 as created_at_ms, epoch_us(o_orderdate) // 1000 + o_custkey * 1000 as updated_at_ms,
    ([{S_LIST}])[(o_orderkey % 5)::int + 1] as status, case when o_custkey % 3 = 0 then null else 'analyst-' || (o_custkey % 7) end as assignee,
    epoch_us(o_orderdate) // 1000 - o_orderkey % 5000 * 1000 as first_event_ms,
    case when o_orderkey % 5 = 3 then epoch_us(o_orderdate) // 1000 + o_orderkey % 900 * 60000 end as closed_at_ms,
    case when o_orderkey % 4 = 0 then 'auto' else 'analyst' end as closed_by
  from orders join customer on c_custkey = o_custkey
)"""


def board(spark, d):
    o = table(spark, d, "orders").withColumn("at", F.expr("o_orderdate")).withColumn("ms", floor_div(nanos("o_orderdate"), 1_000_000))
    o = o.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return o.selectExpr(
        "concat('case-', o_orderkey) as id",
        "o_orderkey",
        "concat('nation-', c_nationkey) as tenant_id",
        "concat('cust:', o_custkey) as primary_entity",
        "case left(o_orderpriority, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'info' else 'low' end as severity",
        "case o_orderstatus when 'F' then 'benign' when 'O' then 'suspicious' else 'malicious' end as disposition",
        "cast(cast(floor(o_totalprice / 50) as bigint) % 10001 as int) as risk_score",
        f"array_distinct(array(element_at(array({T_LIST}), cast(o_orderkey % 12 as int) + 1), element_at(array({T_LIST}), cast(o_orderkey * 7 % 12 as int) + 1))) as tactics",
        "ms as created_at_ms",
        "ms + o_custkey * 1000 as updated_at_ms",
        f"element_at(array({S_LIST}), cast(o_orderkey % 5 as int) + 1) as status",
        "if(o_custkey % 3 = 0, null, concat('analyst-', o_custkey % 7)) as assignee",
        "ms - o_orderkey % 5000 * 1000 as first_event_ms",
        "if(o_orderkey % 5 = 3, ms + o_orderkey % 900 * 60000, null) as closed_at_ms",
        "if(o_orderkey % 4 = 0, 'auto', 'analyst') as closed_by",
    )


@query("i01_faceted_filter", f"with {BOARD} select id from board where severity in ('high', 'critical') and disposition in ('malicious', 'suspicious') and list_has_any(tactics, ['execution', 'impact']) and assignee is null")
def faceted_filter(spark, d):
    return C.filter_cases(board(spark, d), ["high", "critical"], ["malicious", "suspicious"], (), ["execution", "impact"], True).select("id")


@query(
    "i02_facet_counts",
    f"""with {BOARD} select 'severity' as facet, severity as value, count(*)::bigint as cases from board group by all
        union all select 'disposition', disposition, count(*) from board group by all union all select 'tenant_id', tenant_id, count(*) from board group by all
        union all select 'assignment', case when assignee is null then 'unassigned' else 'assigned' end, count(*) from board group by all
        union all select 'tactic', t, count(*) from (select unnest(tactics) as t from board) group by all""",
)
def facet_counts(spark, d):
    return C.facet_counts(board(spark, d))


@query("i03_full_queue", f"with {BOARD} select id, risk_score, severity from board")
def full_queue(spark, d):
    """All rows, sorted; the comparison is by rows, not by order."""
    return C.queue(board(spark, d), sort="created_at_ms", descending=False).select("id", "risk_score", "severity")


@query("i03_ranked_queue", f"with {BOARD} select id, risk_score, severity from board order by risk_score desc, id limit 100")
def ranked_queue(spark, d):
    return C.queue(board(spark, d), limit=100).select("id", "risk_score", "severity")


TILES = f"""{BOARD},
  pts as (
    select 'open-cases' as tile, created_at_ms as at_ms, 1.0::double as m from board where status in ('open', 'investigating', 'escalated')
    union all select 'mttd', created_at_ms, (created_at_ms - first_event_ms) / 1000.0::double from board
    union all select 'mttr', closed_at_ms, (closed_at_ms - created_at_ms) / 1000.0::double from board where closed_at_ms is not null
    union all select 'autonomous-close-rate', closed_at_ms, case when closed_by = 'auto' then 100 else 0 end from board where closed_at_ms is not null
    union all select 'drift-alerts', updated_at_ms, 1 from board where disposition = 'malicious'),
  cfg(tile, unit, days, good) as (values ('open-cases', 'count', 1, 'down'), ('mttd', 'duration_s', 7, 'down'), ('mttr', 'duration_s', 7, 'down'), ('autonomous-close-rate', 'percent', 30, 'up'), ('drift-alerts', 'count', 1, 'down')),
  aged as (select tile, unit, good, m, ({NOW_MS} - at_ms) // (days::bigint * 86400000 // 12) as age from pts join cfg using (tile) where at_ms <= {NOW_MS}),
  fig as (select tile, unit, good,
      case tile when 'open-cases' then count(*) when 'drift-alerts' then count_if(age < 12) else avg(m) filter (age < 12) end as value,
      case tile when 'open-cases' then count_if(age >= 12) when 'drift-alerts' then count_if(age between 12 and 23) else avg(m) filter (age between 12 and 23) end as baseline,
      {", ".join(f"case tile when 'open-cases' then count_if(age >= {a}) when 'drift-alerts' then count_if(age = {a}) else avg(m) filter (age = {a}) end::double as p{a}" for a in range(12))}
    from aged group by tile, unit, good)"""


@query(
    "i04_stat_tiles",
    f"""with {TILES}, told as (select tile, unit, round(value::double, 6) as value, round((value - baseline)::double, 6) as delta,
          unnest([{", ".join(f"p{a}" for a in reversed(range(12)))}]) as y, unnest(range(12)) as point from fig where value is not null)
        select tile, unit, value, delta, point::int as point, round(y, 6) as trend_point from told""",
)
def stat_tiles(spark, d):
    """Every tile with its twelve trend points, oldest first."""
    out = C.stat_tiles(board(spark, d), _moves(spark, d), NOW_MS)
    told = out.select("tile", "unit", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"), F.posexplode("trend").alias("point", "y"))
    return told.withColumn("trend_point", F.round("y", 6)).drop("y")


def _moves(spark, d):
    return board(spark, d).filter("disposition = 'malicious'").select("id", F.col("updated_at_ms").alias("swept_at_ms"))


@query(
    "i05_improvement_flag",
    f"with {TILES} select tile, case when value - baseline is null or value = baseline then 'flat' when (value > baseline) = (good = 'up') then 'better' else 'worse' end as improved from fig",
)
def improvement_flag(spark, d):
    return C.stat_tiles(board(spark, d), _moves(spark, d), NOW_MS).select("tile", "improved")


FEED = f"""{BOARD},
  feed as (select l_orderkey * 10 + l_linenumber as seq, case when l_linenumber % 3 = 0 then 'fire' when l_linenumber = 5 then 'new' else 'update' end as kind,
      case when l_linenumber in (5, 7) then 'made-' else 'case-' end || l_orderkey as id, (l_partkey % 10001)::int as risk_score
    from lineitem),
  folded as (select id, max_by(risk_score, seq) as risk_score from (select id, -1 as seq, risk_score from board union all
      select f.id, max(f.seq), max_by(f.risk_score, (f.seq, f.risk_score)) from feed f where kind <> 'fire' group by f.id) group by id)"""


def feed(spark, d):
    """One message per line item and line number: every third is a fire, the fifth makes a case that the seventh changes,
    the rest are updates of known cases."""
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_partkey % 10001 as int) as risk_score")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("risk_score").alias("risk_score"))
    return li.selectExpr(
        "l_orderkey * 10 + l_linenumber as seq",
        "case when l_linenumber % 3 = 0 then 'fire' when l_linenumber = 5 then 'new' else 'update' end as kind",
        "named_struct('id', concat(if(l_linenumber in (5, 7), 'made-', 'case-'), l_orderkey), 'risk_score', risk_score) as case",
    )


@query("i06_fold_feed", f"with {FEED} select id, risk_score from folded")
def fold_feed(spark, d):
    return C.fold_cases(board(spark, d).select("id", "risk_score"), feed(spark, d))


FIRES = "fires as (select event_id as id, epoch_us(ts) // 600000 as at_ms, event_type as kind, user_id from events)"


def fires(spark, d):
    """Events squeezed 600-fold in time, so that several fall into one trailing window."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), floor_div(nanos("ts"), 600_000_000).alias("at_ms"), F.col("event_type").alias("kind"), "user_id")


@query(
    "i07_trailing_rate",
    f"""with {FIRES}, t as (select at_ms, count(*) as n from fires group by all)
        select at_ms, sum(n) over w::bigint as fires_in_window, (sum(n) over w / 5.0)::double as rate_per_s from t window w as (order by at_ms range between 4999 preceding and current row)""".replace("sum(n) over w::bigint", "(sum(n) over w)::bigint"),
)
def trailing_rate(spark, d):
    return C.trailing_rate(fires(spark, d))


@query("i08_recent_fires", f"with {FIRES} select id, at_ms, kind from fires order by at_ms desc, id desc limit 40")
def recent_fires(spark, d):
    return C.recent(fires(spark, d)).select("id", "at_ms", "kind")


STORY = f"""story as (select event_id as id, 'case-' || (user_id % 40) as case_id, epoch_us(ts) // 1000 as at_ms, ([{T_LIST}])[(event_id % 12)::int + 1] as tactic from events)"""


def story(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.expr("concat('case-', user_id % 40)").alias("case_id"),
        floor_div(nanos("ts"), 1_000_000).alias("at_ms"),
        F.expr(f"element_at(array({T_LIST}), cast(event_id % 12 as int) + 1)").alias("tactic"),
    )


@query("i09_case_timeline", f"with {STORY} select id, at_ms, tactic from story where case_id = 'case-7'")
def case_timeline(spark, d):
    return C.timeline(story(spark, d), "case-7").select("id", "at_ms", "tactic")


@query("i09_timeline_bands", f"with {STORY} select case_id, tactic, count(*)::bigint as events, min(at_ms) as first_ms, max(at_ms) as last_ms from story group by all")
def timeline_bands(spark, d):
    return C.timeline_bands(story(spark, d))


IDLE = f"""{STORY},
  g as (select *, (coalesce(at_ms - lag(at_ms) over (partition by case_id order by at_ms, id) > 3600000, false))::int as opens from story),
  s as (select *, sum(opens) over (partition by case_id order by at_ms, id rows unbounded preceding) as segment from g),
  seg as (select case_id, segment, min(at_ms) as start_ms, max(at_ms) as end_ms, greatest(4.0::double, (max(at_ms) - min(at_ms)) * 0.0001::double) as px_width from s group by all),
  px as (select *, coalesce(sum(px_width) over (partition by case_id order by segment rows between unbounded preceding and 1 preceding), 0) + segment * 24 as px_start from seg)"""


@query("i10_compress_idle", f"with {IDLE} select case_id, segment::bigint as segment, start_ms, end_ms, round(px_start, 6) as px_start, round(px_width, 6) as px_width from px")
def compress_idle(spark, d):
    out = C.compress_idle(story(spark, d), 0.0001)
    return out.select("case_id", F.col("segment").cast("bigint").alias("segment"), "start_ms", "end_ms", F.round("px_start", 6).alias("px_start"), F.round("px_width", 6).alias("px_width"))


@query("i10_idle_positions", f"with {IDLE} select s.id, s.segment::bigint as segment, round(px_start + (at_ms - start_ms) * 0.0001::double, 6) as px from s join px on px.case_id = s.case_id and px.segment = s.segment")
def idle_positions(spark, d):
    return C.idle_positions(story(spark, d), 0.0001).select("id", F.col("segment").cast("bigint").alias("segment"), F.round("px", 6).alias("px"))


NODES = "nodes as (select 'cust:' || c_custkey as id, min(epoch_us(o_orderdate) // 1000) as first_seen_ms from customer join orders on o_custkey = c_custkey group by all)"


@query(
    "i11_time_column_layout",
    f"""with {NODES}, e as (select min(first_seen_ms) lo, max(first_seen_ms) hi from nodes),
        c as (select id, first_seen_ms, least(11, floor((first_seen_ms - lo) / greatest(1, hi - lo) * 12))::int as col from nodes, e)
        select id, col as "column", row_number() over (partition by col order by id) - 1 as row, col * 160 as x, (row_number() over (partition by col order by id) - 1) * 28 as y from c""",
)
def time_column_layout(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(floor_div(nanos("o_orderdate"), 1_000_000)).alias("first_seen_ms"))
    nodes = o.select(F.concat(F.lit("cust:"), "o_custkey").alias("id"), "first_seen_ms")
    return C.layout(nodes, 12).select("id", "column", "row", "x", "y")


def edges(spark, d):
    c = claims(spark, d)
    return c.selectExpr(
        "concat(case_id, '#', claim_seq, '#', subject) as id", "subject as from_node_id", "coalesce(object, 'none') as to_node_id", "predicate", "polarity", "evidence as evidence_ids"
    )


EDGES = f"{CLAIMS}, edges as (select case_id || '#' || claim_seq || '#' || subject as id, subject as from_node_id, coalesce(object, 'none') as to_node_id, predicate, evidence from claims_raw)"


@query("i12_neighbourhood", f"with {EDGES} select id, predicate, 'in' as direction, from_node_id as other from edges where to_node_id = 'supplier:7' order by id limit 60")
def neighbourhood(spark, d):
    return C.neighbours(edges(spark, d), "supplier:7")


@query("i13_graph_evidence", f"with {EDGES} select distinct unnest(evidence) as evidence_id from edges")
def graph_evidence(spark, d):
    return C.graph_evidence(edges(spark, d))


def points(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )


POINTS = "pts as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"


@query("i14_bounding_box", f"with {POINTS} select id from pts where x between -0.1 and 0.15 and y between -0.2 and 0.05")
def bounding_box(spark, d):
    return C.in_box(points(spark, d), -0.1, -0.2, 0.15, 0.05).select("id")


@query(
    "i15_nearest_within",
    f"""with {POINTS}, q as (select id as query_id, x + 0.01 as qx, y - 0.02 as qy from pts),
        c as (select query_id, id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) as dist from q, pts where abs(x - qx) <= 0.05 and abs(y - qy) <= 0.05)
        select query_id, min_by(id, (dist, id)) as id, round(min(dist), 9) as distance from c where dist <= 0.05 group by query_id""",
)
def nearest_within(spark, d):
    p = points(spark, d)
    q = p.select(F.col("id").alias("query_id"), (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.02).alias("y"))
    return C.nearest_within(p, q, 0.05).withColumn("distance", F.round("distance", 9))


@query(
    "i16_manifest_list",
    f"""with {CLOSED}, edited as (select *, o_orderkey % 211 = 3 as hit, coalesce(bool_or(o_orderkey % 211 = 3) over (partition by tenant_id order by closed_seq // 256
            range between unbounded preceding and 1 preceding), false) as earlier from closed)
        select case_id, tenant_id, verdict_hash, completed_at_ns::bigint as completed_at_ns, case when hit or earlier then 'broken' else 'intact' end as chain_state from edited""",
)
def manifest_list(spark, d):
    """After sealing, every case whose key is 3 modulo 211 gets another confidence."""
    sealed = stored(L.chain_manifests(closed_manifests(spark, d)), "sealed")
    hit = F.substring("case_id", 6, 20).cast("bigint") % 211 == 3
    sealed = sealed.withColumn("verdict_confidence", F.when(hit, F.col("verdict_confidence") + 1).otherwise(F.col("verdict_confidence")))
    return C.manifest_list(sealed, L.verify_manifests(sealed)).select("case_id", "tenant_id", "verdict_hash", "completed_at_ns", "chain_state")


@query(
    "i17_verification_panel",
    f"""with {CLOSED}, k as (select *, o_orderkey % 7 = 2 as lost from closed)
        select case_id, case when lost then 0 else evidence_count end as proofs, case when lost then 0 else evidence_count end as proofs_ok, true as verdict_hash_matches,
          case when lost and evidence_count > 0 then 'mismatch' else 'match' end as result from k""",
)
def verification_panel(spark, d):
    """The proofs of every seventh case are lost."""
    c = claims(spark, d)
    manifests = closed_manifests(spark, d)
    replayed = D.replay_pin(closed(spark, d), A.claim_groups(c), sample_policy(spark))
    proofs = M.verify_inclusion(M.prove(A.cited_evidence_tree(c))).filter(F.substring("case_id", 6, 20).cast("bigint") % 7 != 2)
    return C.verify_cases(manifests, replayed, proofs)


@query("i18_drift_feed", f"with {SWEEP} select case_id, new_severity, completed_at_ns // 1000000 as swept_at_ms from drifts join cases using (case_id)")
def drift_feed(spark, d):
    at = case_keys(spark, d).select("case_id", F.expr("completed_at_ns div 1000000").alias("swept_at_ms"))
    return C.drift_feed(_drifts(spark, d).join(at, "case_id")).select("case_id", "new_severity", "swept_at_ms")


CANDIDATES = f"""{BOARD},
  cand as (select 'ra-' || id as id, id as case_id, ([{K_LIST}])[(('0x' || left(sha256(id), 8))::bigint % 5)::int + 1] as kind, primary_entity as target, updated_at_ms as proposed_at_ms,
      len(tactics) || ' contributing tactic(s), risk score ' || risk_score || '/10000 -- see case ' || id || '.' as rationale, 'pending' as status
    from (select * from board where severity in ('high', 'critical') order by created_at_ms, id limit 40))"""


@query("i19_response_candidates", f"with {CANDIDATES} select * from cand")
def response_candidates(spark, d):
    return C.response_candidates(board(spark, d))


DECIDED = f"""{BOARD},
  actions as (select 'ra-' || id as id, 'pending' as status from board where severity in ('high', 'critical')),
  decisions as (select 'ra-case-' || l_orderkey as action_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as seq, case l_partkey % 4 when 0 then 'approved' when 1 then 'rejected' when 2 then 'modified' else 'maybe' end as status from lineitem),
  latest as (select action_id, max_by(status, seq) as s from decisions where status <> 'maybe' group by all)"""


def _decided(spark, d):
    actions = board(spark, d).filter("severity in ('high', 'critical')").select(F.concat(F.lit("ra-"), "id").alias("id"), F.lit("pending").alias("status"))
    decisions = table(spark, d, "lineitem").selectExpr(
        "concat('ra-case-', l_orderkey) as action_id",
        "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as seq",
        "case l_partkey % 4 when 0 then 'approved' when 1 then 'rejected' when 2 then 'modified' else 'maybe' end as status",
    )
    return C.apply_decisions(actions, decisions)


@query("i20_decision_overlay", f"with {DECIDED} select id, coalesce(s, status) as status from actions left join latest on action_id = id")
def decision_overlay(spark, d):
    return _decided(spark, d)[0]


@query(
    "i20_refused_decisions",
    f"""with {DECIDED} select action_id, seq, status, 'invalid_status' as problem from decisions where status = 'maybe'
        union all select action_id, seq, status, 'unknown_action' from decisions where status <> 'maybe' and action_id not in (select id from actions)""",
)
def refused_decisions(spark, d):
    return _decided(spark, d)[1]


@query(
    "i21_lookup",
    f"""with {BOARD}, ids as (select distinct 'case-' || (c_custkey * 11) as id from customer)
        select id, b.severity, b.o_orderkey is not null as found from ids left join board b using (id)""",
)
def lookup(spark, d):
    ids = table(spark, d, "customer").select(F.concat(F.lit("case-"), F.col("c_custkey") * 11).alias("id"))
    return C.lookup(board(spark, d), ids).select("id", "severity", "found")
