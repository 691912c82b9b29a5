"""The driver's tables seen as domain tables, each as a Spark view and as a DuckDB CTE.

Every view reads its whole table; only columns a query uses survive to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, evidence_id

SPLIT_NS = 1_705_363_200_000_000_000  # 2024-01-16: history before, detection after


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(col: str) -> F.Column:
    """UTC nanoseconds of a zone-less timestamp, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({col} as timestamp_ntz)) * 1000L")


# --------------------------------------------------------------------------- events as security events

def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        nanos("ts").alias("time"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return raw.selectExpr(
        "event_id",
        "time",
        "event_type",
        "value",
        "1L as activity_id",
        "case event_type when 'error' then 2L when 'signup' then 1L else 0L end as status_id",
        "concat('user-', user_id) as actor_user_uid",
        "if(user_id % 5 = 0, 'service', 'user') as actor_user_type",
        "if(k >= 90, '203.0.113.44', concat('198.51.100.', 8 + k % 2)) as src_endpoint_ip",
        "concat('AS', k) as cloud_asn",
        "if(event_type = 'view', null, concat('sess-', user_id, '-', k div 4)) as session_id",
        "if(k % 7 = 0, null, cast(floor(value * 20000) as bigint)) as distance_from_prev_km",
        "if(event_type = 'error', null, concat('host-', user_id % 50)) as host_uid",
        "event_type = 'view' and k % 10 = 0 as is_run_key",
        "if(event_type = 'click', 'rdp', 'web') as app_name",
        "concat('host-', user_id % 50) as src_host_uid",
        "if(event_type = 'click', concat('srv-', k), null) as dst_host_uid",
        "k",
    )


AUTH = """
auth as (
  select event_id, time, event_type, value, 1::bigint as activity_id,
    case event_type when 'error' then 2 when 'signup' then 1 else 0 end::bigint as status_id,
    'user-' || user_id as actor_user_uid,
    case when user_id % 5 = 0 then 'service' else 'user' end as actor_user_type,
    case when k >= 90 then '203.0.113.44' else '198.51.100.' || (8 + k % 2) end as src_endpoint_ip,
    'AS' || k as cloud_asn,
    case when event_type = 'view' then null else 'sess-' || user_id || '-' || (k // 4) end as session_id,
    case when k % 7 = 0 then null else cast(floor(value * 20000) as bigint) end as distance_from_prev_km,
    case when event_type = 'error' then null else 'host-' || (user_id % 50) end as host_uid,
    event_type = 'view' and k % 10 = 0 as is_run_key,
    case when event_type = 'click' then 'rdp' else 'web' end as app_name,
    'host-' || (user_id % 50) as src_host_uid,
    case when event_type = 'click' then 'srv-' || k end as dst_host_uid,
    k
  from (select *, epoch_us(ts) * 1000 as time, json_extract_string(props, '$.k')::bigint as k from events)
)"""

# --------------------------------------------------------------------------- events as raw JSON lines


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per event, key order depending on the row, timestamps as RFC 3339 text."""
    ev = table(spark, sf_dir, "events").withColumn("at", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    status = "concat('\"status\":{\"errorCode\":', event_id % 7, ',\"note\":\"n', user_id % 3, '\"}')"
    user = "concat('\"userId\":\"u', user_id, '\"')"
    at = "concat('\"createdDateTime\":\"', at, 'Z\"')"
    kind = "concat('\"kind\":\"', event_type, '\"')"
    one = f"concat('{{', {status}, ',', {user}, ',', {at}, ',', {kind}, ',\"extra\":', props, '}}')"
    two = f"concat('{{ ', {kind}, ', \"extra\": ', props, ' ,', {at}, ',', {user}, ',', {status}, '}}')"
    bad_number = f"concat('{{', {user}, ',', {at}, ',\"extra\":', value + 0.001D, '}}')"
    no_time = f"concat('{{', {user}, ',\"createdDateTime\":\"0001-01-01T00:00:00Z\"}}')"
    bad_time = f"concat('{{', {user}, ',\"createdDateTime\":\"yesterday\"}}')"
    return ev.selectExpr(
        "event_id as line_no",
        f"""case when event_id % 50 = 7 then {bad_number} when event_id % 50 = 8 then {bad_time}
             when event_id % 50 = 9 then 'not json' when event_id % 50 = 10 then '   ' when event_id % 50 = 11 then {no_time}
             when event_id % 2 = 0 then {one} else {two} end as text""",
    )


RAW = """
lines as (
  select event_id as line_no, user_id, event_type, value, k, stamp, (epoch_us(ts) * 1000)::bigint as time,
    case when event_id % 50 = 7 then 'bad_number' when event_id % 50 = 8 then 'bad_time'
         when event_id % 50 = 9 then 'not_json' when event_id % 50 = 10 then 'blank' when event_id % 50 = 11 then 'no_time' else 'ok' end as shape,
    '{"createdDateTime":"' || stamp || 'Z","extra":{"k":' || k || '},"kind":"' || event_type || '","status":{"errorCode":'
      || (event_id % 7) || ',"note":"n' || (user_id % 3) || '"},"userId":"u' || user_id || '"}' as canonical
  from (select *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as stamp, json_extract_string(props, '$.k')::bigint as k from events)
)"""


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security events with evidence ids: the canonical form of three stable fields."""
    ev = auth_events(spark, sf_dir)
    line = F.to_json(F.struct("event_id", "time", "actor_user_uid"))
    return ev.withColumn("evidence_id", evidence_id(canonical_json(line)))


EVIDENCE = """
stored as (
  select *, 'sha256:' || sha256('{"actor_user_uid":"' || actor_user_uid || '","event_id":' || event_id || ',"time":' || time || '}') as evidence_id
  from auth
)"""

# --------------------------------------------------------------------------- orders and lineitem as cases and claims

CLAIM_PREDICATES = [
    "AUTH_FAILED_BURST",
    "AUTH_SUCCEEDED_AFTER_FAILURES",
    "AUTH_FROM_NEW_ASN",
    "TOKEN_REPLAYED",
    "TRAVEL_IMPOSSIBLE",
    "INTERPRETER_SPAWNED_BY",
    "ENCODED_COMMAND",
    "INTERPRETER_NETWORK_EGRESS",
    "CONNECTED_TO_INDICATOR",
    "RDP_INTERNAL_FIRST_TIME",
    "PERSISTENCE_INSTALLED",
    "NOT_YET_PRICED",
]
_PREDS = ", ".join(f"'{p}'" for p in CLAIM_PREDICATES)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a case; 25 tenants; claims of orders with key divisible by 9 cite no evidence."""
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('case-', o_orderkey)").alias("case_id"),
        F.expr("concat('tenant-', o_orderkey % 25)").alias("tenant_id"),
        F.expr("o_orderkey div 25").alias("closed_seq"),
        F.expr("concat('inv-', o_orderkey)").alias("investigation_id"),
        F.expr("if(o_orderkey % 2 = 0, 'policy.v1', 'policy.v2')").alias("policy_version"),
        nanos("o_orderdate").alias("started_at_ns"),
        (nanos("o_orderdate") + F.expr("o_orderkey % 1000 * 1000000000L")).alias("completed_at_ns"),
        F.expr("named_struct('provider', 'local', 'model_id', concat('m', o_orderkey % 3), 'weights_digest', '', 'seed', cast(null as bigint))").alias("inference"),
        F.expr("named_struct('tool_calls', o_orderkey % 24, 'turns', o_orderkey % 10)").alias("budget_consumed"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a claim.  A claim without evidence has an empty list or none at all, which is the same."""
    li = table(spark, sf_dir, "lineitem").withColumn("start", nanos("l_shipdate"))
    return li.selectExpr(
        "concat('case-', l_orderkey) as case_id",
        "l_orderkey",
        "l_linenumber as claim_seq",
        f"element_at(array({_PREDS}), cast(l_partkey % 12 as int) + 1) as predicate",
        "concat('part:', l_partkey) as subject",
        "if(l_suppkey % 10 = 0, null, concat('supplier:', l_suppkey)) as object",
        "start as interval_start_ns",
        "start + cast(l_quantity as bigint) * 1000000000L as interval_end_ns",
        "case when l_quantity = 1 and l_partkey % 2 = 0 then null when l_quantity = 1 or l_orderkey % 9 = 0 then cast(array() as array<string>)"
        " else array(concat('ev-', l_suppkey), concat('ev-', l_partkey % 97)) end as evidence",
        "if(l_returnflag = 'R', 'model', 'rule') as extractor_kind",
        "'lineitem' as extractor_id",
        "'1' as extractor_version",
        "if(l_linenumber = 7, null, cast(l_quantity as bigint)) as observed_value",
        "if(l_discount > 0.07D, 'refutes', 'supports') as polarity",
        "case l_linenumber % 3 when 0 then 'H1' when 1 then 'H2' end as hypothesis_ref",
    )


CASES = """
cases as (
  select 'case-' || o_orderkey as case_id, 'tenant-' || (o_orderkey % 25) as tenant_id, o_orderkey // 25 as closed_seq,
    'inv-' || o_orderkey as investigation_id, case when o_orderkey % 2 = 0 then 'policy.v1' else 'policy.v2' end as policy_version,
    epoch_us(o_orderdate) * 1000 as started_at_ns, epoch_us(o_orderdate) * 1000 + o_orderkey % 1000 * 1000000000 as completed_at_ns,
    '{"provider":"local","model_id":"m' || (o_orderkey % 3) || '","weights_digest":"","seed":null}' as inference,
    '{"tool_calls":' || (o_orderkey % 24) || ',"turns":' || (o_orderkey % 10) || '}' as budget_consumed, o_orderkey
  from orders
)"""

CLAIMS = f"""
claims_raw as (
  select 'case-' || l_orderkey as case_id, l_orderkey, l_linenumber as claim_seq,
    ([{_PREDS}])[(l_partkey % 12)::int + 1] as predicate, 'part:' || l_partkey as subject,
    case when l_suppkey % 10 = 0 then null else 'supplier:' || l_suppkey end as object,
    epoch_us(l_shipdate) * 1000 as interval_start_ns, epoch_us(l_shipdate) * 1000 + l_quantity::bigint * 1000000000 as interval_end_ns,
    case when l_quantity = 1 or l_orderkey % 9 = 0 then []::varchar[] else ['ev-' || l_suppkey, 'ev-' || (l_partkey % 97)] end as evidence,
    case when l_returnflag = 'R' then 'model' else 'rule' end as extractor_kind, 'lineitem' as extractor_id, '1' as extractor_version,
    case when l_linenumber = 7 then null else l_quantity::bigint end as observed_value,
    case when l_discount > 0.07::double then 'refutes' else 'supports' end as polarity,
    case l_linenumber % 3 when 0 then 'H1' when 1 then 'H2' end as hypothesis_ref
  from lineitem
),
claims as (
  select *, sha256('{{"predicate":"' || predicate || '","subject":"' || subject || '","object":' || coalesce('"' || object || '"', 'null')
    || ',"interval_start_ns":' || interval_start_ns || ',"interval_end_ns":' || interval_end_ns
    || ',"evidence":[' || case when len(evidence) = 0 then '' else '"' || array_to_string(list_sort(evidence), '","') || '"' end
    || '],"extractor_kind":"' || extractor_kind || '","extractor_id":"' || extractor_id || '","extractor_version":"' || extractor_version
    || '","observed_value":' || coalesce(observed_value::varchar, 'null') || ',"polarity":"' || polarity
    || '","hypothesis_ref":' || coalesce('"' || hypothesis_ref || '"', 'null') || '}}') as claim_id
  from claims_raw
)"""


CORPUS_VERSION = "corpus.1"


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is an indicator, some twice; a third of the values occur in claims.

    An older corpus version has the same values under other weights.
    """
    s = table(spark, sf_dir, "supplier")
    entry = "named_struct('predicate', '{p}', 'position', {pos}, 'weight', {w}, 'techniques', {t})"
    hot = entry.format(p="CONNECTED_TO_INDICATOR", pos="s_suppkey", w="5000L", t="array('T1071.001', 'T1090')")
    again = entry.format(p="CONNECTED_TO_INDICATOR", pos="s_suppkey + 1000000000L", w="1L", t="cast(array() as array<string>)")
    other = entry.format(p="ENCODED_COMMAND", pos="s_suppkey", w="2000L + s_suppkey % 4 * 1000L", t="cast(array() as array<string>)")
    alien = entry.format(p="NOT_YET_PRICED", pos="s_suppkey", w="100L", t="cast(array() as array<string>)")
    picked = f"filter(array({hot}, {other}, if(s_suppkey % 2 = 0, {again}, null), if(s_suppkey % 21 = 0, {alien}, null)), x -> x is not null)"
    value = "concat(if(s_suppkey % 3 = 0, 'supplier:', 'idle:'), s_suppkey) as value"
    rows = s.selectExpr(value, f"inline({picked})").select("position", "predicate", "value", "weight", "techniques")
    old = rows.withColumn("weight", F.col("weight") + 7).withColumn("corpus_version", F.lit("corpus.0"))
    return rows.withColumn("corpus_version", F.lit(CORPUS_VERSION)).unionByName(old)


INDICATORS = """
indicator_rows as (
  select 'corpus.1' as corpus_version, s_suppkey as position, u.predicate, case when s_suppkey % 3 = 0 then 'supplier:' else 'idle:' end || s_suppkey as value, u.weight, u.techniques
  from (select s_suppkey, unnest([
      {'predicate': 'CONNECTED_TO_INDICATOR', 'weight': 5000, 'techniques': ['T1071.001', 'T1090'], 'held': true},
      {'predicate': 'ENCODED_COMMAND', 'weight': 2000 + s_suppkey % 4 * 1000, 'techniques': []::varchar[], 'held': true},
      {'predicate': 'CONNECTED_TO_INDICATOR', 'weight': 1, 'techniques': []::varchar[], 'held': s_suppkey % 2 = 0},
      {'predicate': 'NOT_YET_PRICED', 'weight': 100, 'techniques': []::varchar[], 'held': s_suppkey % 21 = 0}]) as u from supplier)
  where u.held
),
all_indicators as (select * replace (position + case when weight = 1 then 1000000000 else 0 end as position) from indicator_rows
  union all select 'corpus.0', position + case when weight = 1 then 1000000000 else 0 end, predicate, value, weight + 7, techniques from indicator_rows),
indicators as (select * from all_indicators where corpus_version = 'corpus.1')"""
