"""The shipped rules.  Fixed values: ids, thresholds and predicates must equal the published rule set."""

from ..functions.scalar import in_group_sql
from ..functions.vocab import ASSET_GROUPS
from .rules import Emit, Novelty, Rule, Source

LOGIN_OK = "activity_id = 1 AND status_id = 1"
LOGIN_FAILED = "activity_id = 1 AND status_id = 2"
NS_PER_HOUR = 3_600_000_000_000

AUTH_BURST = Rule(
    id="cdl.credential.auth-burst-then-success",
    version=1,
    title="Failed authentication burst followed by success",
    severity="high",
    tactics=("credential-access", "initial-access"),
    techniques=("T1110.001", "T1078"),
    entity="actor_user_uid",
    sources={
        "failures": Source(LOGIN_FAILED, ("actor_user_uid", "src_endpoint_ip"), track_last=("actor_user_type",)),
        "success": Source(LOGIN_OK, ("actor_user_uid",)),
    },
    emits=(
        Emit("AUTH_FAILED_BURST", "failures.count >= 10", "failures.count"),
        Emit(
            "AUTH_SUCCEEDED_AFTER_FAILURES",
            "failures.exists AND success.exists AND success.last_ts > failures.last_ts",
            "success.last_ts - failures.last_ts",
        ),
    ),
    suppress=(
        (
            "failures.last_actor_user_type = 'service' AND "
            + in_group_sql("failures.src_endpoint_ip", ASSET_GROUPS, "ci-runners"),
            "CI runners retry aggressively by design",
        ),
    ),
)

AUTH_NEW_ASN = Rule(
    id="cdl.credential.auth-from-new-asn",
    version=1,
    title="Authentication from an ASN never seen before for this principal",
    severity="medium",
    tactics=("credential-access", "initial-access"),
    techniques=("T1078",),
    entity="actor_user_uid",
    sources={"auths": Source(LOGIN_OK, ("actor_user_uid",), track_last=("cloud_asn",))},
    observations={"asn": "cloud_asn"},
    novelty=(Novelty("asn_is_new", "auths.actor_user_uid", "asn", "auths.last_cloud_asn", 3),),
    emits=(Emit("AUTH_FROM_NEW_ASN", "asn_is_new", "auths.last_cloud_asn"),),
)

_HOURS = f"((auths.last_ts - auths.first_ts) / {NS_PER_HOUR}D)"
_SPEED = f"try_divide(auths.last_distance_from_prev_km, {_HOURS})"

IMPOSSIBLE_TRAVEL = Rule(
    id="cdl.impossible-travel",
    version=1,
    title="Authentication velocity between consecutive locations exceeds physical travel limits",
    severity="high",
    tactics=("initial-access", "defense-evasion"),
    techniques=("T1078",),
    window="6 hours",
    entity="actor_user_uid",
    sources={
        "auths": Source(LOGIN_OK, ("actor_user_uid",), track_last=("distance_from_prev_km", "src_endpoint_ip"))
    },
    emits=(
        Emit(
            "TRAVEL_IMPOSSIBLE",
            f"auths.count >= 2 AND auths.last_distance_from_prev_km IS NOT NULL AND {_SPEED} > 900",
            _SPEED,
        ),
    ),
    suppress=(
        (
            in_group_sql("auths.last_src_endpoint_ip", ASSET_GROUPS, "corporate-egress"),
            "Known corporate VPN/proxy egress range; velocity here is expected, not travel",
        ),
    ),
)

TOKEN_REPLAYED = Rule(
    id="cdl.credential.token-replayed",
    version=1,
    title="Session token used from multiple distinct source IPs",
    severity="high",
    tactics=("credential-access",),
    techniques=("T1550.001",),
    entity="session_id",
    sources={"sessions": Source(LOGIN_OK, ("session_id",), track_distinct=("src_endpoint_ip",))},
    emits=(
        Emit("TOKEN_REPLAYED", "sessions.distinct_src_endpoint_ip >= 2", "sessions.distinct_src_endpoint_ip"),
    ),
)

PERSISTENCE = Rule(
    id="cdl.persistence.registry-run-key-installed",
    version=1,
    title="Persistence via registry Run key creation",
    severity="high",
    tactics=("persistence",),
    techniques=("T1547.001",),
    entity="host_uid",
    sources={"registry": Source("activity_id = 1 AND is_run_key", ("host_uid",))},
    emits=(Emit("PERSISTENCE_INSTALLED", "registry.count >= 1", "registry.count"),),
)

RDP_FIRST_TIME = Rule(
    id="cdl.lateral-movement.rdp-internal-first-time",
    version=1,
    title="RDP connection to a destination host never seen before from this source host",
    severity="medium",
    tactics=("lateral-movement",),
    techniques=("T1021.001",),
    entity="src_host_uid",
    sources={"rdp": Source("app_name = 'rdp'", ("src_host_uid",), track_last=("dst_host_uid",))},
    observations={"dst_host": "dst_host_uid"},
    novelty=(Novelty("dst_is_new", "rdp.src_host_uid", "dst_host", "rdp.last_dst_host_uid", 2),),
    emits=(Emit("RDP_INTERNAL_FIRST_TIME", "dst_is_new", "rdp.last_dst_host_uid"),),
)

ALL_RULES = (AUTH_BURST, AUTH_NEW_ASN, IMPOSSIBLE_TRAVEL, TOKEN_REPLAYED, PERSISTENCE, RDP_FIRST_TIME)
