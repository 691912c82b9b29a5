"""Statistics over events, cases and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import floor_div

from ..plans.islands import islands
from ..plans.ranking import exact_median, lag_within
from ..plans.rules import Rule, evaluate
from ..session import small, stored

# ---------------------------------------------------------------- per-entity statistics


def robust_z(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds ``median``, ``mad`` and ``robust_z`` = (value - median) / (1.4826 MAD); NULL when MAD is 0.

    The medians, one row per group, are stored first; if they are small they are broadcast, so that a hot group's rows
    stay where they are.
    Both medians are exact and computed by position in a distributed sort, not by gathering a group.
    """
    group = list(group)
    centred = df.join(small(stored(exact_median(df, group, value, "median"), "medians")), group).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    out = centred.join(small(stored(exact_median(centred, group, "_dev", "mad"), "medians")), group)
    z = F.try_divide(F.col(value) - F.col("median"), F.col("mad") * F.lit(1.4826))
    return out.withColumn("robust_z", z).drop("_dev")


def rare_values(df: DataFrame, entity: str, value: str, at_most: int) -> DataFrame:
    """(entity, value, times) seen at most ``at_most`` times, counted exactly."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(entity, value).agg(F.count(F.lit(1)).alias("times"))
    return counts.filter(F.col("times") <= at_most)


def volume_percentiles(df: DataFrame, group: Sequence[str], value: str, points: Sequence[float] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles with a mergeable summary; the rank error is at most rows / accuracy."""
    return df.groupBy(*group).agg(F.percentile_approx(value, list(points), accuracy).alias("percentiles"), F.count(F.lit(1)).alias("n"))


def approx_distinct(df: DataFrame, group: Sequence[str], value: str, log2_k: int = 14) -> DataFrame:
    """Approximate distinct count from a HyperLogLog sketch, kept so that sketches can be merged later."""
    sketched = df.groupBy(*group).agg(F.hll_sketch_agg(F.col(value), F.lit(log2_k)).alias("sketch"))
    return sketched.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def with_hour_of_week(df: DataFrame, time: str = "time", out: str = "hour_of_week") -> DataFrame:
    """Hour of the week 0-167 in UTC, Monday 00:00 first, from nanoseconds."""
    hours = F.expr(f"{time} div 3600000000000L")
    return df.withColumn(out, F.pmod(hours + F.lit(72), F.lit(168)).cast("int"))  # the epoch was a Thursday


def password_spray(failures: DataFrame, source: str, user: str, min_users: int, max_per_user: int) -> DataFrame:
    """Sources that failed against many users, few times each."""
    per_user = failures.groupBy(source, user).agg(F.count(F.lit(1)).alias("_tries"))
    out = per_user.groupBy(source).agg(F.count(F.lit(1)).alias("users"), F.max("_tries").alias("max_tries"), F.sum("_tries").alias("failures"))
    return out.filter((F.col("users") >= min_users) & (F.col("max_tries") <= max_per_user))


EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def login_velocity(logins: DataFrame, user: str = "actor_user_uid", time: str = "time", tie: str = "event_id") -> DataFrame:
    """Adds the previous login's distance in km and the speed needed in km/h (NULL for the first login
    and for two logins at the same instant).  ``logins`` has ``lat`` and ``lon``."""
    paired = lag_within(logins, [user], [time, tie], out="_prev")
    km = haversine_km(F.col("_prev.lat"), F.col("_prev.lon"), F.col("lat"), F.col("lon"))
    hours = (F.col(time) - F.col(f"_prev.{time}")) / F.lit(3_600_000_000_000.0)
    return paired.withColumn("km", km).withColumn("km_per_hour", F.try_divide(F.col("km"), hours)).drop("_prev")


def entropy_bits(text: Column) -> Column:
    """Shannon entropy of a string's characters, inside the row."""
    chars = F.split(text, "")
    n = F.size(chars)

    def term(acc, c):
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return acc - p * F.log2(p)

    return F.when(F.length(text) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), term)).otherwise(F.lit(0.0))


def dns_features(queries: DataFrame, host: str = "host") -> DataFrame:
    """Per parent domain (last two labels): queries, distinct subdomains, mean and longest length, mean entropy."""
    labels = F.split(F.col(host), r"\.")
    parent = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))
    sub = F.concat_ws(".", F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))))
    # equal names fold first: the features of a name are computed once
    names = queries.groupBy(F.col(host).alias(host)).agg(F.count(F.lit(1)).alias("_n"))
    rows = names.select(parent.alias("parent"), sub.alias("sub"), F.length(host).alias("len"), "_n").withColumn("bits", entropy_bits(F.col("sub")))
    return rows.groupBy("parent").agg(
        F.sum("_n").alias("queries"),
        F.count_if(F.col("sub") != "").alias("subdomains"),
        (F.sum(F.col("len") * F.col("_n")) / F.sum("_n")).alias("mean_length"),
        F.max("len").cast("bigint").alias("max_length"),
        (F.sum(F.col("bits") * F.col("_n")) / F.sum("_n")).alias("mean_entropy"),
    )


def both_within(events: DataFrame, key: str, kind: str, first: str, second: str, window: int, time: str = "time") -> DataFrame:
    """(key, at) time buckets where an event of each kind occurs at most ``window`` apart, in any order.

    Events fold to one row per (key, bucket of the window's width).  Two events of one bucket are always
    close enough; across a bucket border the latest of one kind meets the earliest of the other.
    """
    a, b = F.col(kind) == first, F.col(kind) == second
    buckets = (
        events.filter(F.col(kind).isin(first, second) & F.col(key).isNotNull())
        .groupBy(key, floor_div(F.col(time), window).alias("bucket"))
        .agg(
            F.min(F.when(a, F.col(time))).alias("a_lo"),
            F.max(F.when(a, F.col(time))).alias("a_hi"),
            F.min(F.when(b, F.col(time))).alias("b_lo"),
            F.max(F.when(b, F.col(time))).alias("b_hi"),
        )
    )
    before = buckets.select(key, (F.col("bucket") + 1).alias("bucket"), F.col("a_hi").alias("a_before"), F.col("b_hi").alias("b_before"))
    near = F.coalesce(F.col("b_lo") - F.col("a_before") <= window, F.lit(False)) | F.coalesce(F.col("a_lo") - F.col("b_before") <= window, F.lit(False))
    inside = F.col("a_lo").isNotNull() & F.col("b_lo").isNotNull()
    return buckets.join(before, [key, "bucket"], "left").filter(inside | near).select(key, "bucket")


# ---------------------------------------------------------------- cases


def group_cases(alerts: DataFrame, entity: str, time: str, gap: int) -> DataFrame:
    """Alerts of one entity belong to one case while no gap between them exceeds ``gap``."""
    return islands(alerts.filter(F.col(entity).isNotNull()), [entity], time, gap)


def entity_risk(signals: DataFrame, now: int, tau: float, entity: str = "entity", time: str = "time") -> DataFrame:
    """Sum of weights decayed by age: weight * position * exp(-age / tau).

    ``position`` is the tactic's place in the kill chain over twelve.
    """
    age = F.greatest(F.lit(0), F.lit(now) - F.col(time))
    decayed = F.col("weight") * ((F.col("tactic_ordinal") + 1) / F.lit(12.0)) * F.exp(-age / F.lit(float(tau)))
    return signals.groupBy(entity).agg(F.sum(decayed).alias("risk"), F.count(F.lit(1)).alias("signals"))


def coverage(techniques: DataFrame, rules: DataFrame, fires: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Three separate answers per technique: a rule exists, it has fired, telemetry is present."""
    flags = {"has_rule": rules, "has_fired": fires, "has_telemetry": telemetry}
    out = techniques.select("technique").distinct()
    for name, df in flags.items():
        mark = df.select("technique").distinct().withColumn(name, F.lit(True))
        out = out.join(mark, "technique", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


DAY_NS = 86_400_000_000_000


def retro_hunt(rule: Rule, events: DataFrame, end_ns: int, days: int = 90, baseline=None) -> DataFrame:
    """What the rule would have found on each of the last ``days`` days: (day, predicate, detections)."""
    span = events.filter((F.col("time") >= end_ns - days * DAY_NS) & (F.col("time") < end_ns))
    dated = span.withColumn("day", F.expr(f"time div {DAY_NS}L"))
    return evaluate(rule, dated, baseline, by=["day"]).groupBy("day", "predicate").agg(F.count(F.lit(1)).alias("detections"))


# ---------------------------------------------------------------- evaluation measures


def flip_measures(closed: DataFrame, drifts: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: flip rate of benign-closed cases, share of true flips, mean lead time in days.

    ``truth`` is (case_id, malicious); ``drifts`` carries new_disposition and swept_at_ns.
    """
    flips = drifts.filter("new_disposition = 'malicious'").select("case_id", "swept_at_ns")
    rows = (
        closed.filter("disposition = 'benign'")
        .select("case_id", "completed_at_ns")
        .join(flips, "case_id", "left")
        .join(truth.select("case_id", "malicious"), "case_id", "left")
    )
    flipped = F.col("swept_at_ns").isNotNull()
    true_flip = flipped & F.coalesce("malicious", F.lit(False))
    lead = (F.col("swept_at_ns") - F.col("completed_at_ns")) / F.lit(float(DAY_NS))
    return rows.agg(
        F.count(F.lit(1)).alias("benign_closed"),
        F.count_if(flipped).alias("flips"),
        F.try_divide(F.count_if(flipped).cast("double"), F.count(F.lit(1))).alias("flip_rate"),
        F.try_divide(F.count_if(true_flip).cast("double"), F.count_if(flipped)).alias("true_flip_rate"),
        F.avg(F.when(flipped, lead)).alias("mean_lead_days"),
    )


def run_variance(runs: DataFrame) -> DataFrame:
    """Per case over repeated runs: does the disposition or severity vary.

    ``runs`` is (case_id, run, disposition, severity).  Minimum and maximum decide it without a distinct.
    """
    varies = lambda c: F.min(c) != F.max(c)
    return runs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("runs"), varies("disposition").alias("disposition_varies"), varies("severity").alias("severity_varies")
    )


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |intersection| / |union| of two technique lists; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def detection_quality(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, true and false positive rate from (predicted, actual) booleans."""
    p, a = F.col("predicted"), F.col("actual")
    out = scored.groupBy(*by).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    )
    rate = lambda x, y: F.try_divide(F.col(x).cast("double"), F.col(x) + F.col(y))
    return out.withColumn("precision", rate("tp", "fp")).withColumn("tpr", rate("tp", "fn")).withColumn("fpr", rate("fp", "tn"))


def mean_time_to_detect(cases: DataFrame, first: str, detected: str) -> DataFrame:
    return cases.filter(F.col(detected).isNotNull()).agg(
        F.avg((F.col(detected) - F.col(first)) / 1e9).alias("mttd_seconds"), F.count(F.lit(1)).alias("cases")
    )


def alert_reduction(detections: DataFrame, cases: DataFrame) -> DataFrame:
    """Raw detector fires over adjudicated cases."""
    fires = detections.agg(F.count(F.lit(1)).alias("fires"))
    total = cases.agg(F.count(F.lit(1)).alias("cases"))
    return fires.crossJoin(total).withColumn("reduction_ratio", F.try_divide(F.col("fires").cast("double"), F.col("cases")))  # 1 x 1


def rejection_spikes(claims: DataFrame, by: Sequence[str], window_col: str, threshold: float = 3.5) -> DataFrame:
    """Rejection rate per window and its robust z-score; ``spike`` where it exceeds the threshold.

    ``claims`` has ``rejected`` (boolean).
    """
    rates = claims.groupBy(*by, window_col).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("rejected").alias("rejections")
    )
    rates = rates.withColumn("rate", F.col("rejections") / F.col("claims"))
    scored = robust_z(rates, by, "rate")
    return scored.withColumn("spike", F.coalesce(F.col("robust_z") > threshold, F.lit(False)))


def autonomy_preview(actions: DataFrame, policy: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Actions of the last ``days`` days that would have run by themselves, per tenant and kind.

    ``policy`` is (tenant_id, kind): what would be enabled.
    """
    recent = actions.filter((F.col("proposed_at_ms") > now_ms - days * 86_400_000) & (F.col("proposed_at_ms") <= now_ms))
    enabled = small(policy.select("tenant_id", "kind").distinct())
    return recent.join(enabled, ["tenant_id", "kind"], "left_semi").groupBy("tenant_id", "kind").agg(F.count(F.lit(1)).alias("would_have_run"))
