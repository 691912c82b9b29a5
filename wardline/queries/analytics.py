"""Statistics, windows, feeds and evaluation measures (section J, A11) over events, orders and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.vocab import RESPONSE_KINDS
from ..operators import adjudicate as A
from ..operators import analytics as N
from ..operators import detect as D
from ..operators import sketches as K
from ..plans import catalog
from ..session import scratch_path, settle
from ..sources import feed as FEEDS
from ..sources import history as HISTORY
from ..streaming import folds
from ..streaming import novelty as V
from ..streaming import windows as W
from .console import BOARD, FEED, K_LIST, NOW_MS, board, feed
from .detection import HIST, SEEN
from .drifting import SWEEP, _drifts, closed
from .policies import PRICES
from .registry import query
from .scoring import GATE, VERDICTS, _gate, _verdicts
from .views import AUTH, SPLIT_NS, auth_events, cases, nanos, table

QUARTER_DAY = "6 hours"




WINDOWED = f"""{AUTH},
  w as (select *, time // 21600000000000 as win from auth),
  wc as (select distinct win, actor_user_uid, src_endpoint_ip from w),
  wf as (select win, actor_user_uid, src_endpoint_ip, count(*) c, max(time) l, max_by(actor_user_type, (time, event_id)) as ty from w where status_id = 2 group by all),
  ws as (select win, actor_user_uid, count(*) c, max(time) l from w where status_id = 1 group by all),
  wj as (select wc.*, coalesce(wf.c, 0) fc, wf.l fl, ty, coalesce(ws.c, 0) sc, ws.l sl from wc left join wf using (win, actor_user_uid, src_endpoint_ip) left join ws using (win, actor_user_uid)),
  wlive as (select * from wj where not coalesce(ty = 'service' and src_endpoint_ip = '198.51.100.9', false)),
  wd as (select win, 'AUTH_FAILED_BURST' as predicate, actor_user_uid as entity, fc::varchar as observed from wlive where fc >= 10
    union all select win, 'AUTH_SUCCEEDED_AFTER_FAILURES', actor_user_uid, (sl - fl)::varchar from wlive where fc > 0 and sc > 0 and sl > fl)"""


@query("j01_windowed_rule", f"with {WINDOWED} select win * 21600 as window_start, predicate, entity, observed from wd")
def windowed_rule(spark, d):
    hits = W.windowed_detections(catalog.AUTH_BURST, auth_events(spark, d), QUARTER_DAY)
    return hits.select(F.unix_seconds("window_start").alias("window_start"), "predicate", "entity", "observed")


@query("j01_streamed_rule", f"with {WINDOWED} select win * 21600 as window_start, predicate, entity, observed from wd where win < (select max(time) from auth) // 21600000000000")
def streamed_rule(spark, d):
    """The same rule on a file stream, run to the end of its input; the last, still open window is not emitted."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    auth_events(spark, d).repartitionByRange(6, "time").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")

    def emit(df, batch_id):
        df.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    q = W.stream_detections(catalog.AUTH_BURST, stream, emit, f"{root}/state", delay="5 minutes", window=QUARTER_DAY)
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "predicate", "entity", "observed")


SIGHTS = f"""{AUTH},
  obs as (select actor_user_uid as entity, cloud_asn as value, time, event_id from auth where status_id = 1 and cloud_asn is not null and actor_user_uid is not null),
  told as (select *, row_number() over (partition by entity order by time, event_id) - 1 as before,
      time - lag(time) over (partition by entity, value order by time, event_id) as gap from obs)"""
DAY_NS = 86_400_000_000_000


def _sights(spark, d):
    """The baseline of the first days and the observations after it."""
    rule = catalog.AUTH_NEW_ASN
    observed = V.timed_observations(auth_events(spark, d), rule)
    return rule.novelty[0].threshold, V.remembered(observed.filter(F.col("time") < SPLIT_NS)), observed.filter(F.col("time") >= SPLIT_NS)


@query("d11_first_sights", f"with {SIGHTS} select entity, value, time, event_id from told where gap is null and before >= 3 and time >= {SPLIT_NS}")
def first_sights(spark, d):
    """Novelty against a baseline that grows with the events."""
    threshold, prior, observed = _sights(spark, d)
    return V.first_sights(observed, threshold, prior).drop("attribute")


@query(
    "d11_first_sights_expiring",
    f"with {SIGHTS} select entity, value, time, event_id from told where (gap is null or gap > {2 * DAY_NS}) and before >= 3 and time >= {SPLIT_NS}",
)
def first_sights_expiring(spark, d):
    """As above; a value that was not seen for two days is new again."""
    threshold, prior, observed = _sights(spark, d)
    return V.first_sights(observed, threshold, prior, 2 * DAY_NS).drop("attribute")


@query("j01_streamed_novelty", f"with {SIGHTS} select entity, value, time, event_id from told where gap is null and before >= 3 and time >= {SPLIT_NS}")
def streamed_novelty(spark, d):
    """The same as a stream that is stopped and started again: three spans of time arrive one after another."""
    root = scratch_path(spark, f"sights-{uuid.uuid4().hex}")
    threshold, prior, observed = _sights(spark, d)

    def emit(df, batch_id):
        df.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    for part in range(3):
        edges = [SPLIT_NS + k * 5 * DAY_NS for k in range(3)]
        inside = F.col("time") >= edges[part]
        inside = inside & (F.col("time") < edges[part + 1]) if part < 2 else inside
        observed.filter(inside).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(observed.schema).parquet(f"{root}/in")
        V.stream_first_sights(stream, emit, f"{root}/state", threshold, prior).awaitTermination()
    return spark.read.schema(V.SIGHT + ", batch int").parquet(f"{root}/out").drop("attribute", "batch")


@query("a11_case_feed", f"with {FEED} select id, risk_score from folded")
def case_feed(spark, d):
    """Feed messages written as JSON lines in three parts, each streamed back and folded before the next one comes."""
    root = scratch_path(spark, f"feed-{uuid.uuid4().hex}")
    initial = board(spark, d).select("id", "risk_score")
    messages = feed(spark, d)
    for part in range(3):
        messages.filter(F.pmod("seq", F.lit(3)) == part).write.mode("append").json(f"{root}/in")
        stream = FEEDS.read_case_feed(spark, f"{root}/in")
        folds.fold_feed(stream, initial.columns, f"{root}/out", f"{root}/state", fanout=2).awaitTermination()
    return folds.current_cases(spark, f"{root}/out", initial)


@query(
    "j02_robust_z",
    """with m as (select event_type, median(value) as med from events group by all),
         dv as (select e.event_id, e.event_type, value, med, abs(value - med) as dev from events e join m using (event_type)),
         d as (select event_type, median(dev) as mad from dv group by all)
       select event_id, round(med, 6) as median, round(mad, 6) as mad, round((value - med) / (mad * 1.4826::double), 6) as robust_z from dv join d using (event_type)""",
)
def robust_z(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    out = N.robust_z(ev, ["event_type"], "value")
    return out.select("event_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("robust_z", 6).alias("robust_z"))


@query("j03_rare_values", f"with {AUTH} select actor_user_uid, cloud_asn, count(*)::bigint as times from auth group by all having count(*) <= 1")
def rare_values(spark, d):
    return N.rare_values(auth_events(spark, d), "actor_user_uid", "cloud_asn", 1)


@query("j04_volume_percentiles", "select event_type, count(*)::bigint as n, true as within_rank_error from events group by all")
def volume_percentiles(spark, d):
    """Percentiles of the value per event type, each checked against exact ranks."""
    ev = table(spark, d, "events").select("event_type", "value")
    points = [0.5, 0.95, 0.99]
    p = N.volume_percentiles(ev, ["event_type"], "value", points, 1000)
    joined = ev.join(F.broadcast(p), "event_type")  # one row per event type
    ranks = joined.groupBy("event_type").agg(
        F.max("n").alias("n"),
        *[F.count_if(F.col("value") <= F.col("percentiles")[i]).alias(f"r{i}") for i in range(len(points))],
    )
    off = [F.abs(F.col(f"r{i}") / F.col("n") - q) <= 0.005 for i, q in enumerate(points)]
    return ranks.select("event_type", "n", (off[0] & off[1] & off[2]).alias("within_rank_error"))


@query("j05_approx_distinct", "select event_type, count(distinct user_id)::bigint as exact, true as within_tolerance from events group by all")
def approx_distinct(spark, d):
    ev = table(spark, d, "events").select("event_type", "user_id")
    approx = N.approx_distinct(ev, ["event_type"], "user_id")
    exact = ev.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.ceil(F.col("exact") * 0.03)
    return approx.join(exact, "event_type").select("event_type", "exact", close.alias("within_tolerance"))


def _sketched(spark, d):
    """(events, path): sketches of every day, per event type and parity of the user, stored."""
    ev = table(spark, d, "events").withColumn("time", nanos("ts")).withColumn("odd", F.col("user_id") % 2)
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    K.store_days(K.daily_sketches(ev, ["event_type", "odd"], "value", "user_id"), path)
    return ev, path


@query(
    "j04_merged_baselines",
    """with e as (select *, epoch_us(ts) // 86400000000 as day from events), m as (select min(day) as first from e)
       select event_type, count(*)::bigint as events, count(value)::bigint as n, min(value)::double as lowest, max(value)::double as highest,
         count(distinct user_id)::bigint as users, true as within_rank_error, true as within_tolerance
       from e, m where day between first + 3 and first + 16 group by event_type""",
)
def merged_baselines(spark, d):
    """Two weeks of stored days merged to event types, without their events; checked against exact ranks and counts."""
    ev, path = _sketched(spark, d)
    first = spark.read.parquet(path).agg(F.min("day")).first()[0]
    points = [0.5, 0.95, 0.99]
    merged = K.with_estimates(K.merge_sketches(K.read_days(spark, path, first + 3, first + 16), ["event_type"]), points)
    day = F.expr("time div 86400000000000L")
    joined = ev.filter(day.between(first + 3, first + 16)).select("event_type", "value", "user_id").join(F.broadcast(merged), "event_type")  # one row per event type
    below = [F.count_if(F.col("value") < F.col("percentiles")[i]) / F.count("value") for i in range(3)]
    upto = [F.count_if(F.col("value") <= F.col("percentiles")[i]) / F.count("value") for i in range(3)]
    ranks = [(below[i] <= q + 0.01) & (upto[i] >= q - 0.01) for i, q in enumerate(points)]
    exact = F.count_distinct("user_id")
    out = joined.groupBy("event_type", "events", "n", "lowest", "highest").agg(
        exact.alias("users"),
        (ranks[0] & ranks[1] & ranks[2]).alias("within_rank_error"),
        (F.abs(F.max("distinct_entities") - exact) <= F.ceil(exact * 0.03)).alias("within_tolerance"),
    )
    return out


HOW = "((time // 3600000000000 + 72) % 168)"


@query(
    "j06_hour_of_week",
    f"""with {HIST}, h as (select distinct actor_user_uid as entity, {HOW} as hour from hist where status_id = 1),
        n as (select actor_user_uid as entity, count(*) as c from hist where status_id = 1 group by all),
        f as (select distinct actor_user_uid as entity, {HOW} as hour from cur where status_id = 1)
        select f.entity, f.hour::varchar as value from f join n using (entity) where c >= 3 and not exists (select 1 from h where h.entity = f.entity and h.hour = f.hour)""",
)
def hour_of_week(spark, d):
    ev = N.with_hour_of_week(auth_events(spark, d).filter(catalog.LOGIN_OK))
    attrs = {"hour_of_week": "hour_of_week"}
    seen, counts = D.warm_up(ev.filter(F.col("time") < SPLIT_NS), "actor_user_uid", attrs)
    fresh = D.observations(ev.filter(F.col("time") >= SPLIT_NS), "actor_user_uid", attrs)
    return D.novel(fresh, seen, counts, 3).select("entity", "value")


@query(
    "j07_password_spray",
    f"""with {AUTH}, u as (select cloud_asn, actor_user_uid, count(*) as t from auth where status_id = 2 group by all)
        select cloud_asn, count(*)::bigint as users, max(t)::bigint as max_tries, sum(t)::bigint as failures from u group by all having count(*) >= 10 and max(t) <= 2""",
)
def password_spray(spark, d):
    return N.password_spray(auth_events(spark, d).filter(catalog.LOGIN_FAILED), "cloud_asn", "actor_user_uid", 10, 2)


@query(
    "j08_login_velocity",
    f"""with {AUTH}, p as (select event_id, actor_user_uid, time, k - 50.0::double as lat, value % 180 as lon from auth where status_id = 1),
        l as (select *, lag(lat) over w as plat, lag(lon) over w as plon, lag(time) over w as pt from p window w as (partition by actor_user_uid order by time, event_id)),
        k as (select *, 2 * 6371.0::double * asin(least(1.0::double, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) as km from l)
        select event_id, round(km, 4) as km, round(km / ((time - pt) / 3600000000000.0::double), 4) as km_per_hour from k""",
)
def login_velocity(spark, d):
    ev = auth_events(spark, d).filter(catalog.LOGIN_OK).select("event_id", "actor_user_uid", "time", (F.col("k") - F.lit(50.0)).alias("lat"), (F.col("value") % 180).alias("lon"))
    return N.login_velocity(ev).select("event_id", F.round("km", 4).alias("km"), F.round("km_per_hour", 4).alias("km_per_hour"))


@query(
    "j09_dns_features",
    """with h as (select regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host from pages),
         n as (select host, count(*) as n from h group by all),
         l as (select host, n, string_split(host, '.') as ls from n),
         p as (select host, n, array_to_string(ls[greatest(len(ls) - 1, 1):], '.') as parent, array_to_string(ls[1:len(ls) - 2], '.') as sub, length(host) as len from l),
         c as (select host, unnest(string_split(sub, '')) as ch from p where sub <> ''),
         g as (select host, ch, count(*) as k from c group by host, ch), f as (select *, sum(k) over (partition by host) as t from g),
         e as (select host, -sum(k / t * log2(k / t)) as bits from f group by host)
       select parent, sum(n)::bigint as queries, count_if(sub <> '')::bigint as subdomains, round(sum(len * n) / sum(n), 6) as mean_length, max(len)::bigint as max_length,
         round(sum(coalesce(bits, 0) * n) / sum(n), 6) + 0.0 as mean_entropy from p left join e using (host) group by parent""",
)
def dns_features(spark, d):
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"))
    out = N.dns_features(hosts)
    return out.withColumn("mean_length", F.round("mean_length", 6)).withColumn("mean_entropy", F.round("mean_entropy", 6) + F.lit(0.0))


@query(
    "j10_both_within_window",
    f"""with {AUTH}, e as (select src_host_uid, event_type, time, time // 600000000000 as bucket from auth where event_type in ('error', 'purchase'))
        select distinct a.src_host_uid, greatest(a.bucket, b.bucket) as bucket from e a join e b on a.src_host_uid = b.src_host_uid and a.event_type = 'error' and b.event_type = 'purchase'
        and abs(a.time - b.time) <= 600000000000""",
)
def both_within_window(spark, d):
    return N.both_within(auth_events(spark, d), "src_host_uid", "event_type", "error", "purchase", 600_000_000_000)


@query(
    "j11_case_grouping",
    f"""with {AUTH}, g as (select actor_user_uid, time, (coalesce(time - lag(time) over (partition by actor_user_uid order by time, event_id) > 14400000000000, false))::int as o from auth),
        s as (select *, sum(o) over (partition by actor_user_uid order by time rows unbounded preceding) as island from g)
        select actor_user_uid, island::bigint as island, min(time)::bigint as start, max(time)::bigint as "end", count(*)::bigint as events from s group by actor_user_uid, island""",
)
def case_grouping(spark, d):
    out = N.group_cases(auth_events(spark, d), "actor_user_uid", "time", 14_400_000_000_000)
    return out.withColumn("island", F.col("island").cast("bigint"))


RISK_NOW = 1_706_745_600_000_000_000


@query(
    "j12_entity_risk",
    f"""with {AUTH} select actor_user_uid as entity, round(sum(k * ((event_id % 12 + 1) / 12.0::double) * exp(-greatest(0, {RISK_NOW} - time) / 604800000000000.0::double)), 4) as risk, count(*)::bigint as signals from auth group by all""",
)
def entity_risk(spark, d):
    s = auth_events(spark, d).select(F.col("actor_user_uid").alias("entity"), "time", F.col("k").alias("weight"), (F.col("event_id") % 12).alias("tactic_ordinal"))
    return N.entity_risk(s, RISK_NOW, 604_800_000_000_000.0).withColumn("risk", F.round("risk", 4))


TECHS = sorted({t for _, _, _, ts in PRICES.values() for t in ts})
RULED = sorted({t for r in catalog.ALL_RULES for t in r.techniques})


@query(
    "j13_coverage",
    f"""with {VERDICTS}, t as (select unnest([{', '.join(f"'{x}'" for x in TECHS)}]) as technique), f as (select distinct unnest(techs) as technique from verdicts),
        x as (select distinct unnest(w.techniques) as technique from claims c join weights w on w.predicate = c.predicate)
        select technique, technique in ({', '.join(f"'{x}'" for x in RULED)}) as has_rule, technique in (select technique from f) as has_fired, technique in (select technique from x) as has_telemetry from t""",
)
def coverage(spark, d):
    from .views import claims as claim_rows

    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "technique string")
    fired = _verdicts(spark, d).select(F.explode("attack_techniques").alias("technique"))
    known = spark.createDataFrame([(p, ts) for p, (_, _, _, ts) in PRICES.items()], "predicate string, ts array<string>")
    present = claim_rows(spark, d).select("predicate").distinct().join(F.broadcast(known), "predicate").select(F.explode("ts").alias("technique"))
    return N.coverage(one(TECHS), one(RULED), fired, present)


RETRO_END = 1_706_400_000_000_000_000  # 2024-01-28


@query(
    "j14_retro_hunt",
    f"""with {AUTH}, x as (select time // 86400000000000 as day, session_id from auth where status_id = 1 and session_id is not null and time < {RETRO_END} and time >= {RETRO_END} - 90 * 86400000000000
          group by all having count(distinct src_endpoint_ip) >= 2)
        select day, 'TOKEN_REPLAYED' as predicate, count(*)::bigint as detections from x group by day""",
)
def retro_hunt(spark, d):
    return N.retro_hunt(catalog.TOKEN_REPLAYED, auth_events(spark, d), RETRO_END)


@query(
    "j14_hunt_stored_history",
    f"""with {AUTH}, x as (select time // 86400000000000 as day, session_id from auth where status_id = 1 and session_id is not null and time < {RETRO_END} and time >= {RETRO_END} - 30 * 86400000000000
          group by all having count(distinct src_endpoint_ip) >= 2)
        select day, 'TOKEN_REPLAYED' as predicate, count(*)::bigint as detections from x group by day""",
)
def hunt_stored_history(spark, d):
    """Thirty days out of a history laid out by day."""
    path = scratch_path(spark, f"history-{uuid.uuid4().hex}")
    HISTORY.write_history(auth_events(spark, d), path, "session_id")
    past = HISTORY.read_history(spark, path, RETRO_END - 30 * N.DAY_NS, RETRO_END)
    return N.retro_hunt(catalog.TOKEN_REPLAYED, past, RETRO_END, 30)


@query(
    "j15_flip_measures",
    f"""with {SWEEP}, f as (select v.case_id, c.completed_at_ns, d.case_id is not null as flipped, c.o_orderkey % 3 = 0 as malicious from verdicts v join cases c using (case_id)
          left join (select * from drifts where new_disposition = 'malicious') d using (case_id) where v.disposition = 'benign')
        select count(*)::bigint as benign_closed, count_if(flipped)::bigint as flips, round(count_if(flipped) / count(*), 9) as flip_rate,
          round(count_if(flipped and malicious) / count_if(flipped), 9) as true_flip_rate, 90.0::double as mean_lead_days from f""",
)
def flip_measures(spark, d):
    """Swept ninety days after closing; cases with a key divisible by 3 are truly malicious."""
    done = closed(spark, d)
    swept = done.select("case_id", (F.col("completed_at_ns") + F.lit(90 * N.DAY_NS)).alias("swept_at_ns"))
    truth = cases(spark, d).select("case_id", (F.substring("case_id", 6, 20).cast("bigint") % 3 == 0).alias("malicious"))
    out = N.flip_measures(done, _drifts(spark, d).join(swept, "case_id"), truth)
    return out.select("benign_closed", "flips", *[F.round(c, 9).alias(c) for c in ("flip_rate", "true_flip_rate", "mean_lead_days")])


@query(
    "j15_run_variance",
    f"""with {VERDICTS}, r as (select case_id, disposition, severity from verdicts union all select case_id, case when contributing_count % 2 = 1 then 'malicious' else disposition end, severity from verdicts)
        select case_id, 2::bigint as runs, min(disposition) <> max(disposition) as disposition_varies, min(severity) <> max(severity) as severity_varies from r group by case_id""",
)
def run_variance(spark, d):
    v = _verdicts(spark, d).select("case_id", "disposition", "severity", "contributing_count")
    other = v.withColumn("disposition", F.when(F.col("contributing_count") % 2 == 1, "malicious").otherwise(F.col("disposition")))
    runs = v.withColumn("run", F.lit(1)).unionByName(other.withColumn("run", F.lit(2)))
    return N.run_variance(runs)


@query(
    "j15_technique_jaccard",
    f"""with {VERDICTS} select case_id, round(case when len(list_distinct(list_concat(techs, ['T1078']))) = 0 then 0 else 1 - len(list_intersect(techs, ['T1078'])) / len(list_distinct(list_concat(techs, ['T1078']))) end, 9)::double as distance from verdicts""",
)
def technique_jaccard(spark, d):
    """Distance of every case's techniques from one reference list."""
    dist = N.jaccard_distance(F.col("attack_techniques"), F.array(F.lit("T1078")))
    return _verdicts(spark, d).select("case_id", F.round(dist, 9).alias("distance"))


@query(
    "j15_detection_quality",
    """with s as (select source, n_chars > 2000 as p, l.quality = 1 as a from documents d join labels l using (doc_id)),
         c as (select source, count_if(p and a)::bigint as tp, count_if(p and not a)::bigint as fp, count_if(not p and a)::bigint as fn, count_if(not p and not a)::bigint as tn from s group by all)
       select *, round(case when tp + fp > 0 then tp / (tp + fp) end, 9)::double as precision, round(case when tp + fn > 0 then tp / (tp + fn) end, 9)::double as tpr,
         round(case when fp + tn > 0 then fp / (fp + tn) end, 9)::double as fpr from c""",
)
def detection_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") > 2000).alias("predicted"))
    truth = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("actual"))
    out = N.detection_quality(docs.join(truth, "doc_id"), ["source"])
    return out.select("source", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "tpr", "fpr")])


@query("j15_mean_time_to_detect", "select round(avg((o_orderkey % 1000)::double), 6) as mttd_seconds, count(*)::bigint as cases from orders")
def mean_time_to_detect(spark, d):
    out = N.mean_time_to_detect(cases(spark, d), "started_at_ns", "completed_at_ns")
    return out.withColumn("mttd_seconds", F.round("mttd_seconds", 6))


@query("j15_alert_reduction", "select (select count(*) from lineitem)::bigint as fires, (select count(*) from orders)::bigint as cases, round((select count(*) from lineitem)::double / (select count(*) from orders), 9) as reduction_ratio")
def alert_reduction(spark, d):
    from .views import claims as claim_rows

    return N.alert_reduction(claim_rows(spark, d), cases(spark, d)).withColumn("reduction_ratio", F.round("reduction_ratio", 9))


SPIKE = f"""{GATE},
  rates as (select c.tenant_id, c.closed_seq // 50 as win, count(*)::bigint as claims, count(reason)::bigint as rejections, count(reason) / count(*) as rate from judged j join cases c using (case_id) group by all),
  med as (select tenant_id, median(rate) as m from rates group by all),
  mad as (select tenant_id, median(abs(rate - m)) as mad from rates join med using (tenant_id) group by all)"""


@query(
    "j16_rejection_spikes",
    f"""with {SPIKE} select tenant_id, win, claims, rejections, round((rate - m) / nullif(mad * 1.4826::double, 0), 5) as robust_z, coalesce((rate - m) / nullif(mad * 1.4826::double, 0) > 1.5, false) as spike
        from rates join med using (tenant_id) join mad using (tenant_id)""",
)
def rejection_spikes(spark, d):
    good, bad = _gate(spark, d)
    rows = good.select("case_id", F.lit(False).alias("rejected")).unionByName(bad.select("case_id", F.lit(True).alias("rejected")))
    keyed = rows.join(cases(spark, d).select("case_id", "tenant_id", F.expr("closed_seq div 50").alias("win")), "case_id")
    out = N.rejection_spikes(keyed, ["tenant_id"], "win", 1.5)
    return out.select("tenant_id", "win", "claims", "rejections", F.round("robust_z", 5).alias("robust_z"), "spike")


@query(
    "j17_autonomy_preview",
    f"""with {BOARD}, a as (select tenant_id, ([{K_LIST}])[(o_orderkey % 5)::int + 1] as kind, updated_at_ms from board where severity in ('high', 'critical'))
        select tenant_id, kind, count(*)::bigint as would_have_run from a where updated_at_ms > {NOW_MS} - 30 * 86400000::bigint and updated_at_ms <= {NOW_MS} and kind in ('isolate_host', 'revoke_session') group by all""",
)
def autonomy_preview(spark, d):
    kinds = ", ".join(f"'{k}'" for k in RESPONSE_KINDS)
    hot = board(spark, d).filter("severity in ('high', 'critical')")
    actions = hot.select("tenant_id", F.expr(f"element_at(array({kinds}), cast(o_orderkey % 5 as int) + 1)").alias("kind"), F.col("updated_at_ms").alias("proposed_at_ms"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("tenant_id"))
    enabled = nations.withColumn("kind", F.explode(F.array(F.lit("isolate_host"), F.lit("revoke_session"))))
    return N.autonomy_preview(actions, enabled, NOW_MS)
