"""Correlation rules as data, and the DataFrame plan that evaluates one.

Conditions are Spark SQL text.  ``where`` sees the flat event columns; ``when``, ``observed`` and
suppress conditions see one struct per source (``failures.count``, ``failures.last_user_type``) and
one boolean per declared novelty check.  An unknown name fails at analysis time.

Sources that group by all fields of the case share one scan, as conditional aggregates.  In batch, a
source with fewer group fields is one more scan with its ``where`` pushed down to the files, folded
before the shuffle and joined back on the fields it shares.  On a stream it is rolled up from the
partial aggregates instead, which all can be merged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = "time"
TIEBREAK = "event_id"


@dataclass(frozen=True)
class Source:
    where: str
    group_by: tuple[str, ...]
    track_last: tuple[str, ...] = ()
    track_distinct: tuple[str, ...] = ()


@dataclass(frozen=True)
class Emit:
    predicate: str
    when: str
    observed: str | None = None


@dataclass(frozen=True)
class Novelty:
    """``name`` becomes a boolean: ``value`` is new for (entity, attribute) and history is long enough."""

    name: str
    entity: str
    attribute: str
    value: str
    threshold: int


@dataclass(frozen=True)
class Rule:
    id: str
    version: int
    entity: str
    sources: Mapping[str, Source]
    emits: Sequence[Emit]
    suppress: Sequence[tuple[str, str]] = ()
    novelty: Sequence[Novelty] = ()
    observations: Mapping[str, str] = field(default_factory=dict)
    title: str = ""
    severity: str = "medium"
    tactics: Sequence[str] = ()
    techniques: Sequence[str] = ()
    window: str = "15 minutes"

    def union_keys(self) -> list[str]:
        out: list[str] = []
        for name in sorted(self.sources):
            out += [k for k in self.sources[name].group_by if k not in out]
        return out


def _hit(source: Source) -> Column:
    return F.coalesce(F.expr(source.where), F.lit(False))


def _newest(name: str, f: str) -> str:
    return f"_{name}__last__{f}"


def _partials(name: str, source: Source) -> list[Column]:
    hit = _hit(source)
    cols = [
        F.count_if(hit).alias(f"_{name}__count"),
        F.min(F.when(hit, F.col(TIME))).alias(f"_{name}__first_ts"),
        F.max(F.when(hit, F.col(TIME))).alias(f"_{name}__last_ts"),
    ]
    for f in source.track_last:
        newest = F.struct(F.col(TIME).alias("t"), F.col(TIEBREAK).alias("k"), F.col(f).alias("v"))
        cols.append(F.max(F.when(hit & F.col(f).isNotNull(), newest)).alias(_newest(name, f)))
    return cols


def _rollup(name: str, source: Source) -> list[Column]:
    cols = [
        F.sum(f"_{name}__count").alias(f"_{name}__count"),
        F.min(f"_{name}__first_ts").alias(f"_{name}__first_ts"),
        F.max(f"_{name}__last_ts").alias(f"_{name}__last_ts"),
    ]
    return cols + [F.max(_newest(name, f)).alias(_newest(name, f)) for f in source.track_last]


def _pack(name: str, source: Source) -> Column:
    count = F.coalesce(F.col(f"_{name}__count"), F.lit(0))
    parts = [
        count.alias("count"),
        (count > 0).alias("exists"),
        F.col(f"_{name}__first_ts").alias("first_ts"),
        F.col(f"_{name}__last_ts").alias("last_ts"),
    ]
    parts += [F.col(_newest(name, f) + ".v").alias(f"last_{f}") for f in source.track_last]
    parts += [
        F.coalesce(F.col(f"_{name}__distinct__{f}"), F.lit(0)).alias(f"distinct_{f}") for f in source.track_distinct
    ]
    parts += [F.col(k).alias(k) for k in source.group_by]
    return F.struct(*parts).alias(name)


def source_aggregates(events: DataFrame, source: Source) -> DataFrame:
    """The aggregates of one source by its own group fields, flat columns, matched groups only."""
    keys = list(source.group_by)
    out = (
        events.filter(source.where)
        .dropna(subset=keys)
        .groupBy(*keys)
        .agg(*_partials("s", source))
    )
    for f in source.track_distinct:
        pairs = events.filter(source.where).filter(F.col(f).isNotNull()).select(*keys, F.col(f).alias("_value"))
        out = out.join(_count_pairs(pairs, keys, "s", f), keys, "left")
    packed = out.select(_pack("s", source)).select("s.*")
    return packed.select(*keys, *[c for c in packed.columns if c not in keys])


def cases(events: DataFrame, sources: Mapping[str, Source]) -> DataFrame:
    """Distinct complete combinations of the union of all group fields, from all events."""
    keys = Rule("", 0, "", sources, ()).union_keys()
    return events.select(*keys).dropna().distinct()


def partial_aggregates(rule: Rule, events: DataFrame, by: Sequence[str] = (), tracked: bool = True) -> DataFrame:
    """Conditional aggregates of every source on (by, union keys), with the tracked distinct fields as
    further keys if ``tracked``.  All of it can be merged, so this is what a stream keeps as state."""
    keys = [*by, *rule.union_keys(), *(_distinct_fields(rule) if tracked else [])]
    return events.groupBy(*keys).agg(*[c for n, s in sorted(rule.sources.items()) for c in _partials(n, s)])


def _distinct_fields(rule: Rule) -> list[str]:
    union = rule.union_keys()
    out: list[str] = []
    for s in rule.sources.values():
        out += [f for f in s.track_distinct if f not in out and f not in union]
    return out


def _count_pairs(pairs: DataFrame, own: list[str], name: str, f: str) -> DataFrame:
    """Distinct values per group from (group, value) rows, folded before the shuffle."""
    return pairs.distinct().groupBy(*own).agg(F.count(F.lit(1)).alias(f"_{name}__distinct__{f}"))


def _join_sources(rule: Rule, base: DataFrame, by: Sequence[str], coarse, pairs) -> DataFrame:
    """Cases of ``base`` with a struct per source; ``coarse`` and ``pairs`` supply what base lacks."""
    keys = [*by, *rule.union_keys()]
    out = base.dropna(subset=keys)
    for name, source in sorted(rule.sources.items()):
        own = [*by, *source.group_by]
        if set(own) != set(keys):
            mine = [c for c in base.columns if c.startswith(f"_{name}__")]
            out = out.drop(*mine).join(coarse(name, source, own), own, "left")
        for f in source.track_distinct:
            out = out.join(_count_pairs(pairs(name, source, own, f), own, name, f), own, "left")
    return out.select(*keys, *[_pack(n, s) for n, s in sorted(rule.sources.items())])


def finish(rule: Rule, partial: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per case with a struct per source, from partial aggregates alone."""
    keys = [*by, *rule.union_keys()]
    base = partial
    if _distinct_fields(rule):
        base = partial.groupBy(*keys).agg(*[c for n, s in sorted(rule.sources.items()) for c in _rollup(n, s)])

    def coarse(name, source, own):
        return base.groupBy(*own).agg(*_rollup(name, source))

    def pairs(name, source, own, f):
        return partial.filter((F.col(f"_{name}__count") > 0) & F.col(f).isNotNull()).select(*own, F.col(f).alias("_value"))

    return _join_sources(rule, base, by, coarse, pairs)


def correlate(rule: Rule, events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per case with a struct per source.  ``by`` adds key columns, such as a time window."""

    def coarse(name, source, own):
        return events.filter(source.where).groupBy(*own).agg(*_partials(name, source))

    def pairs(name, source, own, f):
        return events.filter(source.where).filter(F.col(f).isNotNull()).select(*own, F.col(f).alias("_value"))

    return _join_sources(rule, partial_aggregates(rule, events, by, tracked=False), by, coarse, pairs)


def correlate_aggregates(case_rows: DataFrame, aggregates: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-join separately computed source aggregates to the cases on the keys each of them has."""
    out = case_rows
    for name, (agg, keys) in sorted(aggregates.items()):
        keys = list(keys)
        packed = agg.select(*keys, F.struct(*[F.col(c) for c in agg.columns]).alias(name))
        out = out.join(packed, keys, "left")
    return out


def _with_novelty(rule: Rule, frame: DataFrame, seen: DataFrame, counts: DataFrame) -> DataFrame:
    for check in rule.novelty:
        frame = frame.withColumn("_entity", F.expr(check.entity).cast("string")).withColumn(
            "_value", F.expr(check.value).cast("string")
        )
        known = seen.filter(F.col("attribute") == check.attribute).select(
            F.col("entity").alias("_entity"), F.col("value").alias("_value"), F.lit(True).alias("_known")
        )
        totals = counts.filter(F.col("attribute") == check.attribute).select(
            F.col("entity").alias("_entity"), F.col("observations").alias("_obs")
        )
        frame = (
            frame.join(known, ["_entity", "_value"], "left")
            .join(totals, "_entity", "left")
            .withColumn(
                check.name,
                F.col("_value").isNotNull()
                & (F.coalesce(F.col("_obs"), F.lit(0)) >= check.threshold)
                & F.col("_known").isNull(),
            )
            .drop("_entity", "_value", "_known", "_obs")
        )
    return frame


def judge_frame(rule: Rule, frame: DataFrame, baseline: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Adds novelty booleans and ``suppress_reason`` (NULL when no clause matches) to correlated cases."""
    if rule.novelty:
        if baseline is None:
            raise ValueError(f"rule {rule.id} checks novelty and needs a baseline")
        frame = _with_novelty(rule, frame, *baseline)
    reason = F.lit(None).cast("string")
    for cond, text in reversed(list(rule.suppress)):
        reason = F.when(F.coalesce(F.expr(cond), F.lit(False)), F.lit(text)).otherwise(reason)
    return frame.withColumn("suppress_reason", reason)


def judged(rule: Rule, events: DataFrame, baseline: tuple[DataFrame, DataFrame] | None = None, by: Sequence[str] = ()) -> DataFrame:
    return judge_frame(rule, correlate(rule, events, by), baseline)


def suppressed(rule: Rule, events: DataFrame, baseline=None) -> DataFrame:
    """Audit output: the cases a suppress clause dropped, with the reason."""
    frame = judged(rule, events, baseline).filter("suppress_reason is not null")
    return frame.select(F.lit(rule.id).alias("rule_id"), *rule.union_keys(), "suppress_reason")


def evaluate(rule: Rule, events: DataFrame, baseline=None, by: Sequence[str] = ()) -> DataFrame:
    """Detections: one row per unsuppressed case and matching emit.

    ``observed`` is text (integers plain); the group-field struct ``case_key`` and the interval of
    the matched events are kept so a detection can be traced back to its evidence.
    """
    return detections_from(rule, judged(rule, events, baseline, by), by)


def detections_from(rule: Rule, frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detections of judged cases."""
    live = frame.filter("suppress_reason is null")
    names = sorted(rule.sources)
    first = F.least(*[F.col(f"{n}.first_ts") for n in names], F.lit(None).cast("bigint"))
    last = F.greatest(*[F.col(f"{n}.last_ts") for n in names], F.lit(None).cast("bigint"))
    hits = [
        F.when(
            F.coalesce(F.expr(e.when), F.lit(False)),
            F.struct(
                F.lit(e.predicate).alias("predicate"),
                (F.expr(e.observed).cast("string") if e.observed else F.lit(None).cast("string")).alias("observed"),
            ),
        )
        for e in rule.emits
    ]
    return (
        live.withColumn("_hit", F.explode(F.array(*hits)))
        .filter("_hit is not null")
        .select(
            *by,
            F.col("_hit.predicate").alias("predicate"),
            F.col(rule.entity).cast("string").alias("entity"),
            F.col("_hit.observed").alias("observed"),
            F.lit(rule.id).alias("rule_id"),
            F.lit(rule.version).cast("int").alias("rule_version"),
            F.struct(*rule.union_keys()).alias("case_key"),
            first.alias("first_ts"),
            last.alias("last_ts"),
        )
    )
