"""Detection: baselines, novelty, claim sets and rule quality reports around ``plans.rules``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_json
from ..functions.scalar import render_key
from ..plans import catalog
from ..plans.digest import set_digest
from ..plans.rules import Rule, detections_from, evaluate, judge_frame
from ..plans.ruleset import correlate_all, union_all


def observations(history: DataFrame, entity: str, attributes: Mapping[str, str]) -> DataFrame:
    """(entity, attribute, value) rows; absent entities and values are not observed."""
    pairs = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("value")) for a, c in attributes.items()]
    )
    return (
        history.filter(F.col(entity).isNotNull())
        .select(F.col(entity).cast("string").alias("entity"), F.explode(pairs).alias("o"))
        .select("entity", "o.attribute", "o.value")
        .filter("value is not null")
    )


def warm_up(history: DataFrame, entity: str, attributes: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Baseline tables: values seen (with how often), and observation counts per (entity, attribute)."""
    seen = (
        observations(history, entity, attributes)
        .groupBy("entity", "attribute", "value")
        .agg(F.count(F.lit(1)).alias("times_seen"))
    )
    counts = seen.groupBy("entity", "attribute").agg(F.sum("times_seen").alias("observations"))
    return seen, counts


def novel(df: DataFrame, seen: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Distinct (entity, attribute, value) of ``df`` never seen, where history has ``threshold`` observations."""
    fresh = df.select("entity", "attribute", "value").distinct().join(seen, ["entity", "attribute", "value"], "left_anti")
    known = fresh.join(counts, ["entity", "attribute"], "left")
    return known.filter(F.coalesce("observations", F.lit(0)) >= threshold).select("entity", "attribute", "value")


def baseline_snapshot(seen: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Per entity: attribute count, value count, snapshot hash.  Independent of arrival order."""
    values = set_digest(seen, ["entity", "attribute"], F.col("value"), out="values_digest", count="distinct_values")
    per_attribute = values.join(counts, ["entity", "attribute"])
    # one row per attribute of the baseline configuration: the array is short by construction
    part = F.struct("attribute", "observations", "values_digest")
    return per_attribute.groupBy("entity").agg(
        F.count(F.lit(1)).alias("attributes"),
        F.sum("distinct_values").alias("distinct_values"),
        F.sha2(
            F.to_json(F.struct(F.lit(threshold).alias("warmup_threshold"), F.array_sort(F.collect_list(part)).alias("a"))), 256
        ).alias("snapshot_hash"),
    )


def store_snapshot(snapshots: DataFrame) -> DataFrame:
    """One hash over every entity's snapshot."""
    item = content_json(F.col("entity"), F.col("snapshot_hash"))
    return set_digest(snapshots, [], item, out="store_hash", count="entities")


def claim_keys(detections: DataFrame) -> DataFrame:
    """The flat comparable form of detections."""
    return detections.select(
        "predicate",
        render_key(F.col("entity")).alias("entity"),
        render_key(F.col("observed")).alias("observed"),
        "rule_id",
        "rule_version",
    )


def predicate_set(detections: DataFrame) -> DataFrame:
    return detections.select("predicate").distinct().orderBy("predicate")


def compare_claims(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference of two claim sets: rows of one side with how many copies the other lacks.

    Copies are counted before the comparison, so equal claims never meet in one task.
    """
    keys = a.columns
    left = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("d", F.col("n"))
    right = b.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("d", -F.col("n"))
    diff = left.unionByName(right).groupBy(*keys).agg(F.sum("d").alias("d")).filter("d <> 0")
    side = F.when(F.col("d") > 0, F.lit("only_left")).otherwise(F.lit("only_right"))
    return diff.select(*keys, side.alias("side"), F.abs("d").alias("copies"))


def expectations(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per (rule, fixture): predicates missing, unexpected, and whether the fixture passed.

    Predicates per rule are a short fixed list, so the arrays are short.
    """
    keys = ["rule_id", "fixture", "predicate"]
    got = results.select(*keys).distinct().withColumn("got", F.lit(True))
    want = expected.select(*keys).distinct().withColumn("want", F.lit(True))
    both = got.join(want, keys, "full_outer")
    missing = F.array_sort(F.collect_set(F.when(F.col("got").isNull(), F.col("predicate"))))
    extra = F.array_sort(F.collect_set(F.when(F.col("want").isNull(), F.col("predicate"))))
    return (
        both.filter("predicate is not null or want")
        .groupBy("rule_id", "fixture")
        .agg(missing.alias("missing"), extra.alias("unexpected"))
        .withColumn("passed", (F.size("missing") == 0) & (F.size("unexpected") == 0))
    )


def _baseline(rule: Rule, history: DataFrame | None) -> tuple[DataFrame, DataFrame] | None:
    return warm_up(history, rule.entity, rule.observations) if rule.novelty and history is not None else None


def detections_of(rules: Iterable[Rule], events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Claims of several rules over the same events, read once for each set of keys; novelty is judged by ``history``."""
    found = correlate_all(rules, events)
    return union_all(claim_keys(detections_from(rule, judge_frame(rule, cases, _baseline(rule, history)))) for rule, cases, _ in found)


def fp_rate(rules: Iterable[Rule], benign: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Claims per rule on events known to be benign, over the rule's number of cases.

    The events are read once for each set of keys.  Without a ``history``, the events themselves are the baseline.
    """
    sides = []
    for rule, cases, shared in correlate_all(rules, benign):
        fired = detections_from(rule, judge_frame(rule, cases, _baseline(rule, benign if history is None else history)))
        known = shared.select(*rule.union_keys()).dropna().distinct()
        for rows, name in ((fired, "claims"), (known, "cases")):
            sides.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule.id).alias("rule_id"), F.lit(name).alias("side"), "n"))
    counted = union_all(sides).groupBy("rule_id").pivot("side", ["claims", "cases"]).agg(F.first("n"))
    return counted.withColumn("fp_rate", F.try_divide(F.col("claims").cast("double"), F.col("cases")))


def auth_burst(events: DataFrame) -> DataFrame:
    return evaluate(catalog.AUTH_BURST, events)


def auth_new_asn(events: DataFrame, history: DataFrame) -> DataFrame:
    rule = catalog.AUTH_NEW_ASN
    return evaluate(rule, events, warm_up(history, rule.entity, rule.observations))


def impossible_travel(events: DataFrame) -> DataFrame:
    return evaluate(catalog.IMPOSSIBLE_TRAVEL, events)


def token_replayed(events: DataFrame) -> DataFrame:
    return evaluate(catalog.TOKEN_REPLAYED, events)


def persistence(events: DataFrame) -> DataFrame:
    return evaluate(catalog.PERSISTENCE, events)


def rdp_first_time(events: DataFrame, history: DataFrame) -> DataFrame:
    rule = catalog.RDP_FIRST_TIME
    return evaluate(rule, events, warm_up(history, rule.entity, rule.observations))


def _source_key(source_keys, at=None) -> Column:
    cols = [F.col(k) if at is None else F.col(at)[k].alias(k) for k in source_keys]
    return F.to_json(F.struct(*cols))


def matched_evidence(rule: Rule, events: DataFrame, detections: DataFrame, evidence_col: str = "evidence_id") -> DataFrame:
    """(source, source_key, evidence_id) rows: the events each source matched for groups that fired.

    Kept per source group, not per detection: several detections may share a coarse source, and an
    event is listed once however many detections cite its group.
    """
    out = None
    for name, source in sorted(rule.sources.items()):
        keys = list(source.group_by)
        fired = detections.select(_source_key(keys, "case_key").alias("source_key")).distinct()
        rows = (
            events.filter(F.expr(source.where))
            .select(F.lit(name).alias("source"), _source_key(keys).alias("source_key"), F.col(evidence_col).alias("evidence_id"))
            .join(fired, "source_key", "left_semi")
            .select("source", "source_key", "evidence_id")
        )
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def evidence_sets(evidence: DataFrame) -> DataFrame:
    """One content id and member count per source group."""
    sets = set_digest(evidence, ["source", "source_key"], F.col("evidence_id"), out="_d", count="members")
    return sets.select("source", "source_key", F.concat(F.lit("sha256:"), "_d").alias("evidence_set_id"), "members")


def with_detection_id(detections: DataFrame) -> DataFrame:
    key: Column = content_json("rule_id", "rule_version", "predicate", F.to_json("case_key").alias("case_key"))
    return detections.withColumn("detection_id", F.sha2(key, 256))


def detections_to_claims(rule: Rule, detections: DataFrame, sets: DataFrame) -> DataFrame:
    """Detections as scoring claims, with the interval of the matched events and the rule as extractor.

    A claim cites one evidence-set id per source; the members stay in the ``matched_evidence`` rows,
    so a claim's size does not depend on how busy its entity was.
    """
    out = with_detection_id(detections)
    for name, source in sorted(rule.sources.items()):
        mine = sets.filter(F.col("source") == name).select(
            F.col("source_key").alias("_k"), F.col("evidence_set_id").alias(f"_set_{name}"), F.col("members").alias(f"_n_{name}")
        )
        out = out.withColumn("_k", _source_key(source.group_by, "case_key")).join(mine, "_k", "left").drop("_k")
    names = sorted(rule.sources)
    total = sum((F.coalesce(F.col(f"_n_{n}"), F.lit(0)) for n in names), F.lit(0))
    return out.select(
        F.col("detection_id").alias("case_id"),
        "predicate",
        F.col("entity").alias("subject"),
        F.lit(None).cast("string").alias("object"),
        F.col("first_ts").alias("interval_start_ns"),
        F.col("last_ts").alias("interval_end_ns"),
        F.array_compact(F.array(*[F.col(f"_set_{n}") for n in names])).alias("evidence"),
        F.lit("rule").alias("extractor_kind"),
        F.col("rule_id").alias("extractor_id"),
        F.col("rule_version").cast("string").alias("extractor_version"),
        F.expr("try_cast(observed as bigint)").alias("observed_value"),
        F.lit("supports").alias("polarity"),
        F.lit(None).cast("string").alias("hypothesis_ref"),
        total.cast("bigint").alias("evidence_count"),
    )
