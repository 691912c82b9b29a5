"""Replay of closed cases and drift of their verdicts.

``closed`` is (tenant_id, case_id, policy_version, kernel_version, severity, disposition, confidence,
verdict_hash, completed_at_ns, ...).  Stored claims enter as claim groups (``adjudicate.claim_groups``)
wherever only scores and hashes are needed.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import content_json, sha_hex
from ..plans.digest import crowded, packed, split, unpacked
from ..session import plan_bytes, settle, small, stored
from . import adjudicate as A
from .identity import corpus_hash, with_claim_id


STORED_BYTES = 4 << 20  # a compressed table up to which its rows are sent to every executor


def replay_pin(closed: DataFrame, groups: DataFrame, policy: A.Policy) -> DataFrame:
    """Re-score every closed case under its own policy and kernel version and compare verdict hashes."""
    again = A.score_groups(closed.select("case_id", "policy_version", "kernel_version"), groups, policy)
    both = closed.select("case_id", F.col("verdict_hash").alias("original_verdict_hash")).join(
        again.select("case_id", F.col("verdict_hash").alias("replayed_verdict_hash")), "case_id"
    )
    same = F.col("original_verdict_hash") == F.col("replayed_verdict_hash")
    return both.withColumn("verdict_hash_matches", same)


ASSERTION = ["predicate", "subject", "object", "interval_start_ns", "interval_end_ns", "evidence", "polarity"]


def _assertions(claims: DataFrame) -> DataFrame:
    cols = [F.array_sort(F.coalesce("evidence", F.array().cast("array<string>"))).alias("evidence") if c == "evidence" else F.col(c) for c in ASSERTION]
    return claims.select("case_id", F.unhex(sha_hex(content_json(*cols))).alias("assertion"))


def rederive_claims(original: DataFrame, rederived: DataFrame) -> DataFrame:
    """(case_id, assertion, change): added, removed or unchanged.

    Set semantics on seven fields: extractor, observed value and hypothesis do not count, evidence order neither.
    """
    sides = _assertions(original).withColumn("_b", F.lit(False)).unionByName(_assertions(rederived).withColumn("_b", F.lit(True)))
    # a claim without a case equals no other, as in a join; all others meet in one shuffle, by case if none is crowded
    alone = F.when(F.col("case_id").isNull(), F.col("_b"))
    sides = sides.withColumn("_alone", alone)
    few, many = split(sides, ["case_id"], crowded(original.select("case_id").unionByName(rederived.select("case_id")), ["case_id"])[0])
    rows = _met(few.repartition("case_id"))
    return rows if many is None else rows.unionByName(_met(many))


def _met(sides: DataFrame) -> DataFrame:
    both = sides.groupBy("case_id", "assertion", "_alone").agg(F.max(~F.col("_b")).alias("_old"), F.max("_b").alias("_new"))
    change = F.when(~F.col("_old"), "added").when(~F.col("_new"), "removed").otherwise("unchanged")
    return both.select("case_id", F.lower(F.hex("assertion")).alias("assertion"), change.alias("change"))


def replay_rederive(closed: DataFrame, original: DataFrame, rederived: DataFrame, policy: A.Policy, kernel_version: str) -> DataFrame:
    """Per case: claims added, removed, unchanged, and whether the disposition moved."""
    diff = rederive_claims(original, rederived).groupBy("case_id").agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged"),
    )
    again = A.score_groups(closed.select("case_id", "policy_version"), A.claim_counts(rederived), policy, kernel_version)
    out = (
        closed.select("case_id", F.col("disposition").alias("original_disposition"))
        .join(again.select("case_id", F.col("disposition").alias("rederived_disposition")), "case_id")
        .join(diff, "case_id", "left")
    )
    for c in ("added", "removed", "unchanged"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out.withColumn("disposition_changed", F.col("original_disposition") != F.col("rederived_disposition"))


def first_entries(corpus: DataFrame) -> DataFrame:
    """The corpus with the first entry per (version, predicate, value)."""
    entry = F.struct("position", "weight", "techniques")
    kept = corpus.groupBy("corpus_version", "predicate", "value").agg(F.min_by(entry, "position").alias("_e"))
    return kept.select("corpus_version", "predicate", "value", "_e.weight", "_e.techniques")


def match_indicators(claims: DataFrame, corpus: DataFrame, corpus_version: str) -> DataFrame:
    """Claims whose (predicate, object) is in one version of the corpus, with the indicator's weight and techniques.

    Claims without an object never match.  ``claim_seq`` is the submission order in a case.
    """
    named = claims if "claim_id" in claims.columns else with_claim_id(claims)
    # written, so that its size is known; claims of other predicates need not meet it
    entries = stored(first_entries(corpus.filter(F.col("corpus_version") == corpus_version)).withColumnRenamed("value", "object"), "entries")
    kinds = small(entries.select("predicate").distinct())
    mine = named.filter("object is not null").join(kinds, "predicate", "left_semi")
    hit = mine.join(small(entries, STORED_BYTES), ["predicate", "object"])
    return hit.select(
        "case_id", "claim_id", "claim_seq", "predicate", F.col("object").alias("indicator_value"), "weight", "techniques", "corpus_version"
    )


def _by_predicate(matches: DataFrame, weights: DataFrame, policy_version: str) -> DataFrame:
    """One row per matched (case, predicate) with its problem, if any; matches fold before the shuffle."""
    current = weights.filter(F.col("policy_version") == policy_version).select(
        "predicate", "tactic", F.col("weight").alias("old_weight"), F.col("techniques").alias("old_techniques")
    )
    folded = matches.groupBy("case_id", "predicate").agg(
        F.min("weight").alias("_lo"),
        F.max("weight").alias("new_weight"),
        F.max_by("techniques", F.struct("claim_seq", "claim_id")).alias("new_techniques"),
        F.count(F.lit(1)).alias("matches"),
    )
    problem = F.when(F.col("_lo") != F.col("new_weight"), "conflicting_weights").when(F.col("tactic").isNull(), "not_in_policy")
    return folded.join(small(current), "predicate", "left").withColumn("problem", problem)


def reprice_conflicts(matches: DataFrame, weights: DataFrame, policy_version: str) -> DataFrame:
    """Error rows (case_id, predicate, problem): two weights for one predicate, or an unregistered predicate."""
    return _by_predicate(matches, weights, policy_version).filter("problem is not null").select("case_id", "predicate", "problem")


def reprice(matches: DataFrame, weights: DataFrame, policy_version: str) -> DataFrame:
    """Per matched (case, predicate): old and new weight, techniques, tactic.

    The tactic comes from the policy.  With equal weights the last match's techniques win; without any
    the policy's stay.  Cases with a conflict are left out whole; ``reprice_conflicts`` lists them.
    """
    rows = _by_predicate(matches, weights, policy_version)
    # a case has at most one row per predicate, so this window is bounded by the policy
    bad = F.max(F.col("problem").isNotNull()).over(Window.partitionBy("case_id"))
    techniques = F.when(F.size("new_techniques") > 0, F.col("new_techniques")).otherwise(F.col("old_techniques"))
    return (
        rows.withColumn("_bad", bad)
        .filter("not _bad")
        .select("case_id", "predicate", "tactic", "old_weight", "new_weight", techniques.alias("new_techniques"), "matches")
    )


def drift_sweep(
    closed: DataFrame,
    claims: DataFrame,
    policy: A.Policy,
    policy_version: str,
    corpus: DataFrame,
    corpus_version: str,
    kernel_version: str,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Closed cases whose disposition or severity changes under the current policy and one version of the corpus.

    Only cases with a match are scored again; ``policy_deltas`` has one entry per repriced predicate with
    its number of matching claims, and the matching claims themselves are ``responsible_claims`` rows.
    """
    matches = match_indicators(claims, corpus, corpus_version)
    overlay = stored(reprice(matches, policy.weights, policy_version), "overlay")  # small, and used three times
    touched = overlay.select("case_id").distinct()
    again = closed.join(touched, "case_id", "left_semi").select("case_id", F.lit(policy_version).alias("policy_version"))
    if groups is None:
        # few cases are sent to the claims; of many, claims are dealt by case anyway, and scoring drops the other cases' groups
        few = plan_bytes(touched) <= STORED_BYTES
        groups = A.claim_groups(claims.join(F.broadcast(touched), "case_id", "left_semi") if few else claims)
    fresh = A.score_groups(again, groups, policy, kernel_version, overlay.select("case_id", "predicate", "new_weight", "new_techniques"))
    deltas = overlay.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("predicate", "old_weight", "new_weight", "matches"))).alias("policy_deltas"),
        F.sum("matches").alias("responsible_count"),
    )
    old = closed.select(
        "tenant_id",
        "case_id",
        F.col("severity").alias("old_severity"),
        F.col("disposition").alias("old_disposition"),
        F.col("verdict_hash").alias("old_verdict_hash"),
    )
    new = fresh.select(
        "case_id",
        F.col("severity").alias("new_severity"),
        F.col("disposition").alias("new_disposition"),
        F.col("verdict_hash").alias("new_verdict_hash"),
    )
    moved = old.join(new, "case_id").filter("old_severity <> new_severity or old_disposition <> new_disposition")
    # one row, or none for a corpus without entries, which matches nothing
    stamp = corpus_hash(corpus.filter(F.col("corpus_version") == corpus_version)).select(
        F.col("corpus_version").alias("indicator_corpus_version"), F.col("corpus_hash").alias("indicator_corpus_hash")
    )
    return moved.join(deltas, "case_id").crossJoin(stamp)


def responsible_claims(drifts: DataFrame, claims: DataFrame, corpus: DataFrame, corpus_version: str, weights: DataFrame, policy_version: str) -> DataFrame:
    """One row per matching claim of a drifted case, with the weight before and after."""
    current = weights.filter(F.col("policy_version") == policy_version).select("predicate", F.col("weight").alias("old_weight"))
    hit = match_indicators(claims, corpus, corpus_version).join(drifts.select("case_id"), "case_id", "left_semi").join(small(current), "predicate")
    return hit.select("case_id", "claim_id", "predicate", "indicator_value", "old_weight", F.col("weight").alias("new_weight"))


def attribution_diff(before: DataFrame, after: DataFrame, stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Per claim the weight before and after; cases whose recomputed old hash differs from the stored one are left out.

    ``before`` and ``after`` are ``adjudicate.contributing_claims`` rows.
    """
    sound = stored.select("case_id", "verdict_hash").join(recomputed.select("case_id", "verdict_hash"), ["case_id", "verdict_hash"])
    key = ["case_id", "claim_id", "predicate"]
    short = ["case_id", packed(F.col("claim_id")).alias("claim_id"), "predicate"]  # half the digits' bytes in the join
    a = before.select(*short, F.col("attributed_weight").alias("weight_before"))
    b = after.select(*short, F.col("attributed_weight").alias("weight_after"))
    both = a.join(b, key, "full_outer").join(sound.select("case_id"), "case_id", "left_semi")
    return both.withColumn("claim_id", unpacked(F.col("claim_id")))


def reopened(closed: DataFrame, drifts: DataFrame, order: str = "swept_at") -> DataFrame:
    """Closed cases with the latest drift on top; the closed rows stay as they are."""
    payload = F.struct(*[c for c in drifts.columns if c != "case_id"])
    latest = drifts.groupBy("case_id").agg(F.max_by(payload, order).alias("drift"))
    return closed.join(latest, "case_id", "left").withColumn("is_reopened", F.col("drift").isNotNull())


def closed_cases(closed: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Closed cases of a window (start included, end not); without bounds all of them."""
    out = closed
    if start_ns is not None:
        out = out.filter(F.col("completed_at_ns") >= start_ns)
    if end_ns is not None:
        out = out.filter(F.col("completed_at_ns") < end_ns)
    return out


def measured_sweep(closed: DataFrame, *args, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(drifts, summary): a :func:`drift_sweep`, run to its end and timed."""
    begun = time.monotonic()
    drifts = settle(drift_sweep(closed, *args, **kwargs))
    return drifts, sweep_summary(closed, drifts, time.monotonic() - begun)


def sweep_summary(closed: DataFrame, drifts: DataFrame, elapsed_seconds: float) -> DataFrame:
    """Cases considered, drifted, elapsed time and throughput."""
    swept = closed.agg(F.count(F.lit(1)).alias("cases_swept"))
    moved = drifts.agg(F.count(F.lit(1)).alias("drifted"))
    rate = F.try_divide(F.col("cases_swept").cast("double"), F.col("elapsed_seconds"))
    return (
        swept.crossJoin(moved)  # 1 row x 1 row
        .withColumn("elapsed_seconds", F.lit(float(elapsed_seconds)))
        .withColumn("cases_per_second", rate)
    )
