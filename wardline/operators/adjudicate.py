"""Scoring of cases against a versioned policy, for all cases at once.

Claims are first folded to *claim groups*: one row per (case, predicate, polarity) with a count and a
digest of the claim ids.  Groups do not depend on a policy, so re-scoring under another policy reads
this small table and never the claims.  A case has at most two groups per predicate, whatever the
number of its claims; everything after the fold is bounded by the policy's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import ZERO_HASH, sha_hex
from ..functions.scalar import clamp_int64
from ..functions.vocab import SEVERITIES, TACTICS
from ..plans.digest import counted_items, crowded, folded_items, set_digest, split, unpacked
from ..session import local_table, small
from . import merkle
from .identity import with_claim_id, with_verdict_hash

BIG = "decimal(38,0)"
GROUP = ["case_id", "predicate", "polarity"]


@dataclass
class Policy:
    """``weights`` (policy_version, predicate, tactic, weight, techniques), ``chains`` (policy_version,
    from_tactic, to_tactic, bonus), ``thresholds`` (policy_version, position, threshold, severity)."""

    weights: DataFrame
    chains: DataFrame
    thresholds: DataFrame

    def version(self, name: str) -> Policy:
        keep = F.col("policy_version") == name
        return Policy(self.weights.filter(keep), self.chains.filter(keep), self.thresholds.filter(keep))


def policy_from_rows(spark: SparkSession, weights: Sequence, chains: Sequence, thresholds: Sequence) -> Policy:
    return Policy(
        local_table(spark, list(weights), "policy_version string, predicate string, tactic string, weight bigint, techniques array<string>"),
        local_table(spark, list(chains), "policy_version string, from_tactic string, to_tactic string, bonus bigint"),
        local_table(spark, list(thresholds), "policy_version string, position int, threshold bigint, severity string"),
    )


def tactic_ordinal(col: Column) -> Column:
    """Zero-based kill-chain position; NULL for an unknown tactic."""
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in TACTICS]), col), F.lit(0)).cast("int") - 1


def claim_groups(claims: DataFrame, full: Sequence[int] | None = None) -> DataFrame:
    """(case_id, predicate, polarity, claims, digest) of the claims that carry evidence.

    Copies of a claim count: each contributes to the score.  ``full`` are the crowded buckets of cases (``digest.crowded``) if they
    are known from a table with at least these claims; else they are counted here.
    """
    usable = claims.filter(F.size("evidence") > 0)
    if "claim_id" not in usable.columns:
        usable = with_claim_id(usable)
    return set_digest(usable, GROUP, F.col("claim_id"), out="digest", count="claims", hashed=True, colocate=["case_id"], full=full)


def claim_groups_and_sets(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claim_groups`` and ``identity.claim_set_hash`` of the same claims, which are dealt by case once for both."""
    named = claims if "claim_id" in claims.columns else with_claim_id(claims)
    named = named.withColumn("_usable", F.size("evidence") > 0)
    groups = sets = None
    for part, spread in zip(split(named, ["case_id"], crowded(claims, ["case_id"])[0]), (False, True), strict=True):
        if part is None:
            continue
        counted = counted_items(part, [*GROUP, "_usable"], F.col("claim_id"), hashed=True, colocate=None if spread else ["case_id"])
        # a mask and no filter, which would be pushed below the shuffle and make it another one
        mine = counted.withColumn("_h", F.when(F.col("_usable"), F.col("_h")))
        every = counted.groupBy("case_id", "_h").agg(F.sum("_n").alias("_n"))
        mine = folded_items(mine, GROUP, "digest", "claims", spread)
        every = folded_items(every, ["case_id"], "claim_set_hash", "claim_count", spread)
        groups, sets = (mine, every) if groups is None else (groups.unionByName(mine), sets.unionByName(every))
    return groups, sets


def claim_counts(claims: DataFrame) -> DataFrame:
    """Claim groups without digests, for scores alone: no hashing, and one shuffle by case that scoring goes on from."""
    usable = claims.filter(F.size("evidence") > 0).select(*GROUP)
    few, many = split(usable, ["case_id"], crowded(claims, ["case_id"])[0])
    rows = few.repartition("case_id").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("claims"))
    if many is not None:
        rows = rows.unionByName(many.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("claims")))
    return rows.withColumn("digest", F.lit(ZERO_HASH))


def price(groups: DataFrame, weights: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """Groups with tactic, signed weight and total contribution; unpriced predicates drop out.

    ``groups`` carries ``policy_version``.  ``overlay`` (case_id, predicate, new_weight, new_techniques)
    replaces the weight of one predicate in one case and, when given, its techniques.
    """
    priced = groups.join(small(weights), ["policy_version", "predicate"])
    if overlay is not None:
        priced = (
            priced.join(overlay, ["case_id", "predicate"], "left")
            .withColumn("weight", F.coalesce("new_weight", "weight"))
            .withColumn("techniques", F.when(F.size("new_techniques") > 0, F.col("new_techniques")).otherwise(F.col("techniques")))
            .drop("new_weight", "new_techniques")
        )
    sign = F.when(F.col("polarity") == "refutes", -1).otherwise(1)
    attributed = clamp_int64(F.col("weight").cast(BIG) * sign)
    return priced.withColumn("attributed_weight", attributed).withColumn(
        "contribution", (F.col("attributed_weight").cast("decimal(20,0)") * F.col("claims").cast("decimal(18,0)")).cast(BIG)
    )


def tactic_scores(priced: DataFrame) -> DataFrame:
    """Score per (case, tactic), held inside int64.  A tactic whose weights are 0 is still present."""
    return priced.groupBy("case_id", "policy_version", "tactic").agg(clamp_int64(F.sum("contribution")).alias("score"))


def chain_bonus(scores: DataFrame, chains: DataFrame) -> DataFrame:
    """Bonus per case: consecutive present tactics that are one step apart and listed in the policy.

    The window spans the tactics of one case, at most twelve rows.
    """
    order = Window.partitionBy("case_id", "policy_version").orderBy("ord")
    pairs = (
        scores.withColumn("ord", tactic_ordinal(F.col("tactic")))
        .withColumn("to_tactic", F.lead("tactic").over(order))
        .withColumn("step", F.lead("ord").over(order) - F.col("ord"))
        .filter("step = 1")
        .withColumnRenamed("tactic", "from_tactic")
    )
    hit = pairs.join(small(chains), ["policy_version", "from_tactic", "to_tactic"])
    return hit.groupBy("case_id", "policy_version").agg(clamp_int64(F.sum(F.col("bonus").cast(BIG))).alias("bonus"))


def classify(scores: DataFrame, thresholds: DataFrame, score: str = "total_score") -> DataFrame:
    """Adds ``severity``: the highest tier whose threshold the score reaches, else the lowest tier."""
    tiers = thresholds.groupBy("policy_version").agg(
        F.array_sort(F.collect_list(F.struct("threshold", "severity"))).alias("_tiers")
    )
    reached = F.filter("_tiers", lambda t: t["threshold"] <= F.col(score))
    pick = F.coalesce(F.try_element_at(reached, F.lit(-1))["severity"], F.col("_tiers")[0]["severity"])
    return scores.join(small(tiers), "policy_version").withColumn("severity", pick).drop("_tiers")


def disposition(severity: Column) -> Column:
    return (
        F.when(severity.isin("info", "low"), "benign")
        .when(severity == "medium", "suspicious")
        .when(severity.isin("high", "critical"), "malicious")
    )


def confidence(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10_000), score)).cast("bigint")


def score_groups(cases: DataFrame, groups: DataFrame, policy: Policy, kernel_version: str | None = None, overlay: DataFrame | None = None) -> DataFrame:
    """Verdict per case from claim groups.  ``cases`` is (case_id, policy_version), one row per case.

    Without ``kernel_version`` each case is scored under the one in its own column of that name.

    Groups and cases meet by case; tactics, chain bonus, techniques and the digest of the contributing
    claims are folded where they met, without another shuffle.
    """
    kernel = F.col("kernel_version") if kernel_version is None else F.lit(kernel_version)
    cases = cases.select("case_id", "policy_version", kernel.alias("kernel_version"))
    keyed = groups.join(cases.drop("kernel_version"), "case_id")
    priced = price(keyed, policy.weights, overlay).withColumn("ord", tactic_ordinal(F.col("tactic")))
    key = ["case_id", "policy_version"]
    item = F.concat_ws("|", "predicate", "polarity", "attributed_weight", "claims", "digest")
    by_tactic = (
        priced.groupBy(*key, "ord")
        .agg(
            clamp_int64(F.sum("contribution")).alias("score"),
            F.sum("claims").alias("claims"),
            F.flatten(F.collect_list("techniques")).alias("techniques"),
            F.collect_list(item).alias("items"),
        )
    )
    by_case = by_tactic.groupBy(*key).agg(
        clamp_int64(F.sum(F.col("score").cast(BIG))).alias("base_score"),
        F.array_sort(F.collect_list("ord")).alias("present"),
        F.sum("claims").alias("contributing_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("techniques")))).alias("attack_techniques"),
        sha_hex(F.concat_ws(",", F.array_sort(F.flatten(F.collect_list("items"))))).alias("contributing_digest"),
    )
    steps = policy.chains.withColumn("_from", tactic_ordinal(F.col("from_tactic"))).withColumn("_to", tactic_ordinal(F.col("to_tactic")))
    bonuses = (
        steps.filter("_to = _from + 1")
        .groupBy("policy_version")
        .agg(F.map_from_entries(F.collect_list(F.struct("_from", "bonus"))).alias("_bonus"))
    )
    bonus = F.aggregate(
        F.filter("present", lambda t: F.array_contains("present", t + 1)),
        F.lit(0).cast(BIG),
        lambda acc, t: (acc + F.coalesce(F.try_element_at("_bonus", t), F.lit(0)).cast(BIG)).cast(BIG),
    )
    total = clamp_int64(F.col("base_score").cast(BIG) + F.col("bonus").cast(BIG))
    scored = by_case.join(small(bonuses), "policy_version", "left").withColumn("bonus", clamp_int64(bonus)).drop("_bonus")
    graded = classify(scored.withColumn("total_score", total), policy.thresholds)

    out = cases.join(graded.drop("policy_version"), "case_id", "left")
    none = F.col("severity").isNull()
    out = (
        out.withColumn("disposition", F.when(none, "incomplete").otherwise(disposition(F.col("severity"))))
        .withColumn("confidence", F.when(none, F.lit(0)).otherwise(confidence(F.col("total_score"))).cast("bigint"))
        .withColumn("severity", F.coalesce("severity", F.lit(SEVERITIES[0])))
        .withColumn("attack_techniques", F.coalesce("attack_techniques", F.array().cast("array<string>")))
        .withColumn("contributing_count", F.coalesce("contributing_count", F.lit(0)))
        .withColumn("contributing_digest", F.coalesce("contributing_digest", F.lit(ZERO_HASH)))
    )
    return with_verdict_hash(out)


def adjudicate(cases: DataFrame, claims: DataFrame, policy: Policy, kernel_version: str | None = None) -> DataFrame:
    """Verdict of every case.  A case without a usable claim is incomplete, never benign."""
    return score_groups(cases, claim_groups(claims), policy, kernel_version)


def contributing_claims(cases: DataFrame, claims: DataFrame, policy: Policy, full: Sequence[int] | None = None) -> DataFrame:
    """Attribution rows (case_id, claim_id, predicate, attributed_weight, copies).

    Kept as rows: a case may have any number of claims.  Sort by (case_id, claim_id) to read them in order.
    """
    usable = claims.filter(F.size("evidence") > 0)
    if "claim_id" not in usable.columns:
        usable = with_claim_id(usable)
    full = crowded(claims, ["case_id"])[0] if full is None else full
    out = None
    for part, spread in zip(split(usable, ["case_id"], full), (False, True), strict=True):
        if part is None:
            continue
        rows = counted_items(part, GROUP, F.col("claim_id"), hashed=True, colocate=None if spread else ["case_id"])
        rows = rows.withColumnRenamed("_n", "claims").join(cases.select("case_id", "policy_version"), "case_id")
        out = rows if out is None else out.unionByName(rows)
    priced = price(out, policy.weights)
    return priced.select("case_id", unpacked(F.col("_h")).alias("claim_id"), "predicate", "attributed_weight", F.col("claims").alias("copies"))


def check_policy(policy: Policy) -> DataFrame:
    """Problem rows (policy_version, problem, detail); a valid policy gives none."""
    order = Window.partitionBy("policy_version").orderBy("position")  # a policy has a handful of tiers
    versions = policy.weights.select("policy_version").distinct()
    empty = versions.join(policy.thresholds, "policy_version", "left_anti").select(
        "policy_version", F.lit("no_thresholds").alias("problem"), F.lit("").alias("detail")
    )
    steps = policy.thresholds.withColumn("_prev", F.lag("threshold").over(order)).filter("threshold <= _prev")
    steps = steps.select("policy_version", F.lit("not_ascending").alias("problem"), F.col("threshold").cast("string").alias("detail"))
    tier = policy.thresholds.filter(~F.col("severity").isin(SEVERITIES))
    tier = tier.select("policy_version", F.lit("unknown_severity").alias("problem"), F.col("severity").alias("detail"))
    tactic = policy.weights.select("policy_version", "tactic").unionByName(
        policy.chains.select("policy_version", F.explode(F.array("from_tactic", "to_tactic")).alias("tactic"))
    )
    tactic = tactic.filter(~F.col("tactic").isin(TACTICS)).distinct()
    tactic = tactic.select("policy_version", F.lit("unknown_tactic").alias("problem"), F.col("tactic").alias("detail"))
    return empty.unionByName(steps).unionByName(tier).unionByName(tactic)


def action_targets(actions: DataFrame) -> DataFrame:
    """(action_id, kind, target) rows from the arrays ``principals``, ``hosts``, ``services``."""
    kinds = {"principal": "principals", "host": "hosts", "service": "services"}

    def tagged(kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))

    parts = [tagged(k, c) for k, c in kinds.items()]
    return actions.select("action_id", F.inline(F.concat(*parts)))


def blast_radius(actions: DataFrame, targets: DataFrame, critical_assets: DataFrame) -> DataFrame:
    """Scope and risk tier per action.

    ``targets`` is (action_id, kind, target) with kinds principal, host and service.  Only principals and
    hosts can touch a critical asset (``critical_assets.asset``), and touching one makes the tier critical
    at any scope.  Counts fold before the shuffle, so an action may have any number of targets.
    """
    counts = targets.groupBy("action_id").agg(
        *[F.count_if(F.col("kind") == k).alias(c) for k, c in (("principal", "principal_count"), ("host", "host_count"), ("service", "dependent_service_count"))]
    )
    reach = targets.filter(F.col("kind").isin("principal", "host")).select("action_id", F.col("target").alias("asset"))
    touched = reach.join(small(critical_assets.select("asset").distinct()), "asset", "left_semi")
    touched = touched.select("action_id").distinct().withColumn("_hit", F.lit(True))
    out = actions.join(counts, "action_id", "left").join(touched, "action_id", "left")
    for c in ("principal_count", "host_count", "dependent_service_count"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    out = out.withColumn("touches_critical_asset", F.coalesce("_hit", F.lit(False)))
    scope = F.col("principal_count") + F.col("host_count") + F.col("dependent_service_count")
    tier = F.when(F.col("touches_critical_asset"), "critical").when(scope > 50, "high").when(scope > 5, "medium").otherwise("low")
    return out.withColumn("risk_tier", tier).drop("_hit")


def evidence_roots(claims: DataFrame) -> DataFrame:
    """Merkle root over each case's distinct cited evidence, with the number of ids."""
    return cited_evidence_tree(claims).batches.withColumnRenamed("root", "epoch_root").withColumnRenamed("leaf_count", "evidence_count")


def cited_evidence_tree(claims: DataFrame, group: Sequence[str] = ("case_id",), sizes_from: DataFrame | None = None) -> merkle.Tree:
    """Tree over each case's cited evidence.  ``group`` may have columns before the case that the case decides; ``sizes_from`` is a
    table with at least these claims that is cheaper to read."""

    def cited(table: DataFrame) -> DataFrame:
        return table.select(*group, F.explode("evidence").alias("evidence_id"))

    return merkle.seal_batches(cited(claims), group, sizes_from=None if sizes_from is None else cited(sizes_from))


def close_cases(cases: DataFrame, claims: DataFrame, policy: Policy, kernel_version: str, epoch_id: int = 1) -> DataFrame:
    """Unsealed manifests: verdict, claim-set hash and evidence root of every case.

    ``cases`` also has tenant_id, investigation_id, closed_seq, started_at_ns, completed_at_ns,
    ``inference`` and ``budget_consumed`` structs.  ``ledger.chain_manifests`` seals the result.
    """
    named = claims if "claim_id" in claims.columns else with_claim_id(claims)
    groups, sets = claim_groups_and_sets(named)
    verdicts = score_groups(cases.select("case_id", "policy_version"), groups, policy, kernel_version)
    out = cases.drop("policy_version").join(verdicts, "case_id").join(sets, "case_id", "left").join(evidence_roots(named), "case_id", "left")
    return out.select(
        "investigation_id",
        "tenant_id",
        "case_id",
        F.coalesce("epoch_root", F.lit("")).alias("epoch_root"),
        F.lit(epoch_id).cast("bigint").alias("epoch_id"),
        F.coalesce("claim_set_hash", F.lit(ZERO_HASH)).alias("claim_set_hash"),
        F.coalesce("claim_count", F.lit(0)).alias("claim_count"),
        "inference",
        "policy_version",
        "kernel_version",
        F.col("severity").alias("verdict_severity"),
        F.col("confidence").alias("verdict_confidence"),
        F.col("disposition").alias("verdict_disposition"),
        "verdict_hash",
        "budget_consumed",
        "started_at_ns",
        "completed_at_ns",
        "closed_seq",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
    )


