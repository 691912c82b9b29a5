"""Content identities: evidence, claims, claim sets, indicator corpora, verdicts, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_json, content_json, evidence_id, sha_hex
from ..plans.digest import set_digest
from .chains import element_hash

CLAIM_FIELDS = [
    "predicate",
    "subject",
    "object",
    "interval_start_ns",
    "interval_end_ns",
    "evidence",
    "extractor_kind",
    "extractor_id",
    "extractor_version",
    "observed_value",
    "polarity",
    "hypothesis_ref",
]


def with_evidence_id(df: DataFrame, text: str = "text", out: str = "evidence_id") -> DataFrame:
    """Adds the hash of the event's canonical form, which key order and white space do not change."""
    return df.withColumn(out, evidence_id(canonical_json(F.col(text))))


def dedup_evidence(df: DataFrame, key: str = "evidence_id") -> DataFrame:
    """One row per id.  Copies are folded before the shuffle, so many copies of one event stay cheap."""
    return df.dropDuplicates([key])


def dedup_evidence_stream(df: DataFrame, event_time: str, delay: str, key: str = "evidence_id") -> DataFrame:
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def distinct_evidence(df: DataFrame, key: str = "evidence_id") -> DataFrame:
    return df.agg(F.count_distinct(key).alias("distinct_ids"))


def _claim_json() -> Column:
    cols = [F.array_sort(F.coalesce("evidence", F.array().cast("array<string>"))).alias("evidence") if c == "evidence" else F.col(c) for c in CLAIM_FIELDS]
    return content_json(*cols)


def with_claim_id(claims: DataFrame, out: str = "claim_id") -> DataFrame:
    """Hash of all twelve fields; JSON keeps the field boundaries, the evidence list is sorted first; none is the same as an empty one."""
    return claims.withColumn(out, sha_hex(_claim_json()))


def claim_set_hash(claims: DataFrame, group: str = "case_id", full: Sequence[int] | None = None) -> DataFrame:
    """Order-independent hash of each case's claims; copies count.  ``full``: the crowded buckets, as in ``set_digest``."""
    if "claim_id" not in claims.columns:
        claims = with_claim_id(claims)
    return set_digest(claims, [group], F.col("claim_id"), out="claim_set_hash", count="claim_count", hashed=True, colocate=[group], full=full)


def corpus_hash(indicators: DataFrame) -> DataFrame:
    """Hash of version and entries of each corpus version, whatever their order."""
    item = content_json("predicate", "value", "weight", F.array_sort("techniques").alias("techniques"))
    folded = set_digest(indicators, ["corpus_version"], item, out="_d", count="entries")
    return folded.select(
        "corpus_version", "entries", sha_hex(F.concat_ws("|", "corpus_version", "_d")).alias("corpus_hash")
    )


VERDICT_FIELDS = [
    "severity",
    "confidence",
    "disposition",
    "attack_techniques",
    "contributing_count",
    "contributing_digest",
    "policy_version",
    "kernel_version",
]


def with_verdict_hash(verdicts: DataFrame, out: str = "verdict_hash") -> DataFrame:
    """Hash of the whole verdict except itself; the contributing claims enter through their digest."""
    return verdicts.withColumn(out, sha_hex(content_json(*VERDICT_FIELDS)))


MANIFEST_FIELDS = [
    "investigation_id",
    "tenant_id",
    "case_id",
    "epoch_root",
    "epoch_id",
    "claim_set_hash",
    "claim_count",
    "inference",
    "policy_version",
    "kernel_version",
    "verdict_severity",
    "verdict_confidence",
    "verdict_disposition",
    "verdict_hash",
    "budget_consumed",
    "started_at_ns",
    "completed_at_ns",
]


def with_content_hash(manifests: DataFrame, out: str = "content_hash") -> DataFrame:
    """Hash of every manifest field except the chain link; the link is added by ``chain_manifests``."""
    return manifests.withColumn(out, sha_hex(content_json(*MANIFEST_FIELDS)))


def with_manifest_hash(manifests: DataFrame, out: str = "manifest_hash") -> DataFrame:
    """Hash of every manifest field including the anchor and the previous manifest's hash."""
    named = with_content_hash(manifests, "_content")
    linked = element_hash(F.col("anchor_hash"), F.col("opens_segment"), F.col("prev_manifest_hash"), F.col("_content"))
    return named.withColumn(out, linked).drop("_content")
