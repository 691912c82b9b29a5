"""Admission of proposed claims, and investigation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fence
from ..session import small, stored
from .identity import with_claim_id

FEW_UNKNOWN = 256  # unknown ids up to which each claim's list is looked through for them

# The rejection texts.
EMPTY = "empty evidence list (invariant I2)"
UNKNOWN = "evidence id(s) not present in the pinned epoch"
PREDICATE = "predicate is not in the predicate registry"
INVERTED = "interval end precedes interval start"
OUTSIDE = "interval falls outside the case window"


def judge(claims: DataFrame, pinned: DataFrame, registry: DataFrame, windows: DataFrame) -> DataFrame:
    """Claims with ``reason`` (NULL when admitted) and ``unknown_evidence``; the first failing check wins.

    ``pinned`` is (evidence_id) or (case_id, evidence_id); ``registry`` is (predicate); ``windows`` is
    (case_id, window_start_ns, window_end_ns).  The cited ids are made distinct before they meet the
    pinned set; only ids found unknown meet the claims again: as one list where they are few and every case has the same
    pinned set (claims with one id cite the same evidence), else by a join.  Checks that need no window come before the
    join with it, and what they found travels as a number.
    """
    named = claims if "claim_id" in claims.columns else with_claim_id(claims)
    scope = [c for c in ("case_id",) if c in pinned.columns]
    cited = named.select("case_id", "claim_id", F.explode("evidence").alias("evidence_id"))
    unknown = cited.select(*scope, "evidence_id").distinct().join(pinned, [*scope, "evidence_id"], "left_anti")
    few = None
    if not scope:
        unknown = stored(unknown.filter("evidence_id is not null"), "unknown-evidence")
        few = [r[0] for r in unknown.limit(FEW_UNKNOWN + 1).collect()]
    if few is not None and len(few) <= FEW_UNKNOWN:
        these = F.array(*[F.lit(x) for x in sorted(few)]).cast("array<string>")
        found = F.array_sort(F.array_intersect("evidence", these))
        named = named.withColumn("unknown_evidence", F.when(F.col("case_id").isNotNull() & (F.size(found) > 0), found))
    else:
        named = named.join(_missing(cited, unknown, scope), ["case_id", "claim_id"], "left")
    known = small(registry.select("predicate").distinct().withColumn("_known", F.lit(True)))
    early = F.coalesce(
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, 0),
        F.when(F.col("unknown_evidence").isNotNull(), 1),
        F.when(F.col("_known").isNull(), 2),
        F.when(F.col("interval_end_ns") < F.col("interval_start_ns"), 3),
    )
    out = (
        named.join(known, "predicate", "left")
        .withColumn("_early", early.cast("tinyint"))
        .drop("_known")
        .join(windows.select("case_id", "window_start_ns", "window_end_ns"), "case_id", "left")
    )
    outside = (F.col("interval_start_ns") < F.col("window_start_ns")) | (F.col("interval_end_ns") > F.col("window_end_ns"))
    texts = F.array(*[F.lit(x) for x in (EMPTY, UNKNOWN, PREDICATE, INVERTED)])
    reason = F.when(F.col("_early").isNotNull(), F.get(texts, F.col("_early").cast("int"))).when(F.coalesce(outside, F.lit(True)), F.lit(OUTSIDE))
    return out.withColumn("reason", reason).drop("_early", "window_start_ns", "window_end_ns")


def _missing(cited: DataFrame, unknown: DataFrame, scope: list[str]) -> DataFrame:
    """(case_id, claim_id, unknown_evidence) of the claims that cite an unknown id."""
    return (
        cited.join(small(unknown), [*scope, "evidence_id"])
        .groupBy("case_id", "claim_id")
        .agg(F.array_sort(F.collect_set("evidence_id")).alias("unknown_evidence"))  # part of one claim's own list
    )


def admit(claims: DataFrame, pinned: DataFrame, registry: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted claims, rejected claims with reason and unknown ids)."""
    judged = judge(claims, pinned, registry, windows)
    return judged.filter("reason is null").drop("reason", "unknown_evidence"), judged.filter("reason is not null")


# The structured answer of an investigation turn.
CLAIM_TYPE = (
    "struct<predicate:string,subject:string,object:string,interval_start_ns:bigint,interval_end_ns:bigint,"
    "evidence:array<string>,extractor:struct<kind:string,id:string,version:string>,observed_value:bigint,"
    "polarity:string,hypothesis_ref:string>"
)
CALL_TYPE = "struct<name:string,arguments:map<string,variant>>"
EXTRACTOR_KINDS = ["rule", "stat", "model", "llm"]


def _sound(c: Column) -> Column:
    required = F.lit(True)
    for name in ("predicate", "subject", "interval_start_ns", "interval_end_ns"):
        required = required & c[name].isNotNull()
    ext = c["extractor"]
    required = required & ext["id"].isNotNull() & ext["version"].isNotNull()
    required = required & F.coalesce(ext["kind"].isin(EXTRACTOR_KINDS), F.lit(False))
    return F.coalesce(required & (c["polarity"].isNull() | c["polarity"].isin("supports", "refutes")), F.lit(False))


def parse_turns(turns: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``proposed_claims``, ``tool_calls`` and ``narrative``.

    A text that is not a valid structured answer proposes nothing: it becomes narrative only.
    """
    v = F.col("_v")
    claims = F.try_variant_get(v, "$.proposed_claims", f"array<{CLAIM_TYPE}>")
    calls = F.try_variant_get(v, "$.tool_calls", f"array<{CALL_TYPE}>")
    has_claims = F.try_variant_get(v, "$.proposed_claims", "variant").isNotNull()
    has_calls = F.try_variant_get(v, "$.tool_calls", "variant").isNotNull()
    good_claims = ~has_claims | F.coalesce(F.forall(F.col("_claims"), _sound), F.lit(False))
    good_calls = ~has_calls | F.coalesce(F.forall(F.col("_calls"), lambda c: c["name"].isNotNull()), F.lit(False))
    staged = (
        turns.withColumn("_v", F.try_parse_json(text))
        .withColumn("_claims", claims)
        .withColumn("_calls", calls)
        .withColumn("valid", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & good_claims & good_calls)
    )
    narrative = F.when(F.col("valid"), F.coalesce(F.try_variant_get(v, "$.narrative", "string"), F.lit(""))).otherwise(F.col(text))
    none = F.array().cast(f"array<{CLAIM_TYPE}>")
    return (
        staged.withColumn("proposed_claims", F.when(F.col("valid"), F.coalesce("_claims", none)).otherwise(none))
        .withColumn("tool_calls", F.when(F.col("valid"), F.coalesce(F.size("_calls"), F.lit(0))).otherwise(0).cast("bigint"))
        .withColumn("tool_calls", F.greatest(F.col("tool_calls"), F.lit(0)))
        .withColumn("narrative", narrative)
        .drop("_v", "_claims", "_calls")
    )


def flatten_claims(claims: DataFrame, column: str = "claim") -> DataFrame:
    """Nested proposed claims to the flat columns scoring reads; polarity defaults to supports."""
    c = F.col(column)
    keep = [x for x in claims.columns if x != column]
    return claims.select(
        *keep,
        c["predicate"].alias("predicate"),
        c["subject"].alias("subject"),
        c["object"].alias("object"),
        c["interval_start_ns"].alias("interval_start_ns"),
        c["interval_end_ns"].alias("interval_end_ns"),
        F.coalesce(c["evidence"], F.array().cast("array<string>")).alias("evidence"),
        c["extractor"]["kind"].alias("extractor_kind"),
        c["extractor"]["id"].alias("extractor_id"),
        c["extractor"]["version"].alias("extractor_version"),
        c["observed_value"].alias("observed_value"),
        F.coalesce(c["polarity"], F.lit("supports")).alias("polarity"),
        c["hypothesis_ref"].alias("hypothesis_ref"),
    )


def fence_evidence(df: DataFrame, column: str, out: str = "fenced") -> DataFrame:
    return df.withColumn(out, fence(F.col(column)))


def budgeted_turns(log: DataFrame, max_calls: int = 24, max_turns: int = 10, inv: str = "investigation_id") -> DataFrame:
    """The turns that count, with the running number of calls.

    ``log`` is (investigation, turn from 0, tool_calls, ...), one row per turn.  A turn without calls
    ends the run; the turn that exceeds the call budget still counts.  Turns past ``max_turns`` are cut
    first, so a window never holds more than ``max_turns`` rows.
    """
    order = Window.partitionBy(inv).orderBy("turn")
    run = log.filter(F.col("turn") < max_turns).withColumn("calls_so_far", F.sum("tool_calls").over(order))
    ends = (F.col("tool_calls") == 0) | (F.col("calls_so_far") > max_calls)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(ends.cast("int")).over(earlier), F.lit(0))
    return run.withColumn("_stopped", stopped).filter("_stopped = 0").drop("_stopped")


def rollup_investigations(log: DataFrame, max_calls: int = 24, max_turns: int = 10, inv: str = "investigation_id") -> DataFrame:
    """Per investigation: turns and calls used, claims proposed, budget flag, competing hypotheses.

    ``log`` also has ``claims`` (a count) and ``hypotheses`` (an array of refs) per turn.
    """
    used = budgeted_turns(log, max_calls, max_turns, inv)
    over = F.max((F.col("calls_so_far") > max_calls).cast("int")) == 1
    quiet = F.max((F.col("tool_calls") == 0).cast("int")) == 1
    totals = used.groupBy(inv).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("claims").alias("claims"),
        (over | (~quiet & (F.count(F.lit(1)) >= max_turns))).alias("budget_exhausted"),
    )
    refs = used.select(inv, F.explode("hypotheses").alias("h")).filter("h is not null and h <> ''")
    seen = refs.distinct().groupBy(inv).agg(F.count(F.lit(1)).alias("hypothesis_count"))
    out = totals.join(seen, inv, "left").withColumn("hypothesis_count", F.coalesce("hypothesis_count", F.lit(0)))
    return out.withColumn("multi_hypothesis", F.col("hypothesis_count") >= 2)
