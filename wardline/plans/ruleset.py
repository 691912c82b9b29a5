"""Many rules in one pass: rules that group by the same keys share one scan and one conditional aggregation.

All sources of a key group are aggregated side by side, each distinct condition once, on the keys and on the fields whose
different values some source counts.  That table has a row per combination and no event; it is stored once, and what is a
rule's own (coarser sources as rollups, novelty, suppression, emits) is judged on its columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import rules as R
from .rules import Rule, Source


@dataclass(frozen=True)
class KeyGroup:
    """Rules whose sources have one set of keys."""

    keys: tuple[str, ...]
    rules: tuple[Rule, ...]

    def counted(self) -> list[str]:
        """The fields besides the keys whose different values some source counts."""
        return sorted({f for rule in self.rules for f in R._distinct_fields(rule)})

    def conditions(self) -> list[tuple[str, tuple[str, ...]]]:
        """What the sources of all rules match and track, each once: sources alike in both are one aggregate."""
        return list(dict.fromkeys((s.where, s.track_last) for rule in self.rules for _, s in sorted(rule.sources.items())))


def key_groups(rules: Iterable[Rule]) -> list[KeyGroup]:
    """Rules by the set of their keys, in the order in which the sets first occur."""
    by_keys: dict[frozenset[str], list[Rule]] = {}
    for rule in rules:
        by_keys.setdefault(frozenset(rule.union_keys()), []).append(rule)
    return [KeyGroup(tuple(sorted(keys)), tuple(members)) for keys, members in by_keys.items()]


def shared_aggregate(group: KeyGroup, events: DataFrame) -> DataFrame:
    """One row per combination of keys and counted fields in ``events``, with an aggregate for each condition.

    Combinations without a match are rows too: they are cases.  Null keys stay, for coarser sources.
    """
    parts = [c for nth, (where, last) in enumerate(group.conditions()) for c in R._partials(f"c{nth}", Source(where, (), last))]
    return events.groupBy(*group.keys, *group.counted()).agg(*parts)


def correlated(group: KeyGroup, shared: DataFrame, rule: Rule) -> DataFrame:
    """The rule's cases with a struct per source, as ``rules.correlate`` has them, from the shared aggregate alone."""
    conditions, own = group.conditions(), []
    for name, source in rule.sources.items():
        of = f"_c{conditions.index((source.where, source.track_last))}__"
        own += [F.col(c).alias(f"_{name}__{c.removeprefix(of)}") for c in shared.columns if c.startswith(of)]
    mine = R._distinct_fields(rule)
    rows = shared.select(*group.keys, *mine, *own)
    if set(mine) != set(group.counted()):  # fields that other rules count fold away
        rows = rows.groupBy(*group.keys, *mine).agg(*[c for n, s in sorted(rule.sources.items()) for c in R._rollup(n, s)])
    return R.finish(rule, rows)


def correlate_all(rules: Iterable[Rule], events: DataFrame) -> Iterator[tuple[Rule, DataFrame, DataFrame]]:
    """(rule, its correlated cases, the stored aggregate of its key group) for every rule."""
    for group in key_groups(rules):
        shared = stored(shared_aggregate(group, events), "key-group")
        for rule in group.rules:
            yield rule, correlated(group, shared, rule), shared


def union_all(tables: Iterable[DataFrame]) -> DataFrame:
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first
