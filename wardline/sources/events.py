"""JSON-lines events: reading, normalising by a mapping, rejecting, flattening, replaying."""

from __future__ import annotations

import re
from collections.abc import Mapping as MappingType
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import canonical_json, evidence_id


@dataclass(frozen=True)
class FieldMap:
    source: str
    type: str = ""  # "", "int" or "timestamp_ns"


@dataclass(frozen=True)
class Mapping:
    """Source fields to target fields, both dotted.  The versions are part of every event's identity.

    ``unmapped_passthrough`` keeps what the fields do not consume: whole top-level fields, or with ``unmapped_paths`` also
    the rest of an object of which only some paths are mapped.
    """

    source_id: str
    mapping_version: str
    schema_version: str
    fields: MappingType[str, FieldMap]
    unmapped_passthrough: bool = True
    unmapped_paths: bool = False


# The shipped mappings.
CLOUD_AUDIT = Mapping(
    source_id="aws-cloudtrail",
    mapping_version="1",
    schema_version="1.0.0",
    fields={
        "event_name": FieldMap("eventName"),
        "event_source": FieldMap("eventSource"),
        "actor.user.uid": FieldMap("userIdentity.arn"),
        "actor.user.name": FieldMap("userIdentity.userName"),
        "src_endpoint.ip": FieldMap("sourceIPAddress"),
        "cloud.region": FieldMap("awsRegion"),
        "time": FieldMap("eventTime", "timestamp_ns"),
    },
)

SIGN_IN = Mapping(
    source_id="entra-id-signin",
    mapping_version="1",
    schema_version="1.0.0",
    fields={
        "actor.user.uid": FieldMap("userId"),
        "actor.user.email": FieldMap("userPrincipalName"),
        "src_endpoint.ip": FieldMap("ipAddress"),
        "app.name": FieldMap("appDisplayName"),
        "status.error_code": FieldMap("status.errorCode", "int"),
        "time": FieldMap("createdDateTime", "timestamp_ns"),
    },
)


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One event per line: ``text`` and its VARIANT ``event`` (NULL when the line is not valid JSON)."""
    reader = spark.readStream if streaming else spark.read
    return parse_lines(reader.format("text").load(path).withColumnRenamed("value", "text"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Drop blank lines and parse; duplicate keys count as malformed."""
    return once(lines.filter(F.trim("text") != ""), event=F.try_parse_json("text"))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A later filter on a plain column would be pushed below it with its whole expression copied into
    every use; a generator over a one-element array keeps parsing from being repeated.
    """
    packed = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return df.select(*df.columns, F.inline(packed))


def integers_only(text: Column) -> Column:
    """True when every number token outside string literals is a whole int64."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    tokens = F.regexp_extract_all(bare, F.lit(r"(-?[0-9][0-9.eE+\-]*)"), F.lit(1))
    return ~F.exists(tokens, lambda t: t.try_cast("bigint").isNull())


def rfc3339_ns(text: Column) -> Column:
    """RFC 3339 text to UTC nanoseconds; NULL when it is not RFC 3339 or out of range."""
    pattern = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    whole = F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 3))
    digits = F.substring(F.regexp_extract(text, pattern, 2), 2, 9)
    seconds = F.try_multiply(F.unix_seconds(whole.try_cast("timestamp")), F.lit(1_000_000_000))
    ns = F.try_add(seconds, F.rpad(digits, 9, "0").cast("bigint"))
    return F.when(text.rlike(pattern), ns)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _convert(fm: FieldMap, raw: Column) -> tuple[Column, Column]:
    """(JSON text, problem) of one present source value."""
    kind = _kind(raw)
    if fm.type == "int":
        return F.try_variant_get(raw, "$", "bigint").cast("string"), F.when(kind != "BIGINT", F.lit("not_int64"))
    if fm.type == "timestamp_ns":
        ns = rfc3339_ns(F.try_variant_get(raw, "$", "string"))
        return ns.cast("string"), F.when((kind != "STRING") | ns.isNull(), F.lit("bad_timestamp"))
    if fm.type == "":
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        scalar = kind.isin("STRING", "BOOLEAN", "VOID")
        return F.to_json(raw), F.when(numeric, F.lit("untyped_number")).when(~scalar, F.lit("unsupported_value"))
    raise ValueError(f"unknown field type {fm.type!r}")


def _nest(fields: list[tuple[list[str], str]]) -> Column:
    """JSON text of an object; fields whose column is NULL (absent) are left out, empty objects too."""
    by_key: dict[str, list[tuple[list[str], str]]] = {}
    for segs, column in fields:
        by_key.setdefault(segs[0], []).append((segs[1:], column))
    parts = []
    for key in sorted(by_key):
        leaves = by_key[key]
        value = F.col(leaves[0][1]) if not leaves[0][0] else _nest(leaves)
        parts.append(F.concat(F.lit(f'"{key}":'), value))
    some = F.coalesce(*[F.col(c) for _, c in fields]).isNotNull()
    return F.when(some, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def _trie(paths: list[str]) -> dict:
    """Dotted paths as nested dictionaries; a path that is mapped itself is an empty one, whatever is mapped below it."""
    root: dict = {}
    for path in sorted(paths, key=lambda p: p.count(".")):
        node, segs = root, path.split(".")
        for seg in segs[:-1]:
            node = node.setdefault(seg, {None: True})
            if None not in node:  # a shorter path takes the whole value
                break
        else:
            node[segs[-1]] = {}
    return root


def _rest(value: Column, mapped: dict) -> Column:
    """JSON text of an object without the mapped paths; NULL if nothing is left or the value is no object.

    An object with mapped paths below it goes on as what is left of it; any other value in its place was not consumed.
    """
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    names = [name for name in mapped if name is not None]
    plain = F.map_filter(fields, lambda k, v: ~k.isin(*names)) if names else fields
    parts = [F.nullif(F.substring(F.to_json(plain), 2, 1 << 30), F.lit("}"))]
    for name in names:
        if mapped[name]:
            inner = F.try_element_at(fields, F.lit(name))
            whole = F.when(~_kind(inner).startswith("OBJECT"), F.to_json(inner))
            left = F.coalesce(_rest(inner, mapped[name]), whole)
            parts.append(F.concat(F.to_json(F.lit(name).cast("variant")), F.lit(":"), left, F.lit("}")))
    # each part ends with a brace that closes nothing yet
    joined = F.concat_ws(",", *[F.regexp_replace(part, r"\}$", "") for part in parts])
    return F.when(joined != "", F.concat(F.lit("{"), joined, F.lit("}")))


def normalize(lines: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) for lines with ``text``; other columns are kept.

    ``good.payload`` is the canonical JSON of the normalised event.  ``rejected.reason`` is the first
    problem found.  Unconsumed top-level fields are kept under ``unmapped``; a top-level field counts
    as consumed when any path below it is mapped and present.  With ``mapping.unmapped_paths`` only the mapped
    paths themselves count as consumed.
    """
    df = lines if "event" in lines.columns else parse_lines(lines)
    keep = [c for c in df.columns if c != "event"]
    maps = list(mapping.fields.items())

    raws = {f"_r{i}": F.try_variant_get(F.col("event"), "$." + fm.source, "variant") for i, (_, fm) in enumerate(maps)}
    is_object = F.coalesce(_kind(F.col("event")).startswith("OBJECT"), F.lit(False))
    df = once(df, _object=is_object, _whole=integers_only(F.col("text")), **raws)

    values: dict[str, Column] = {}
    problems, leaves = [], []
    for i, (target, fm) in enumerate(maps):
        raw = F.col(f"_r{i}")
        text, problem = _convert(fm, raw)
        values[f"_v{i}"] = F.when(raw.isNotNull(), text)
        problems.append(F.when(raw.isNotNull(), problem))
        leaves.append((target.split("."), f"_v{i}"))
    for key in ("schema_version", "mapping_version", "source_id"):
        values[f"_{key}"] = F.to_json(F.lit(getattr(mapping, key)).cast("variant"))
        leaves.append(([key], f"_{key}"))
    if mapping.unmapped_passthrough and mapping.unmapped_paths:
        values["_unmapped"] = _rest(F.col("event"), _trie([fm.source for _, fm in maps]))
        leaves.append((["unmapped"], "_unmapped"))
    elif mapping.unmapped_passthrough:
        tops: dict[str, Column] = {}
        for i, (_, fm) in enumerate(maps):
            top, there = fm.source.split(".")[0], F.col(f"_r{i}").isNotNull()
            tops[top] = tops[top] | there if top in tops else there
        consumed = F.array_compact(F.array(*[F.when(p, F.lit(t)) for t, p in tops.items()]))
        rest = F.map_filter(
            F.try_variant_get(F.col("event"), "$", "map<string,variant>"), lambda k, v: ~F.array_contains(consumed, k)
        )
        values["_unmapped"] = F.nullif(F.to_json(rest), F.lit("{}"))
        leaves.append((["unmapped"], "_unmapped"))
    values["reason"] = F.coalesce(
        F.when(~F.col("_object"), F.lit("not_an_object")), F.when(~F.col("_whole"), F.lit("not_int64")), *problems
    )
    staged = once(df, **values)
    good = staged.filter("reason is null").withColumn("payload", canonical_json(_nest(leaves)))
    return good.select(*keep, "payload"), staged.filter("reason is not null").select(*keep, "reason")


def replay_corpus(lines: DataFrame, mapping: Mapping, order: str = "line_no") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids per line, evidence rows stored once, rejected lines).

    The same corpus gives the same ids; ``ids`` carries ``order``, so sorting by it gives corpus order.
    """
    good, rejected = normalize(lines, mapping)
    hashed = good.select(order, "payload").withColumn("evidence_id", evidence_id(F.col("payload")))
    store = hashed.select("evidence_id", "payload").dropDuplicates(["evidence_id"]).withColumn("redacted", F.lit(False))
    return hashed.select(order, "evidence_id"), store, rejected


def _leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in schema.fields:
        here = (*prefix, f.name)
        out += _leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [(here, f.dataType)]
    return out


def _struct_type(found: str) -> str:
    """A variant's schema text as a struct type.  Types are replaced, field names (quoted or not) are left alone."""
    token = r"`(?:[^`]|``)*`|(?:(?<=: )|(?<=ARRAY<)|^)(?:OBJECT<|VOID(?=[,>]|$))"
    to = {"OBJECT<": "STRUCT<", "VOID": "STRING"}
    return re.sub(token, lambda m: to.get(m[0], m[0]), found)


def flatten_events(df: DataFrame, column: str = "event") -> DataFrame:
    """Nested keys to underscore-joined columns; the column set is the union over all rows.

    One aggregation finds the union schema (its size depends on the field names, not on the rows); the
    select that follows is an ordinary scan.
    """
    found = df.agg(F.schema_of_variant_agg(F.col(column)).alias("s")).first()["s"]
    struct = _struct_type(found)
    schema = T._parse_datatype_string(struct)
    if not isinstance(schema, T.StructType):
        raise ValueError("events are not JSON objects")
    keep = [c for c in df.columns if c != column]
    whole = once(df.select(*keep, column), _event=F.try_variant_get(F.col(column), "$", struct))
    cols = []
    for segs, _ in sorted(_leaves(schema), key=lambda p: p[0]):
        value = F.col("_event")
        for name in segs:
            value = value.getField(name)
        cols.append(value.alias("_".join(segs)))
    return whole.select(*keep, *cols)
