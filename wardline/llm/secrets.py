"""Secret scans: base patterns, and a verdict on every candidate from the corpus-wide frequency of its owners.

Only DataFrame functions run here.  Spans are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import put_down, scope, text_or_empty


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
VALUE = "[A-Za-z0-9+/_.=-]+"

#: Kinds of matches in the order in which spans with one start are listed, with their patterns.  Of ``access`` and ``hex``
#: only matches that are long enough are looked for: a shorter run holds no longer one.  ``opaque`` makes candidates only.
PATTERNS = {
    "assign": f"""(?:{KEYS})["']?\\x20*[:=]\\x20*["']?{VALUE}""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "opaque": "[A-Za-z0-9+/_-]{20,}",
}
BASE = ("assign", "access", "hex")
ADDED = ("copied", "live")

#: What stands before the value of an assignment.
LEAD = f"""^(?:{KEYS})["']?\\x20*[:=]\\x20*["']?"""

#: The least length of an assignment's value, and of a value that can be judged.
ASSIGNED, JUDGED = 6, 16

#: Words that show a value to be made up.
MADE_UP = "(?i)example|sample|dummy|placeholder|changeme|x{6}|0{8}|1234567"


def _pieces(text: Column, kind: str) -> Column:
    """Every match of a kind with the length of the gap before it: the text split at the matches, and the matches."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    made = F.zip_with(found, gaps, lambda f, g: F.struct(g.alias("gap"), f.alias("match"), F.lit(kind).alias("kind")))
    return F.filter(made, lambda piece: piece["match"].isNotNull())


def _matches(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """``row, doc_id, owner, repository, pieces``: a row for each document, its matches of every kind as ``pieces``."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.to_json(F.array(*known)).alias("repository"),
        text_or_empty().alias("body"),
    )
    hit = {kind: F.col("body").rlike(pattern) for kind, pattern in PATTERNS.items()}
    hit["access"] = F.col("body").contains("AKIA")
    hit["assign"] = F.col("body").rlike("[:=]") & hit["assign"]
    kinds = [F.when(hit[kind], _pieces(F.col("body"), kind)) for kind in PATTERNS]
    none = F.array().cast("array<struct<gap:int,match:string,kind:string>>")
    pieces = F.concat(*(F.coalesce(k, none) for k in kinds))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", pieces.alias("pieces"))


def _spans(found: DataFrame) -> DataFrame:
    """``row, owner, repository, kind, start, end, match`` of every match.

    A match starts where the gaps and matches before it end: a running sum within one document and kind.
    """
    told = found.select("row", "owner", "repository", F.posexplode("pieces").alias("nth", "p"))
    told = told.select("row", "owner", "repository", "nth", "p.kind", "p.gap", "p.match")
    line = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = told.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(line))
    return ends.select("row", "owner", "repository", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match")


def looks_live(value: Column) -> Column:
    """Letters and digits, eight different characters, and nothing that shows a made-up value."""
    different = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return (F.length(value) >= JUDGED) & mixed & (different >= 8) & ~value.rlike(MADE_UP)


def holders(candidates: DataFrame) -> DataFrame:
    """``digest, owners, repositories`` over ``candidates`` (``digest, owner, repository``).

    Copies fold before every shuffle, so a value that a third of all rows hold sends a row per task and repository.
    """
    seen = candidates.select("digest", "owner", "repository").distinct()
    of_owner = seen.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return of_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def _times(values: Column, value: int) -> Column:
    return F.size(F.filter(values, lambda v: v == value)).cast("long")


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), copied_owners: int = 3) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live`` for every row of ``docs``.

    *Base* kinds are the first three of :data:`PATTERNS`, leftmost matches that do not overlap; an ``assign`` match whose
    value has fewer than six characters is dropped after matching, so it still hides what it covers.

    *Candidates* are the values of base matches and opaque runs of 20 or more characters, at least 16 characters long,
    known by their SHA-256.  Over the whole corpus a candidate has the number of distinct ``owner`` s and ``repository``
    column values that hold it.  Held by ``copied_owners`` owners or more it is a widely copied example: its spans are
    added as ``copied``.  Held by fewer, and looking like a random credential (:func:`looks_live`), it belongs to its
    owners: its spans are added as ``live``.  Base spans stay in either case.

    ``spans`` lists all as ``kind:start:end`` by start, kind (:data:`BASE`, then :data:`ADDED`) and end;
    ``base_sha256`` is the hash of the base ones so joined.

    A null text is empty; a text without spans has empty ``spans``.  Null owners are one owner, the unknown one, and
    null repository columns are values of their own.  Repeated rows, and rows without id, are scanned one by one but add
    no holder.  Long texts are read whole.  No rows give no rows.  Other columns are ignored.
    """
    with scope():
        found = put_down(_matches(docs, owner, list(repository)), "secret-matches", kept=True)
        places = _spans(found.where(F.size("pieces") > 0))
        lead = F.when(F.col("kind") == "assign", F.length("match") - F.length(F.regexp_replace("match", LEAD, ""))).otherwise(0)
        places = places.withColumn("at", F.col("start") + lead).withColumn("size", F.col("end") - F.col("at"))
        places = places.where((F.col("kind") != "assign") | (F.col("size") >= ASSIGNED))
        value = F.substring("match", F.col("at") - F.col("start") + 1, F.length("match"))
        places = places.select(
            "row", "owner", "repository", "kind", "start", "end", "at",
            F.when(F.col("size") >= JUDGED, F.sha2(value, 256)).alias("digest"), looks_live(value).alias("live"),
        )
        places = put_down(places, "secret-places")
        candidates = places.where("digest is not null").select("row", "owner", "repository", "at", "end", "digest", "live").distinct()
        held = holders(candidates)
        verdict = F.when(F.col("owners") >= copied_owners, F.lit("copied")).when(F.col("live"), F.lit("live"))
        judged = candidates.join(held, "digest").select("row", verdict.alias("kind"), F.col("at").alias("start"), "end").where("kind is not null")
        base = places.where(F.col("kind").isin(*BASE)).select("row", "kind", "start", "end")
        order = F.array_position(F.array(*map(F.lit, BASE + ADDED)), F.col("kind"))
        span = F.struct("start", order.alias("nth"), "end", F.concat_ws(":", "kind", "start", "end").alias("said"))
        listed = base.union(judged).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"))
        listed = put_down(listed.withColumnRenamed("row", "of"), "secret-spans", kept=True)

    every = F.coalesce("all", F.array().cast(listed.schema["all"].dataType))
    nth = F.transform(every, lambda s: s["nth"])
    counted = [_times(nth, i).alias(f"n_{kind}") for i, kind in enumerate(BASE + ADDED, 1)]
    said = {name: F.array_join(F.transform(chosen, lambda s: s["said"]), ",") for name, chosen in (
        ("base", F.filter(every, lambda s: s["nth"] <= len(BASE))), ("spans", every))}
    whole = found.select("row", "doc_id").join(listed, F.col("row") == F.col("of"), "left")
    return whole.select(
        "doc_id", *counted[: len(BASE)], F.sha2(said["base"], 256).alias("base_sha256"),
        said["spans"].alias("spans"), *counted[len(BASE) :],
    )
