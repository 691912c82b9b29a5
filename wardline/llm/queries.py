"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import exact, hardnegatives, imatch, langid, notices, packing, repeats, secrets, sentencepieces, simhash, urls, warc, whitening
from wardline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_warc",
    """
    with p as (select page_id, url, encode(coalesce(html, '')) as body from pages),
         d as (select page_id, url, octet_length(body) as payload_bytes, sha1(body) as payload_digest from p),
         k as (select *, max(page_id) over (partition by payload_digest) as kept from d)
    select page_id, url, payload_bytes, payload_digest,
           case when payload_bytes >= 1000 and kept > page_id then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 1000 and kept > page_id then kept end as refers_to
    from k
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, distance=4)


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op3_urls")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, and decoded again from its ids."""
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = sentencepieces.encode(read_table(spark, sf_dir, "documents"), model).withColumn("n_ids", F.size("ids").cast("long"))
    decoded = sentencepieces.decode(encoded, model)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


@query("op6_imatch")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Fitted on the two thirds of ids that are not held out."""
    return langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op8_licenses")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan(read_table(spark, sf_dir, "documents"))


@query("op9_repeats")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"), length=400)


@query(
    "op10_exact",
    """
    with d as (select doc_id, coalesce(text, '') as body from documents)
    select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
           doc_id = max(doc_id) over same as kept, sha256(body) as text_sha256
    from d window same as (partition by body)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


@query(
    "op11_hardnegatives",
    """
    with e as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
                      list_transform(embedding, lambda c: floor(256 * c::double)) as x
               from embeddings
               where vec_id is not null and label is not null and embedding is not null
                     and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
         s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
               from e a, e b where a.vec_id % 100 = 0 and (a.label <> b.label or a.vec_id <> b.vec_id)),
         p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
               qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select anchor_id, positive_id, (row_number() over hits)::int as rank, vec_id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id)
    where not same and 80 * positive_score <= 100 * score and score <= positive_score
    window hits as (partition by anchor_id, positive_id order by score desc, vec_id)
    qualify row_number() over hits <= 5
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_table(read_table(spark, sf_dir, "embeddings"))


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(
    "op13_secrets",
    f"""
    with d as (select row_number() over () as r, doc_id, coalesce(source, '') as owner, coalesce(text, '') as body from documents),
         k(nth, kind, pattern) as (values {", ".join(f"({n}, '{kind}', {_text(p)})" for n, (kind, p) in enumerate(secrets.PATTERNS.items(), 1))}),
         m as (select r, owner, nth, kind, regexp_extract_all(body, pattern) as ms, string_split_regex(body, pattern) as gs from d, k),
         u as (select r, owner, nth, kind, unnest(ms) as m, unnest(gs[:len(ms)]) as g, unnest(range(len(ms))) as i from m where len(ms) > 0),
         e as (select *, sum(length(g) + length(m)) over (partition by r, nth order by i)::bigint as ends,
                      case when kind = 'assign' then regexp_replace(m, {_text(secrets.LEAD)}, '') else m end as value from u),
         p as (select *, ends - length(m) as starts, ends - length(value) as start_at from e where kind <> 'assign' or length(value) >= {secrets.ASSIGNED}),
         c as (select distinct r, owner, start_at, ends, value from p where length(value) >= {secrets.JUDGED}),
         h as (select value, count(distinct owner) as owners from c group by value),
         j as (select r, start_at, ends, case when owners >= 3 then 'copied' else 'live' end as kind
               from c join h using (value)
               where owners >= 3 or (regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
                     and len(list_distinct(string_split(value, ''))) >= 8 and not regexp_matches(value, {_text(secrets.MADE_UP)}))),
         s as (select r, starts, nth, ends, kind from p where nth <= 3
               union all select r, start_at, case kind when 'copied' then 4 else 5 end, ends, kind from j),
         t as (select r, {", ".join(f"count(*) filter (nth = {n}) as n_{kind}" for n, kind in enumerate(secrets.BASE + secrets.ADDED, 1))},
                      string_agg(kind || ':' || starts || ':' || ends, ',' order by starts, nth, ends) filter (nth <= 3) as base,
                      string_agg(kind || ':' || starts || ':' || ends, ',' order by starts, nth, ends) as spans
               from s group by r)
    select doc_id, {", ".join(f"coalesce(n_{kind}, 0) as n_{kind}" for kind in secrets.BASE + secrets.ADDED)},
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join t using (r)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources; a repository is a source and language."""
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
