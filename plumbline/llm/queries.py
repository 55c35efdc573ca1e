"""The operators of this package as queries over the synthetic tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, langid, lm, mixing, neardup, quality, sharding, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20; they are searched among all rows."""
    v = _table(spark, sf_dir, "embeddings")
    return topk.top_k(v, queries=v.where("vec_id % 20 = 0"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.page_records(_table(spark, sf_dir, "pages")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), id_column="doc_id")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_sharding, op3_warc_revisits, op4_toxicity, op5_quality_rules, op6_mixing, op7_lm_scoring, op8_near_duplicates, op9_language_id, op10_bpe)}

ORACLE_SQL = {
    "op1_exact_top_k": """
        with v as (select vec_id, embedding::double[] e from embeddings where vec_id is not null and embedding is not null),
        s as (select a.vec_id, b.vec_id as neighbor_id, list_dot_product(a.e, b.e) s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
        r as (select vec_id, neighbor_id, row_number() over (partition by vec_id order by s desc, neighbor_id) as rank from s)
        select vec_id, neighbor_id, rank::int as rank from r where rank <= 10""",
    "op2_sharding": """
        with t as (select doc_id, strlen(coalesce(text, ''))::bigint as bytes from documents),
        r as (select doc_id, bytes, sum(bytes) over (order by doc_id nulls first, bytes rows unbounded preceding) - bytes as start, sum(bytes) over () as total from t)
        select doc_id, bytes, (case when total = 0 then 0 else least(63, (start * 64) // total) end)::int as shard from r""",
    "op3_warc_revisits": r"""
        with base as (select page_id p, url, md5(coalesce(html, '')) d, strlen(html) n from pages),
        rec as (
          select p * 2 as record_id, url, p as t, 1 as resp, '"' || substr(d, 1, 16) || '"' as etag, n::varchar as len, p from base
          union all
          select p * 2 + 1, 'HTTPS://WWW.' || regexp_replace(regexp_replace(url, '^https?://(www[.])?', ''), '#.*$', '') || '#seen', p + case when substr(d, 1, 1) = 'f' then -3 else 7 end, 0,
            case when substr(d, 1, 1) < '4' then 'W/"' || substr(d, 1, 16) || '"' when substr(d, 1, 1) < '6' then '"changed"' else '"' || substr(d, 1, 16) || '"' end, null, p from base),
        bare as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') as x from rec),
        parts as (select *, regexp_replace(regexp_replace(lower(regexp_extract(x, '^[^/?]*', 0)), '^www[.]', ''), case when regexp_matches(trim(url), '^(?i)https://') then ':443$' else ':80$' end, '') as host, regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
            array_to_string(list_sort(list_filter(string_split(regexp_extract(x, '[?](.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(utm_.*|fbclid|gclid|ref)(=.*)?$'))), '&') as q from bare),
        keyed as (select *, host || path || case when q <> '' then '?' || q else '' end as u from parts),
        latest as (select *, last_value(case when resp = 1 then {'id': record_id, 'etag': etag, 'len': len, 'p': p} end ignore nulls) over (partition by u order by t, resp, record_id rows between unbounded preceding and 1 preceding) as s from keyed),
        v as (select *, case when s is null then 'no_response' when regexp_replace(etag, '^W/', '') = regexp_replace(s.etag, '^W/', '') then 'resolved' else 'validator_mismatch' end as status from latest where resp = 0)
        select record_id, s.id as response_id, status, case when status = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || coalesce(s.len, '') || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || (p + 7)::varchar || chr(10) || 'etag: ' || etag || chr(10) || 'last-modified: t' || s.p::varchar || chr(10) || 'server: origin' end as headers from v""",
}
