"""The op queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, langid, line_dedup, lm_score, neardup_vectors, packing, quality, simhash, token_file


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_read(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.lm_scores(_read(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("log_sum", 3).alias("log_sum"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {f.__name__: f for f in (op1_token_file, op2_embedding_neardup, op3_html_text, op4_line_dedup, op5_decontaminate, op6_lm_score, op7_quality, op8_best_fit_packing, op9_langid, op10_simhash)}

ORACLE_SQL = {
    "op4_line_dedup": """
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents
), lines as (
  select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from split
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), repeated as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), marked as (
  select a.doc_id, a.pos, a.line, (r.k is not null and r.keeper <> a.doc_id) as gone
  from keyed a left join repeated r on a.k = r.k
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op2_embedding_neardup": """
with recursive valid as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as x, b.vec_id as y from valid a join valid b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.98
), reach as (
  select vec_id as x, vec_id as y from embeddings
  union
  select r.x, l.y from reach r join link l on r.y = l.x
), least as (select x, min(y) as component_id from reach group by x),
n as (select x, count(*) as n_links from link group by x)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, least.component_id, e.vec_id = least.component_id as kept
from embeddings e join least on least.x = e.vec_id left join n on n.x = e.vec_id
""",
    "op6_lm_score": r"""
with tokens as (
  select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents)
), grams as (
  select doc_id, i, w, lag(w, 1) over d as p, lag(w, 2) over d as q from tokens window d as (partition by doc_id order by i)
), counted as (
  select *,
    count(*) over (partition by w) - count(*) over (partition by w, doc_id) as c1,
    case when p is not null then count(*) over (partition by p, w) - count(*) over (partition by p, w, doc_id) else 0 end as c2,
    case when q is not null then count(*) over (partition by q, p, w) - count(*) over (partition by q, p, w, doc_id) else 0 end as c3,
    (select count(*) from tokens) - count(*) over (partition by doc_id) as others
  from grams
), context as (
  select *, lag(c1) over d as c1p, lag(c2) over d as c2p from counted window d as (partition by doc_id order by i)
), scored as (
  select doc_id, case
    when c3 > 0 then ln(c3) - ln(c2p)
    when c2 > 0 then (least(i - 1, 2) - 1) * ln(0.4) + ln(c2) - ln(c1p)
    else least(i - 1, 2) * ln(0.4) + ln(greatest(c1, 0.5)) - ln(greatest(others, 1)) end as lp
  from context
), sums as (select doc_id, count(*) as n_words, sum(lp) as s from scored group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, round(coalesce(s, 0.0)::double, 3) as log_sum,
       round(coalesce(s / n_words, 0.0)::double, 6) as log_score
from documents d left join sums using (doc_id)
""",
}
