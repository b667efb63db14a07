"""The queries that `__spark_entry__.py` registers, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, html_text, langid, licenses, media, near_dup, pii, quality, toxicity
from kinweave.llm.common import mod_crc, table


def _held_out(scored: DataFrame, by: int, rest: int) -> DataFrame:
    """With `held_out` after doc_id; a null doc_id is not held out."""
    return scored.select("doc_id", F.coalesce(mod_crc("doc_id", by) == rest, F.lit(False)).alias("held_out"), *scored.columns[1:])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(mod_crc("doc_id", 5) != 0))
    return _held_out(toxicity.score(documents, model), 5, 0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    names, log_p = langid.train(documents.where(mod_crc("doc_id", 3) != 1))
    return _held_out(langid.predict(documents, names, log_p), 3, 1)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(table(spark, sf_dir, "documents"), with_segments=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels.where(mod_crc("doc_id", 5) != 0))
    return _held_out(quality.score(documents, model), 5, 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_decontamination": op5_decontamination,
    "op6_media": op6_media,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_near_dup": op9_near_dup,
    "op10_html_text": op10_html_text,
}

OP5_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
 p as (select distinct item, array_to_string(w[i:i + 9], ' ') as phrase, least(len(w), 10) as n
       from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
 x as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p) where len(w) >= n)),
 o as (select doc_id, item, i, x.n from x join p using (n, phrase)),
 h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from o) group by 1),
 m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from o) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join m using (doc_id)
"""

ORACLE: dict[str, str] = {
    "op3_licenses": licenses.oracle_sql(),
    "op5_decontamination": OP5_SQL,
}
