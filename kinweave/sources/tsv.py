"""Tab-separated sources and sinks of records, links, aliases and candidate lists, and small reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import decode_id, encode_id, source_of

RECORD_SCHEMA = "entity_id string, name string, address string, country string"


def _lines(spark: SparkSession, path) -> DataFrame:
    """Cells of each line but the header, with the line's place; nothing is quoted or escaped."""
    # the first line of each file is its header; a record is a line, so Spark may split files
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("mode", "PERMISSIVE").option("enforceSchema", True).schema(RECORD_SCHEMA).csv(path)


def read_source(spark: SparkSession, path) -> DataFrame:
    """Records: short lines are filled with empty texts, cells beyond the fourth are left out."""
    df = _lines(spark, path)
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns]
    return df.where("entity_id is not null").select(encode_id(F.col("entity_id")).alias("code"), *cells).withColumn("source", source_of(F.col("code")))


def read_sources(spark: SparkSession, folder: str, prefix: str, sources=(1, 2, 3)) -> DataFrame:
    return read_source(spark, [f"{folder}/{prefix}_source{i}.tsv" for i in sources])


def read_links(spark: SparkSession, path, restrict: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (s1, cand) and all entities (s1), those without links too; `restrict` (s1) keeps its entities alone."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("id string, ids string").csv(path).where("id is not null")
    rows = rows.select(encode_id(F.col("id")).alias("s1"), F.coalesce("ids", F.lit("")).alias("ids"))
    if restrict is not None:
        rows = rows.join(restrict.select("s1").distinct(), "s1", "left_semi")
    links = rows.select("s1", F.explode(F.array_distinct(F.filter(F.split("ids", ","), lambda x: x != ""))).alias("cand")).select("s1", encode_id(F.col("cand")).alias("cand"))
    return links, rows.select("s1").distinct()


def read_ids(spark: SparkSession, path) -> DataFrame:
    """Distinct trimmed ids of the first column; blank ones are skipped."""
    return read_source(spark, path).select(F.trim("entity_id").alias("entity_id")).where("entity_id != ''").distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """variant, canonical, score, count; a header may be there; of a repeated variant the last line holds; no path, no rows."""
    schema = "variant string, canonical string, score double, count long"
    if not path:
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.monotonically_increasing_id().alias("line"))
    cell = lambda i: F.get("c", F.lit(i))
    rows = lines.where(F.size("c") >= 2).select(cell(0).alias("variant"), cell(1).alias("canonical"), F.expr("try_cast(get(c, 2) as double)").alias("score"), F.expr("try_cast(get(c, 3) as long)").alias("count"), "line")
    rows = rows.where("variant != '' and canonical != '' and not (variant = 'variant' and canonical = 'canonical')")
    return rows.groupBy("variant").agg(F.max_by(F.struct("canonical", "score", "count"), "line").alias("v")).select("variant", "v.*")


def texts_of(records: DataFrame, need: DataFrame) -> DataFrame:
    """Records whose code is in need (code)."""
    return records.join(need.select("code").distinct(), "code", "left_semi")


def id_lists(entities: DataFrame, links: DataFrame, order: str | None = None) -> DataFrame:
    """source1_entity_id and a comma list for every entity; by `order`, else by the ids as text; empty without links."""
    ids = decode_id(F.col("cand"))
    item = F.struct(F.col(order), ids.alias("id")) if order else F.struct(ids.alias("id"))
    lists = links.groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["id"]), ",").alias("ids"))
    return entities.select("s1").join(lists, "s1", "left").select(decode_id(F.col("s1")).alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("ids"))


def candidate_lists(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    return id_lists(entities, pairs, "rank").withColumnRenamed("ids", "candidate_entity_ids")


def matching_lists(entities: DataFrame, links: DataFrame) -> DataFrame:
    return id_lists(entities, links).withColumnRenamed("ids", "matched_entity_ids")


def confident_links(pairs: DataFrame, p: Column, least: float = 0.98) -> DataFrame:
    """Lists of the entities that have a link of probability `least` or more, and of no others."""
    sure = pairs.where(p >= least)
    return id_lists(sure.select("s1").distinct(), sure).withColumnRenamed("ids", "matched_entity_ids")


def write_tsv(df: DataFrame, path: str, files: int | None = None) -> None:
    """With a header, nothing quoted; as many files as Spark has tasks unless `files` is given."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def country_subset(records: DataFrame, country: str) -> DataFrame:
    return records.where(F.col("country") == country)


def dev_subset(records: DataFrame, links: DataFrame, clusters: int = 8000, distractors: int = 120_000, one_in: int = 20) -> DataFrame:
    """Records of the first `clusters` entities with a link, their true targets, and every `one_in`-th other target by
    code, up to `distractors` in order. The limits are what a development sample is."""
    first = links.select("s1").distinct().orderBy("s1").limit(clusters)
    true = links.join(first, "s1", "left_semi").select(F.col("cand").alias("code")).distinct()
    kept = records.join(first.withColumnRenamed("s1", "code").union(true), "code", "left_semi")
    other = records.where((F.col("source") > 1) & (F.col("code") % one_in == 0)).join(true, "code", "left_anti").orderBy("code").limit(distractors)
    return kept.unionByName(other)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, read by Spark so that any store will do."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)
