"""Business-like records from the `documents` table: an id in one of three sources, a name and an address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import CODE, decode_id


#: The first sentence or line of a text, white space before it included.
FIRST = r"^[ \t\n\x0B\f\r]*[^\n]*?(?:[.!?]+(?=[ \t\n\x0B\f\r])|(?=\n)|\z)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, source, entity_id, country, name, address of every document.

    The name is the first sentence or line and the address all of the rest, so that both together are the whole text.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = (F.col("doc_id") % 3 + 1).cast("int")
    t = F.coalesce("text", F.lit(""))
    name = F.regexp_extract(t, FIRST, 0)
    address = F.substr(t, F.length(name) + 1)
    out = docs.select(
        (source.cast("long") * CODE + F.col("doc_id")).alias("code"), source.alias("source"), F.coalesce("lang", F.lit("")).alias("country"),
        name.alias("name"), address.alias("address"),
    )
    return out.withColumn("entity_id", decode_id(F.col("code")))


def true_links(records_: DataFrame) -> DataFrame:
    """s1, cand: a target and the least entity of the same country whose lower-cased name is the same."""
    name = F.lower("name")
    entities = records_.where("source = 1").groupBy("country", name.alias("key")).agg(F.min("code").alias("s1"))
    targets = records_.where("source > 1").select("country", name.alias("key"), F.col("code").alias("cand"))
    return targets.join(entities, ["country", "key"]).select("s1", "cand")
