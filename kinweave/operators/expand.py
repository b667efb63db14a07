"""Cluster expansion: rare shared keys of an entity or its links make new candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions import text

KINDS = ("core", "skel", "compact")
#: Records that a key may have, and new candidates of an entity (rarest keys first), as the operator is defined.
MAX_FREQ, MAX_NEW = 20, 30
LEAST_KEY = 3


def keys(views: DataFrame) -> DataFrame:
    """country, kind, value, code: three name keys of each record; keys of under three letters don't count."""
    values = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in zip(KINDS, (text.sorted_set(F.col("core")), F.col("skstr"), F.col("compact")), strict=True)])
    return views.select("country", "code", F.explode(values).alias("k")).select("country", "k.kind", "k.value", "code").where(F.length("value") >= LEAST_KEY)


def rare_keys(target_keys: DataFrame, max_freq: int = MAX_FREQ) -> DataFrame:
    """country, kind, value, freq of the keys that few enough targets have, which also bounds the join below."""
    return target_keys.groupBy("country", "kind", "value").agg(F.count("*").alias("freq")).where(F.col("freq") <= max_freq)


def generate(views: DataFrame, seeds: DataFrame, existing: DataFrame, max_freq: int = MAX_FREQ, max_new: int = MAX_NEW) -> DataFrame:
    """s1, cand, six hit flags, n_member_hits, min_freq, best_member_p.

    seeds: s1, member, p (links so far; the entity itself is added); existing: s1, cand pairs that aren't new.
    """
    all_keys = keys(views)
    targets = all_keys.where(F.col("code") >= 2 * text.CODE)
    rare = rare_keys(targets, max_freq)
    index = targets.join(rare, ["country", "kind", "value"]).withColumnRenamed("code", "cand")
    members = views.where("source = 1").select(F.col("code").alias("s1"), F.col("code").alias("member"), F.lit(1.0).alias("p")).unionByName(seeds.select("s1", "member", "p"))
    mine = members.join(all_keys.withColumnRenamed("code", "member"), "member")
    found = mine.join(index, ["country", "kind", "value"]).where("cand != member").join(existing.select("s1", "cand"), ["s1", "cand"], "left_anti")
    own = F.col("s1") == F.col("member")
    flags = [F.max((own if side == "s1" else ~own).cast("int") * (F.col("kind") == k).cast("int")).alias(f"hit_{k}_{side}") for side in ("s1", "m") for k in KINDS]
    folded = found.groupBy("s1", "cand").agg(*flags, F.count_distinct(F.when(~own, F.col("member"))).alias("n_member_hits"), F.min("freq").alias("min_freq"), F.coalesce(F.max(F.when(~own, F.col("p"))), F.lit(0.0)).alias("best_member_p"))
    first = W.partitionBy("s1").orderBy("min_freq", "cand")
    return folded.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_new).drop("r")


def features(generated: DataFrame, scored: DataFrame, links: DataFrame) -> DataFrame:
    """The flags and numbers of generate() with log_min_freq, is_s3 and the entity's own ent_n_pred, ent_pmax, ent_psum."""
    stats = scored.groupBy("s1").agg(F.max("p").alias("ent_pmax"), F.sum("p").alias("ent_psum"))
    n = links.groupBy("s1").agg(F.count("*").alias("ent_n_pred"))
    out = generated.join(stats, "s1", "left").join(n, "s1", "left").withColumn("log_min_freq", F.log("min_freq")).withColumn("is_s3", (text.source_of(F.col("cand")) == 3).cast("double"))
    return out.drop("min_freq").fillna(0, ["ent_pmax", "ent_psum", "ent_n_pred"])


def member_similarities(generated: DataFrame, seeds: DataFrame, views: DataFrame, most: int = 6) -> DataFrame:
    """s1, cand, mem_name_max, mem_tri_max, mem_addr_max, mem_conflict_min over the first members; (0, 0, 0, 1) without any."""
    from kinweave.functions import fuzzy

    few = seeds.withColumn("r", F.row_number().over(W.partitionBy("s1").orderBy("member"))).where(F.col("r") <= most).select("s1", "member")
    cols = ("nstr", "astr", "ntri", "num")
    a = views.select(F.col("code").alias("member"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = views.select(F.col("code").alias("cand"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = generated.select("s1", "cand").join(few, "s1").join(a, "member").join(b, "cand")
    conflict = ((F.size("a_num") > 0) & (F.size("b_num") > 0) & ~F.arrays_overlap("a_num", "b_num")).cast("double")
    sims = both.select("s1", "cand", fuzzy.fuzzy_token_set("a_nstr", "b_nstr").alias("n"), text.jaccard(F.col("a_ntri"), F.col("b_ntri")).alias("t"), fuzzy.fuzzy_token_set("a_astr", "b_astr").alias("a"), conflict.alias("c"))
    best = sims.groupBy("s1", "cand").agg(F.max("n").alias("mem_name_max"), F.max("t").alias("mem_tri_max"), F.max("a").alias("mem_addr_max"), F.min("c").alias("mem_conflict_min"))
    return generated.select("s1", "cand").join(best, ["s1", "cand"], "left").fillna(0.0, ["mem_name_max", "mem_tri_max", "mem_addr_max"]).fillna(1.0, ["mem_conflict_min"])
