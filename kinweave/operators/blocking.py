"""Two-channel candidate generation: an equi-join on weighted tokens, summed for each pair, best ones kept.

`all` has the tokens of name and address, `name` the keys of `functions.text.name_keys`. Tokens over `df_cap` are
ignored; those over `gen_cap` only score pairs that rarer tokens made.

Entities and targets of a country are dealt into blocks. A task has a block of each in memory and finds the best pairs of
both (`functions.overlap`), one block of targets of a span after the other; only an entity's best pairs of the span leave it,
and the best of all spans are ranked then. What is stored are packed records, of targets once for each block of entities and
of entities once for each span, and never the matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions import overlap, packed, text
from kinweave.plans.staging import made, staged

DF_CAP = 200_000
TOPK, NAME_TOPK, MIN_SHARED, RARE_SCORE = 50, 25, 2, 6.0
#: nrank of a pair that isn't among the name channel's best.
NO_RANK = 999
#: Records of a block, and tokens of a block of entities and of targets, about; a task has one of each in memory, and as many
#: blocks of targets as SPAN packed.
CHUNK, TOKENS, TARGET_TOKENS, SPAN = 1 << 15, 3 << 20, 1 << 22, 4


def record_views(records: DataFrame, aliases: Column | None = None) -> DataFrame:
    """records with the token views that every feature needs, each computed once for a record."""
    name = text.name_tokens(F.col("name"))
    out = records.withColumn("name_seq", name).withColumn("addr_seq", text.tokens(F.col("address")))
    out = out.withColumn("core_seq", text.canonical(text.core_tokens(F.col("name_seq")), aliases))
    out = out.withColumn("ntok_seq", text.canonical(F.col("name_seq"), aliases))
    out = out.withColumn("ntok", F.array_distinct("ntok_seq")).withColumn("core", F.array_distinct("core_seq"))
    out = out.withColumn("atok", F.array_distinct(text.canonical(F.col("addr_seq"), aliases)))
    out = out.withColumn("num", text.numeric_tokens(F.col("atok")))
    out = out.withColumn("ntri", text.char_ngrams(F.col("name"))).withColumn("atri", text.char_ngrams(F.col("address")))
    out = out.withColumn("script", text.script_of(F.col("name")))
    out = out.withColumn("skel", text.skeletons(F.col("core_seq")))
    out = out.withColumn("askel", text.skeletons(F.filter("atok", lambda t: ~t.rlike(r"^\p{N}+$"))))
    out = out.withColumn("nstr", text.sorted_set(F.col("ntok"))).withColumn("astr", text.sorted_set(F.col("atok")))
    out = out.withColumn("skstr", text.sorted_set(F.col("skel"))).withColumn("compact", F.array_join("core_seq", ""))
    return out.drop("name_seq", "addr_seq")


def channel_tokens(views: DataFrame, channel: str) -> DataFrame:
    """code, source, country, toks: distinct tokens of a channel, `all` or `name`."""
    toks = F.array_union("ntok", "atok") if channel == "all" else text.name_keys(F.col("ntok_seq"))
    return views.select("code", "source", "country", toks.alias("toks"))


def token_weights(channel: DataFrame) -> DataFrame:
    """country, token, df, idf: over the targets (sources 2 and 3) together; idf = ln(1 + N / df)."""
    targets = channel.where("source > 1")
    n = targets.groupBy("country").agg(F.count("*").alias("n"))
    df = targets.select("country", F.explode("toks").alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))
    # one row for each country; the plan broadcasts it when Spark knows that it is small
    return df.join(n, "country").select("country", "token", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))


def weighted(weights: DataFrame, df_cap: int = DF_CAP, gen_cap: int | None = None) -> DataFrame:
    """Indexed tokens with weight w = idf^2 and tier: `generating` makes pairs, `common` only scores them."""
    gen = df_cap if gen_cap is None else gen_cap
    tier = F.when(F.col("df") <= gen, "generating").otherwise("common")
    return weights.where(F.col("df") <= df_cap).select("country", "token", "df", "idf", (F.col("idf") * F.col("idf")).alias("w"), tier.alias("tier"))


def postings(channel: DataFrame, queries: bool) -> DataFrame:
    """country, token and s1 (entities) or cand (targets): one row for each token of a record."""
    return channel.where("source = 1" if queries else "source > 1").select("country", F.col("code").alias("s1" if queries else "cand"), F.explode("toks").alias("token"))


def _code(token: Column) -> Column:
    return F.xxhash64("country", token)


def coded(channel: DataFrame) -> DataFrame:
    """A channel with a 64-bit code for each token of a country: a third of the bytes."""
    return channel.withColumn("toks", F.transform("toks", _code))


def _sums(toks: DataFrame, weights: list[DataFrame], most: tuple[int, ...], min_shared: int, rare_score: float) -> DataFrame:
    """country, s1, cand and for each channel c score<c>, shared<c>, made<c> of the pairs that may be among the best.

    toks: code, source, country and the channels' coded tokens, t0 and so on. Entities and targets of a country are dealt
    into blocks. A task has a block of entities and meets SPAN blocks of targets one after the other; it keeps the best pairs
    of all of them alone, so no pair of the rest is ever stored.
    """
    columns = [f"t{c}" for c in range(len(most))]
    # countries of one block need no row here, so there are as many as blocks at most
    size = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(sum(F.size(c) for c in columns)) / F.when(F.col("own"), TOKENS).otherwise(TARGET_TOKENS))).cast("int")
    sizes = toks.where("source > 0").withColumn("own", F.col("source") == 1).groupBy("country", "own").agg(size.alias("parts"))
    parts = lambda own: F.max(F.when(F.col("own") == own, F.col("parts")))
    blocks = F.broadcast(sizes.where("parts > 1").groupBy("country").agg(parts(True).alias("lows"), parts(False).alias("highs")))

    lows, highs = F.coalesce("lows", F.lit(1)), F.coalesce("highs", F.lit(1))
    at = lambda n: F.pmod(F.xxhash64("code"), n).cast("int")

    def packs(rows: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        """rows (country, own, others and the rest) packed, once for each block (or span of blocks) of the other side."""
        out = rows.mapInArrow(packed.packer(["country", own, "others"]), f"country string, {own} int, others int, payload binary")
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        return out.withColumn("span", F.floor(F.col("high") / SPAN).cast("int") if own == "high" else F.col("span")).select("country", "low", "span", (F.col("high") if own == "high" else F.lit(kind)).alias("kind"), "payload")

    mine = toks.where("source = 1").join(blocks, "country", "left").select("country", at(lows).alias("low"), F.ceil(highs / SPAN).cast("int").alias("others"), F.col("code").alias("s1"), *columns)
    targets = toks.where("source > 1").join(blocks, "country", "left").select("country", at(highs).alias("high"), lows.alias("others"), F.col("code").alias("cand"), *columns)
    entities = packs(mine, "low", "span", 0)
    for c, w in enumerate(weights):  # what each token of a block of entities weighs, once
        known = mine.select("country", "low", "others", F.explode(f"t{c}").alias("token")).distinct()
        known = known.join(w.select("country", "token", F.when(F.col("tier") == "common", -F.col("w")).otherwise(F.col("w")).alias("w")), ["country", "token"])
        known = known.repartition("country", "low")
        entities = entities.unionByName(packs(known.select("country", "low", "others", "token", "w"), "low", "span", c + 1))
    targets = packs(targets, "high", "low", 0).withColumnsRenamed({"country": "land", "kind": "high"})
    found = ", ".join(f"score{c} double, shared{c} long, made{c} boolean" for c in range(len(most)))

    def search(key, left, right):
        kinds = left.column("kind").to_numpy()
        parts = lambda k: [packed.unpack(x) for x, n in zip(left.column("payload"), kinds, strict=True) if n == k]
        highs = right.column("high").to_numpy()
        blocks = (overlap.plain([packed.unpack(x) for x, n in zip(right.column("payload"), highs, strict=True) if n == high]) for high in np.unique(highs))
        out = overlap.best_pairs(overlap.weighed(parts(0), [parts(c + 1) for c in range(len(most))]), blocks, most, min_shared, rare_score)
        return out.add_column(0, "country", [[key[0].as_py()] * len(out)]) if len(out) else out.add_column(0, "country", pa.array([], pa.string()))

    return entities.groupBy("country", "low", "span").cogroup(targets.groupBy("land", "low", "span")).applyInArrow(search, f"country string, s1 long, cand long, {found}")


def _kept(shared: str, score: str, min_shared: int, rare_score: float) -> Column:
    return (F.col(shared) >= min_shared) | (F.round(score, 6) >= rare_score)


def channel_pairs(channel: DataFrame, weights: DataFrame, topk: int, min_shared: int = MIN_SHARED, rare_score: float = RARE_SCORE, common: bool = True) -> DataFrame:
    """country, s1, cand, shared, score, rank (from 0) of the best topk pairs of each entity; topk 0 gives none.

    common: whether `weights` may have tokens of that tier.
    """
    if channel.schema["toks"].dataType.elementType.simpleString() == "string":
        channel, weights = coded(channel), weights.withColumn("token", _code(F.col("token")))
    weights = weights if common else weights.where("tier = 'generating'")
    pairs = _sums(channel.withColumnRenamed("toks", "t0"), [weights], (topk,), min_shared, rare_score).withColumnsRenamed({"score0": "score", "shared0": "shared"})
    pairs = pairs.where(_kept("shared", "score", min_shared, rare_score)).withColumn("score", F.round("score", 6))
    best = W.partitionBy("s1").orderBy(F.desc("score"), "cand")
    pairs = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= topk)
    return pairs.select("country", "s1", "cand", "shared", "score", (F.col("place") - 1).alias("rank"))


def block(views: DataFrame, topk: int = TOPK, name_topk: int = NAME_TOPK, df_cap: int = DF_CAP, gen_cap: int | None = None, name_gen_cap: int | None = None, min_shared: int = MIN_SHARED, steps: list[DataFrame] | None = None) -> DataFrame:
    """The candidate table: country, s1, cand, score, shared, rank, nscore, nshared, nrank.

    steps: gets the tables that are kept for it, which a caller that has written the result can let go.

    The union of both channels' best pairs, every pair scored in both channels on all indexed tokens; rank by score, then
    name score, then target; nrank is the place among the name channel's best, else NO_RANK.
    """
    codes = [F.transform(t, _code).alias(n) for n, t in (("t0", F.array_union("ntok", "atok")), ("t1", text.name_keys(F.col("ntok_seq"))))]
    toks = made(views.select("code", "source", "country", *codes))
    weights = [staged(weighted(token_weights(toks.select("code", "source", "country", F.col(f"t{c}").alias("toks"))), df_cap, cap)) for c, cap in enumerate((gen_cap, name_gen_cap))]
    if steps is not None:
        steps += [toks, *weights]
    pairs = _sums(toks, weights, (topk, name_topk), min_shared, RARE_SCORE).withColumnsRenamed({"score0": "score", "shared0": "shared", "score1": "nscore", "shared1": "nshared"})
    pairs = pairs.withColumn("score", F.round("score", 6)).withColumn("nscore", F.round("nscore", 6))
    # a token over its cap makes no pair, but scores those of either channel
    by_all, by_name = _kept("shared", "score", min_shared, RARE_SCORE) & F.col("made0"), _kept("nshared", "nscore", min_shared, RARE_SCORE) & F.col("made1")
    place = lambda kept, score: F.row_number().over(W.partitionBy("s1").orderBy(F.desc(F.when(kept, F.col(score))), "cand"))
    pairs = pairs.where(by_all | by_name).withColumn("at", F.when(by_all, place(by_all, "score"))).withColumn("nat", F.when(by_name, place(by_name, "nscore")))
    pairs = pairs.where((F.col("at") <= topk) | (F.col("nat") <= name_topk))
    order = W.partitionBy("s1").orderBy(F.desc("score"), F.desc("nscore"), "cand")
    pairs = pairs.withColumn("rank", F.row_number().over(order) - 1).withColumn("nrank", F.when(F.col("nat") <= name_topk, F.col("nat") - 1).otherwise(NO_RANK))
    return pairs.select("country", "s1", "cand", "score", "shared", "rank", "nscore", "nshared", "nrank")


def contention(pairs: DataFrame) -> DataFrame:
    """cand, t_best, t_second, t_claims: over the claims of all queries; a tie makes the second equal the best.

    The best and how often it occurs merge in part on the mappers; the second is the next claim below, found in one more
    aggregation, so no target's claims are collected or sorted in one place.
    """
    best = pairs.groupBy("cand").agg(F.max("score").alias("t_best"), F.count("*").alias("t_claims"))
    ranked = pairs.join(best, "cand").groupBy("cand", "t_best", "t_claims").agg(F.sum((F.col("score") == F.col("t_best")).cast("int")).alias("ties"), F.max(F.when(F.col("score") < F.col("t_best"), F.col("score"))).alias("next"))
    return ranked.select("cand", "t_best", F.when(F.col("ties") > 1, F.col("t_best")).otherwise(F.coalesce("next", F.lit(0.0))).alias("t_second"), "t_claims")


def stored_sample(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """Pairs of the entities in sample (s1); contention() must have seen all pairs before."""
    return pairs.join(sample.select("s1").distinct(), "s1", "left_semi")
