"""Evaluation: macro F0.5 and its sweeps, recall, error taxonomy, cohorts, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.operators.decide import GRID, LAMBDAS, best_claims, decode_grid


def entity_counts(entities: DataFrame, links: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """s1, predicted, actual, hits for every entity; links and truth: s1, cand."""
    keys = [*(by or []), "s1"]
    right = truth.join(entities.select("s1").distinct(), "s1", "left_semi").select("s1", "cand")
    hits = links.join(right.withColumn("hit", F.lit(1)), ["s1", "cand"], "left").groupBy(*keys).agg(F.count("*").alias("predicted"), F.count("hit").alias("hits"))
    base = entities.select(*keys).distinct()
    out = base.join(hits, keys, "left").join(right.groupBy("s1").agg(F.count("*").alias("actual")), "s1", "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("predicted", "actual", "hits")])


def f05(counts: DataFrame) -> DataFrame:
    """counts with f05: 1 if nothing is predicted nor true, 0 without a hit."""
    p, r = F.col("hits") / F.greatest("predicted", F.lit(1)), F.col("hits") / F.greatest("actual", F.lit(1))
    score = F.when((F.col("predicted") == 0) & (F.col("actual") == 0), 1.0).when(F.col("hits") == 0, 0.0).otherwise(1.25 * p * r / F.when(F.col("hits") > 0, 0.25 * p + r).otherwise(1.0))
    return counts.withColumn("f05", score)


def macro_f05(entities: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: entities, macro_f05 over the given entities (0 without any)."""
    return f05(entity_counts(entities, links, truth)).agg(F.count("*").alias("entities"), F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"))


def sweep(pairs: DataFrame, entities: DataFrame, truth: DataFrame, grid=GRID, by: str | None = None) -> DataFrame:
    """(by,) threshold, macro_f05 for every threshold of the grid, in one job. by: a column of entities, as country.

    A pair enters once for each threshold up to its p; entities without links score through their counts of true links.
    """
    group = [by] if by else []
    steps = F.array(*[F.lit(float(t)) for t in sorted(set(grid))])
    kept = pairs.join(entities.select("s1").distinct(), "s1", "left_semi").select("s1", "cand", "p", F.explode(F.filter(steps, lambda t: t <= F.col("p"))).alias("threshold"))
    kept = best_claims(kept.join(entities.select("s1", *group), "s1") if by else kept, [*group, "threshold"]).select("s1", "cand", "threshold")
    all_ = entities.select("s1", *group).distinct().withColumn("threshold", F.explode(steps))
    scored = f05(entity_counts(all_, kept, truth, ["threshold"]))
    if by:
        scored = scored.join(entities.select("s1", by).distinct(), "s1")
    return scored.groupBy(*group, "threshold").agg(F.avg("f05").alias("macro_f05"))


def best_threshold(swept: DataFrame, by: str | None = None) -> DataFrame:
    """(by,) threshold, macro_f05: the first of the best; values are compared to nine places."""
    pick = F.max_by(F.struct("threshold", "macro_f05"), F.struct(F.round("macro_f05", 9), -F.col("threshold"))).alias("b")
    return (swept.groupBy(by) if by else swept.groupBy()).agg(pick).select(*([by] if by else []), "b.*")


def rate_sweep(pairs: DataFrame, entities: DataFrame, truth: DataFrame, grid=LAMBDAS) -> DataFrame:
    """country, rate, macro_f05: expected-F0.5 decoding at every rate of unseen links, in one job.

    A list is decoded for all rates at once; targets are claimed anew at each rate.
    """
    own = entities.select("s1", "country").distinct()
    links = decode_grid(pairs.join(own.select("s1"), "s1", "left_semi"), grid).select("s1", "cand", "rate")
    all_ = own.withColumn("rate", F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    scored = f05(entity_counts(all_, links, truth, ["rate"])).join(own, "s1")
    return scored.groupBy("country", "rate").agg(F.avg("f05").alias("macro_f05"))


def best_rate(swept: DataFrame) -> DataFrame:
    """country, rate, macro_f05: the least of the best rates; values are compared to nine places."""
    pick = F.max_by(F.struct("rate", "macro_f05"), F.struct(F.round("macro_f05", 9), -F.col("rate"))).alias("b")
    return swept.groupBy("country").agg(pick).select("country", "b.*")


def prefilter_threshold(pairs: DataFrame, keep: float = 0.999) -> DataFrame:
    """One row: the quantile of p1 over accepted true pairs that keeps the share `keep` of them; 0 without any."""
    return pairs.where("accepted").agg(F.coalesce(F.percentile("p1", F.lit(1 - keep)), F.lit(0.0)).alias("threshold"))


def recall_at(pairs: DataFrame, truth: DataFrame, ks=(1, 5, 10, 20, 50)) -> DataFrame:
    """k, hits, links, recall, pairs: true links among the first k of each entity's list."""
    links = truth.join(pairs.select("s1", "cand", "rank"), ["s1", "cand"], "left")
    sums = links.agg(F.count("*").alias("links"), *[F.count(F.when(F.col("rank") < k, 1)).alias(f"h{k}") for k in ks])
    sizes = pairs.agg(*[F.count(F.when(F.col("rank") < k, 1)).alias(f"n{k}") for k in ks])
    both = sums.crossJoin(sizes)  # one row beside one row
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col("links"), F.col(f"n{k}").alias("pairs")) for k in ks]))
    return both.select(rows.alias("r")).select("r.*").withColumn("recall", F.col("hits") / F.greatest("links", F.lit(1)))


def channel_recall(pairs: DataFrame, truth: DataFrame, no_rank: int = 999) -> DataFrame:
    """One row: true links, those that the name channel found, those that either found, missed ones."""
    links = truth.join(pairs.select("s1", "cand", "nrank"), ["s1", "cand"], "left")
    return links.agg(F.count("*").alias("links"), F.count(F.when(F.col("nrank") < no_rank, 1)).alias("by_name"), F.count("nrank").alias("by_either"), F.count(F.when(F.col("nrank").isNull(), 1)).alias("missed"))


def missed_links(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.join(pairs.select("s1", "cand"), ["s1", "cand"], "left_anti")


def taxonomy(counts: DataFrame) -> DataFrame:
    """outcome, entities, of entity_counts(): perfect, false links, missed links, both, and links of true singletons."""
    false, miss = F.col("predicted") - F.col("hits"), F.col("actual") - F.col("hits")
    kind = F.when((false == 0) & (miss == 0), "perfect").when((false > 0) & (miss > 0), "both").when(miss > 0, "missed_only").when(F.col("actual") == 0, "false_only_singleton").otherwise("false_only")
    return counts.groupBy(kind.alias("outcome")).agg(F.count("*").alias("entities"), F.sum(false).alias("false_links"), F.sum(miss).alias("missed_links"))


def cohorts(counts: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Metrics of overlapping cohorts of entities, each named by a condition on the columns of counts."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return f05(counts).withColumn("cohort", F.explode(names)).groupBy("cohort").agg(
        F.count("*").alias("entities"), F.avg("f05").alias("macro_f05"), F.sum(F.col("predicted") - F.col("hits")).alias("false_links"), F.sum(F.col("actual") - F.col("hits")).alias("missed_links"),
        F.sum(((F.col("actual") == 0) & (F.col("predicted") > 0)).cast("int")).alias("false_singleton_merges"),
    )


def oracle_links(labelled: DataFrame) -> DataFrame:
    """What a perfect classifier would link: the true candidates."""
    return labelled.where("y = 1").select("s1", "cand")


def recall_ceiling(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    kept = labelled.where("y = 1").agg(F.count("*").alias("kept"))
    return kept.crossJoin(truth.agg(F.count("*").alias("links"))).withColumn("ceiling", F.col("kept") / F.greatest("links", F.lit(1)))


def bootstrap(deltas: DataFrame, id_col: str = "s1", resamples: int = 1000, seed: int = 0) -> DataFrame:
    """mean, low, high of the mean of `delta` by a Poisson bootstrap: weights come from hashes, so results repeat.

    Each entity gives its weighted sums to every resample within its task; only sums of resamples are shuffled.
    """
    u = lambda r: (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), r), F.lit(1 << 32)) + 0.5) / float(1 << 32)
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    draws = deltas.select(id_col, "delta", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    weight = sum(((u(F.col("r")) >= c).cast("int") for c in cuts), F.lit(0))
    means = draws.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col("delta")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return deltas.agg(F.avg("delta").alias("mean")).crossJoin(ends).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def em_prior(pairs: DataFrame, train_prior: float, rounds: int = 20) -> float:
    """The share of true pairs in unlabelled data, by Saerens' rule: posteriors shift with the prior until it stands.

    One aggregation a round; the posteriors themselves stay where they are.
    """
    prior = train_prior
    for _ in range(rounds):
        up, down = F.col("p") * (prior / train_prior), (1 - F.col("p")) * ((1 - prior) / (1 - train_prior))
        new = pairs.agg(F.avg(up / (up + down))).first()[0]
        if new is None or abs(new - prior) < 1e-9:
            break
        prior = min(max(new, 1e-9), 1 - 1e-9)
    return prior
