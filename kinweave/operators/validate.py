"""Checks of result lists: one row for each rule that is broken, with how often and the first examples in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


def _rule(rows: DataFrame, name: str, level: str, example) -> DataFrame:
    """The least EXAMPLES distinct examples; each task keeps no more, so a rule that all rows break stays small."""
    return rows.select(F.lit(name).alias("rule"), F.lit(level).alias("level"), example.cast("string").alias("example"))


def findings(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """rule, level, offenders, examples. lists: an id and a comma list a row; required, known: entity_id; candidates: lists.

    malformed_row: no id or a null list. duplicate_s1: an id in more rows than one. duplicate_id: an id twice in a list.
    self_match: a list with ids of source 1. wrong_prefix: neither S2- nor S3-. unknown_id: not in known. missing_s1,
    extra_s1: against required. not_in_candidates (a warning): a match that the candidate lists lack.
    """
    rows = lists.select(F.col(id_col).alias("id"), F.col(list_col).alias("ids"))
    good = rows.where("id is not null and ids is not null")
    items = good.select("id", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("item"))
    need, have = required.select(F.col("entity_id").alias("id")).distinct(), good.select("id").distinct()
    twice = items.groupBy("id", "item").agg(F.count("*").alias("n")).where("n > 1")
    found = [
        _rule(rows.where("id is null or ids is null"), "malformed_row", "error", F.coalesce("id", F.lit(""))),
        _rule(good.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_s1", "error", F.col("id")),
        _rule(twice, "duplicate_id", "error", F.concat_ws(":", "id", "item")),
        _rule(items.where("item like 'S1-%'"), "self_match", "error", F.concat_ws(":", "id", "item")),
        _rule(items.where("not item rlike '^S[123]-'"), "wrong_prefix", "error", F.concat_ws(":", "id", "item")),
        _rule(need.join(have, "id", "left_anti"), "missing_s1", "error", F.col("id")),
        _rule(have.join(need, "id", "left_anti"), "extra_s1", "error", F.col("id")),
    ]
    if known is not None:
        found.append(_rule(items.join(known.select(F.col("entity_id").alias("item")).distinct(), "item", "left_anti"), "unknown_id", "error", F.concat_ws(":", "id", "item")))
    if candidates is not None:
        c = candidates.select(F.col(candidates.columns[0]).alias("id"), F.explode(F.split(F.col(candidates.columns[1]), ",")).alias("item")).distinct()
        found.append(_rule(items.distinct().join(c, ["id", "item"], "left_anti"), "not_in_candidates", "warning", F.concat_ws(":", "id", "item")))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    counts = all_.groupBy("rule", "level").agg(F.count("*").alias("offenders"))
    from pyspark.sql import Window as W

    first = all_.distinct().withColumn("r", F.row_number().over(W.partitionBy("rule").orderBy("example"))).where(F.col("r") <= EXAMPLES)
    lists_ = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("example")), " ").alias("examples"))
    return counts.join(lists_, "rule")


def header_findings(header: str | None, expected: tuple[str, str]) -> list[str]:
    """Rules that a file's first line breaks: missing or empty file, commas in place of tabs, another header."""
    if header is None:
        return ["missing_file"]
    if not header.strip():
        return ["empty_file"]
    if "\t" not in header and "," in header:
        return ["comma_separated"]
    return [] if tuple(header.rstrip("\r\n").split("\t")) == expected else ["wrong_header"]
