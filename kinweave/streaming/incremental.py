"""Incremental forms of batch operators as structured streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.staging import scratch_path


def contention(stream: DataFrame) -> DataFrame:
    """cand, t_best, t_claims of the claims so far; both merge in parts, so the state of a target is two numbers."""
    return stream.groupBy("cand").agg(F.max("score").alias("t_best"), F.count("*").alias("t_claims"))


def top_two(stream: DataFrame, schema: str = "cand long, t_best double, t_second double, t_claims long"):
    """cand, t_best, t_second, t_claims: the two best claims of each target, kept as state between batches."""
    import pandas as pd

    def update(key, batches, state):
        best, second, claims = state.get if state.exists else (0.0, 0.0, 0)
        for b in batches:
            scores = sorted([*b["score"].tolist(), *([best] if claims else []), *([second] if claims > 1 else [])], reverse=True)
            claims += len(b)
            best, second = scores[0], scores[1] if len(scores) > 1 else 0.0
        state.update((best, second, claims))
        yield pd.DataFrame([(*key, best, second, claims)], columns=["cand", "t_best", "t_second", "t_claims"])

    return stream.groupBy("cand").applyInPandasWithState(update, schema, "best double, second double, claims long", "update", "NoTimeout")


def candidates_of_stream(stream: DataFrame, postings: DataFrame) -> DataFrame:
    """Token matches of arriving records (s1, country, token, w) against a table of postings (country, token, cand)."""
    return stream.join(postings, ["country", "token"]).select("s1", "cand", "w")


def run_to_memory(stream: DataFrame, mode: str, name: str | None = None) -> DataFrame:
    """All that a stream has now, through a memory sink: for tests and small inputs, as the driver holds the result."""
    name = name or f"kinweave_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.sql(f"select * from {name}")


def run_to_table(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now; each batch is a table in the shared folder, written by the executors."""
    spark, last = stream.sparkSession, []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)


def candidates_into(stream: DataFrame, postings: DataFrame, weights: DataFrame, folder: str) -> DataFrame:
    """s1, cand, shared, score of arriving records (s1, country, toks) against a table of postings (country, token, cand).

    A stream-static join: each batch of records meets the postings of its tokens alone and leaves a part of the table.
    """
    spark = stream.sparkSession
    tokens = stream.select("s1", "country", F.explode("toks").alias("token")).join(weights.select("country", "token", "w"), ["country", "token"])

    def keep(batch: DataFrame, number: int) -> None:
        rows = candidates_of_stream(batch, postings).groupBy("s1", "cand").agg(F.count("*").alias("shared"), F.round(F.sum("w"), 6).alias("score"))
        rows.write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    q = tokens.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("s1 long, cand long, shared long, score double").parquet(f"{folder}/parts/*")


def contention_of_stream(pairs: DataFrame) -> DataFrame:
    """contention() of a candidate table that is read as a stream of its files."""
    spark, folder = pairs.sparkSession, scratch_path(pairs.sparkSession, "stream")
    pairs.select("s1", "cand", "score").write.parquet(f"{folder}/pairs")
    stream = spark.readStream.schema("s1 long, cand long, score double").option("maxFilesPerTrigger", 64).parquet(f"{folder}/pairs")
    return run_to_table(contention(stream), f"{folder}/out")
