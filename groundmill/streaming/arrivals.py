"""Records as they arrive: the same operators on a stream as on a table.

Everything stateless (``ingest.examples_of``, ``chunking.token_windows``, ``inlining.shred_json`` with a given plan) works
on a stream as it is. What keeps state is here: deliveries of the same record are dropped within a delay, and records are
counted by day with late ones told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmill.operators.ingest import examples_of

LATE = "1 day"


def delivered_once(raw: DataFrame, payload_col: str, time_col: str, delay: str) -> DataFrame:
    """Without records whose payload was delivered before: at all, or on a stream within ``delay``."""
    keyed = raw.withColumn("__key", F.xxhash64(F.coalesce(F.col(payload_col), F.lit(""))))
    if raw.isStreaming:
        return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    return keyed.dropDuplicates(["__key"]).drop("__key")


def arrivals_by_day(raw: DataFrame, group_col: str, created_col: str, fetched_col: str, delay: str = "60 days") -> DataFrame:
    """day, group, records, late (fetched more than a day after it was made). On a stream a day is final after ``delay``."""
    source = raw.withWatermark(created_col, delay) if raw.isStreaming else raw
    late = F.col(fetched_col) > F.col(created_col) + F.expr(f"INTERVAL {LATE}")
    days = source.groupBy(F.window(created_col, "1 day").alias("w"), F.coalesce(F.col(group_col), F.lit("none")).alias(group_col))
    return days.agg(F.count("*").alias("records"), F.count_if(late).alias("late")).select(F.to_date("w.start").alias("day"), group_col, "records", "late")


def unified(raw: DataFrame, id_col: str, dataset_col: str, split_col: str, payload_col: str, time_col: str, delay: str = "30 days") -> DataFrame:
    """Unified examples of a table or stream of raw records, each delivery once; records of other datasets are left out."""
    return examples_of(delivered_once(raw, payload_col, time_col, delay), id_col, dataset_col, split_col, payload_col, unknown="skip")
