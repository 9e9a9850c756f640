"""Scans and sinks of JSON lines, and run identities. Rows are kept as VARIANT, as their schema differs from row to row."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from groundmill.functions.picks import text_at, truthy
from groundmill.functions.text import filled, strip


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank. A line ends at a line feed or carriage return, as in Spark's text source."""
    return spark.read.text(path).where(strip(F.col("value")) != "")


def scan_strict(spark: SparkSession, path: str) -> DataFrame:
    """v of every line; a line that is no JSON is an error when it is read."""
    return _lines(spark, path).select(F.parse_json("value").alias("v"))


def scan_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """v of the lines that are JSON objects; others are passed over."""
    return _lines(spark, path).select(F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def scan_objects(spark: SparkSession, path: str) -> DataFrame:
    """v of the lines that are objects; a line that is no JSON is an error."""
    return scan_strict(spark, path).where(F.schema_of_variant("v").startswith("OBJECT"))


def scan_counted(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """doc_id, title, text of the lines with an id and text; after an action the observation has ``kept`` and ``skipped``."""
    seen = Observation()
    rows = _lines(spark, path).select(F.try_parse_json("value").alias("v")).select(filled(text_at(F.col("v"), "doc_id")).alias("doc_id"), F.coalesce(text_at(F.col("v"), "title"), F.lit("")).alias("title"), text_at(F.col("v"), "text").alias("text"))
    ok = F.coalesce(F.col("doc_id").isNotNull() & filled(F.col("text")).isNotNull(), F.lit(False))
    return rows.observe(seen, F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped")).where(ok), seen


def _numbered(lines: DataFrame) -> DataFrame:
    """``line``: the place of each row in the order in which it is read, from 0. Only a count per partition is collected."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = lines.withColumns({"__part": F.spark_partition_id(), "__at": within})
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg((F.max("__at") + 1).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = lines.sparkSession.createDataFrame(starts, "__part int, __start bigint")
    return placed.join(F.broadcast(offsets), "__part").withColumn("line", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title and text of a corpus file; the id under any of its usual keys, else the number of its line."""
    rows = _numbered(_lines(spark, path)).select("line", F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    identity = F.coalesce(truthy(F.col("v"), ["doc_id", "passage_id", "id"]), F.col("line").cast("string"))
    return rows.select(identity.alias("doc_id"), text_at(F.col("v"), "title").alias("title"), text_at(F.col("v"), "text").alias("text")).where(filled(F.col("text")).isNotNull())


def write_jsonl(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One JSON object a line, null fields kept; without ``overwrite`` an existing path is an error."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def run_id(config: Mapping[str, object], inputs: Sequence[str]) -> str:
    """The same for the same configuration and inputs."""
    return hashlib.sha256(json.dumps({"config": config, "inputs": list(inputs)}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def output_path(folder: str, stem: str, run: str, ext: str = ".json") -> str:
    return os.path.join(folder, f"{stem}_{run}{ext}")
