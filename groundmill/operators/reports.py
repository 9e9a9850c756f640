"""Distributions, averages, deltas, classification metrics and apportionment."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundmill.operators.claims import NLI_LABELS, answer_metrics
from groundmill.session import written

CLASSES = ("support", "decoy", "conflict")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or there are no rows."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _phase_row(phase: str, per_id: DataFrame) -> DataFrame:
    n = F.col("total_claims")
    sums = [F.coalesce(F.sum(F.round(F.col(f"{x}_frac") * n)), F.lit(0)).cast("bigint").alias(f"{x}_claims") for x in NLI_LABELS]
    means = [F.round(F.coalesce(F.avg(f"{x}_frac"), F.lit(0.0)), 6).alias(f"{x}_macro") for x in NLI_LABELS]
    return per_id.agg(F.lit(phase).alias("phase"), F.count("*").alias("ids"), *sums, *means, F.count_if("partial_hallucination").alias("with_conflict"))


def phase_rows(scores: Mapping[str, DataFrame]) -> DataFrame:
    """One row per phase: ids, claims by label, macro averages of the shares over ids, and ids with a conflict."""
    return reduce(DataFrame.unionByName, [_phase_row(phase, answer_metrics(rows)) for phase, rows in scores.items()])


def shared_phase_rows(scores: Mapping[str, DataFrame]) -> DataFrame:
    """As :func:`phase_rows`, over the ids that all phases have."""
    metrics = {phase: written(answer_metrics(rows), "metrics") for phase, rows in scores.items()}
    shared = written(shared_ids(list(metrics.values())), "shared")
    return reduce(DataFrame.unionByName, [_phase_row(phase, rows.join(shared, "id", "left_semi")) for phase, rows in metrics.items()])


def report_row(every: DataFrame, shared: DataFrame, tag: str) -> DataFrame:
    """One row: the tag, a struct per phase with its ids, claims by label, averages and ids with a conflict, and how many
    ids all phases share."""
    both = every.withColumn("shared", F.lit(False)).unionByName(shared.withColumn("shared", F.lit(True)))
    entry = F.struct("phase", F.struct(*(c for c in every.columns if c != "phase")))
    return both.agg(F.lit(tag).alias("tag"), F.map_from_entries(F.collect_list(F.when(~F.col("shared"), entry))).alias("phases"), F.max(F.when(F.col("shared"), F.col("ids"))).alias("shared_ids"))


def shared_ids(tables: list[DataFrame]) -> DataFrame:
    """The ids that all tables have."""
    return reduce(DataFrame.intersect, [t.select("id").distinct() for t in tables])


def metric_deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """For ids in both: the change of each share and of the number of claims."""
    a = base.select("id", *(F.col(c).alias(f"base_{c}") for c in base.columns if c != "id"))
    joined = a.join(other, "id")
    return joined.select("id", *(F.round(F.col(f"{x}_frac") - F.col(f"base_{x}_frac"), 6).alias(f"delta_{x}") for x in NLI_LABELS), (F.col("total_claims") - F.col("base_total_claims")).alias("delta_total_claims"))


def classification_metrics(records: DataFrame, label_col: str = "label", predicted_col: str = "prediction") -> DataFrame:
    """csp, ucr, fcr, scc, frr, cdr of labelled predictions; a label outside the classes is an error, no rows are all 0."""
    checked = records.select(*(F.when(F.col(c).isin(*CLASSES), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(c), F.lit("null"))))).alias(n) for c, n in ((label_col, "l"), (predicted_col, "p"))))
    count = {f"{a}_{b}": F.count_if((F.col("l") == a) & (F.col("p") == b)) for a in CLASSES for b in CLASSES}
    total = F.count("*")
    of = {a: F.count_if(F.col("l") == a) for a in CLASSES}
    says = {a: F.count_if(F.col("p") == a) for a in CLASSES}
    return checked.agg(
        total.alias("n"),
        F.round(ratio(count["support_support"], of["support"]), 6).alias("csp"),
        F.round(ratio(count["decoy_decoy"], of["decoy"]), 6).alias("ucr"),
        F.round(ratio(count["conflict_conflict"], of["conflict"]), 6).alias("fcr"),
        F.round(ratio(says["support"], total), 6).alias("scc"),
        F.round(ratio(of["support"] - count["support_support"], of["support"]), 6).alias("frr"),
        F.round(ratio(says["conflict"], total), 6).alias("cdr"),
    )


def apportion(totals: DataFrame, key: str, total_col: str, ratios: Mapping[str, float]) -> DataFrame:
    """Each key's total shared out by largest remainder: key, label, n. Equal remainders go by label, last first."""
    if missing := [name for name in CLASSES if name not in ratios]:
        raise ValueError(f"missing ratio: {missing[0]}")
    whole = sum(ratios[name] for name in CLASSES)
    if whole <= 0:
        raise ValueError("the ratios must add up to more than 0")
    shares = F.explode(F.array(*(F.struct(F.lit(name).alias("label"), F.lit(ratios[name] / whole).alias("share")) for name in CLASSES))).alias("s")
    rows = totals.select(key, F.col(total_col).alias("total"), shares).select(key, "total", "s.label", (F.col("total") * F.col("s.share")).alias("exact"))
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.col("exact") - F.floor("exact"), 9)), F.desc("label"))
    rows = rows.withColumn("turn", F.row_number().over(order)).withColumn("left", F.col("total") - F.sum(F.floor("exact")).over(Window.partitionBy(key)))
    return rows.select(key, "label", (F.floor("exact") + (F.col("turn") <= F.col("left")).cast("int")).cast("bigint").alias("n"))
