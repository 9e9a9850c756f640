"""Answers into claims, claims against their contexts, and answers rebuilt from what is supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmill.functions.text import clauses, keywords, negated, numbers, sentences, tokens

UNKNOWN = "I don't know."
NLI_LABELS = ("support", "conflict", "irrelevant")


def last_wins(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """One row per key: the last in order, also where its columns are null. Rows of equal order are told apart by value."""
    rest = [c for c in df.columns if c not in keys]
    value = F.struct(*(F.col(f"`{c}`") for c in rest))
    picked = df.groupBy(*keys).agg(F.max_by(value, F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in rest)).alias("h"))).alias("__row"))
    return picked.select(*keys, "__row.*")


def answer_claims(answers: DataFrame, keys: list[str], text_col: str, least: int = 15) -> DataFrame:
    """The sentences of answers: keys, claim_id (from 0 within the answer, after the length filter), claim."""
    return answers.select(*keys, F.posexplode(sentences(F.col(text_col), least)).alias("claim_id", "claim"))


def clause_claims(samples: DataFrame, keys: list[str], answers: Column, least: int = 10) -> DataFrame:
    """The clauses of all answers of a sample (an array of texts), numbered through: keys, claim_id ``cN``, text."""
    parts = F.flatten(F.transform(answers, lambda a: clauses(a, least)))
    return samples.select(*keys, F.posexplode(parts).alias("n", "text")).select(*keys, F.format_string("c%d", "n").alias("claim_id"), "text")


def context_tokens(contexts: DataFrame, id_col: str, order_col: str, contexts_col: str) -> DataFrame:
    """id and premise: of each id's last row the distinct tokens, numbers and denial of its contexts; none if null.

    Reducing contexts to what scoring needs keeps their texts out of the join with the claims.
    """
    index = contexts.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max_by(contexts_col, order_col).alias("c")).where("c is not null")
    text = F.array_join(F.transform(F.filter("c", lambda x: x["text"].isNotNull()), lambda x: x["text"]), "\n\n")
    return index.select("id", text.alias("t")).select("id", F.array_distinct(tokens(F.col("t"))).alias("premise"), numbers(F.col("t")).alias("premise_numbers"), negated(F.col("t")).alias("premise_negated"))


def rule_scores(pairs: DataFrame) -> DataFrame:
    """Scores of support, conflict and irrelevance of each claim, and the label: a deterministic stand-in for a model.

    ``pairs``: claim, premise, premise_numbers, premise_negated and others. The share of the claim's keywords that the
    premise has speaks for support; numbers the premise has not, for conflict. Ties go to support, then conflict.
    """
    own = keywords(F.col("claim"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(own, F.col("premise"))), F.size(own)), F.lit(0.0))
    figures = numbers(F.col("claim"))
    strange = (F.size(figures) > 0) & (F.size(F.array_intersect(figures, F.col("premise_numbers"))) < F.size(figures))
    denied = negated(F.col("claim")) & ~F.col("premise_negated")
    keep = [c for c in pairs.columns if not c.startswith("premise")]
    logits = pairs.select(*keep, (share * 4.0 - 2.0).alias("e"), (F.when(strange | denied, share * 3.0).otherwise(F.lit(0.0)) - 1.0).alias("c"), (F.lit(1.0) - share * 2.0).alias("n"))
    return softmax_label(logits)


def softmax_label(logits: DataFrame) -> DataFrame:
    """label and the three scores from the logits e, c and n; ties go to e, then c."""
    total = F.exp("e") + F.exp("c") + F.exp("n")
    best = F.when((F.col("e") >= F.col("c")) & (F.col("e") >= F.col("n")), "support").when(F.col("c") >= F.col("n"), "conflict").otherwise("irrelevant")
    keep = [c for c in logits.columns if c not in ("e", "c", "n")]
    return logits.select(*keep, best.alias("label"), F.round(F.exp("e") / total, 6).alias("support"), F.round(F.exp("c") / total, 6).alias("conflict"), F.round(F.exp("n") / total, 6).alias("irrelevant"))


def answer_metrics(scores: DataFrame) -> DataFrame:
    """By id: number of claims, the share of each label, and whether any claim conflicts."""
    counted = scores.groupBy("id").agg(F.count("*").alias("total_claims"), *(F.count_if(F.col("label") == name).alias(name) for name in NLI_LABELS))
    return counted.select("id", "total_claims", *((F.col(name) / F.col("total_claims")).alias(f"{name}_frac") for name in NLI_LABELS), (F.col("conflict") > 0).alias("partial_hallucination"))


def grounded_answers(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """Each id's supported claims in order, joined by blanks; an admission where there are none.

    ``scores``: id, ord, claim_id, claim, label.
    """
    kept = scores.where("label = 'support'").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "claim_id", "claim"))), lambda c: c["claim"]), " ").alias("answer"))
    return ids.join(kept, "id", "left").select(*ids.columns, F.coalesce("answer", F.lit(UNKNOWN)).alias("answer"), F.lit("claim_level_grounded").alias("mode"))
