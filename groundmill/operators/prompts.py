"""Prompts from questions and contexts, answers out of completions, and pluggable models in between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmill.functions.text import filled, strip

MODES = {
    "base": "Answer from the context alone. If the context does not support an answer, say that you do not know.",
    "selective_refusal": "Answer from the context alone. For each claim that the context does not support, say: I don't know.",
}
MARK = "Answer:"


def flatten_contexts(contexts: Column) -> Column:
    """The contexts' texts, a blank line between; null contexts give an empty text, null elements nothing."""
    kept = F.filter(F.transform(contexts, lambda c: c["text"]), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(kept, "\n\n"), F.lit(""))


def prompt(question: Column, contexts: Column, mode: str) -> Column:
    """Instruction, question, contexts and the mark after which the answer is expected."""
    return F.concat(F.lit(f"{MODES[mode]}\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\n\nContext:\n"), flatten_contexts(contexts), F.lit(f"\n\n{MARK}"))


def after_mark(text: Column) -> Column:
    """What follows the first mark, stripped; the whole text where there is none."""
    at = F.locate(MARK, text)
    return strip(F.when(at > 0, F.substr(text, at + len(MARK))).otherwise(text))


def invalid_contexts(rows: DataFrame, contexts_col: str, k: int) -> DataFrame:
    """The rows whose contexts are not k, or of which one has no text."""
    blank = F.exists(F.col(contexts_col), lambda c: c.isNull() | filled(c["text"]).isNull())
    return rows.where(F.coalesce((F.size(contexts_col) != k) | blank, F.lit(True)))


def generate(rows: DataFrame, id_col: str, prompt_col: str, model: Callable[[], Callable[[list[str]], list[str]]], name: str, mode: str) -> DataFrame:
    """id, answer, model, mode. ``model`` is called once per task and gives a function from prompts to completions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = model()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "answer": complete(batch["prompt"].tolist())})

    answered = rows.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt")).mapInPandas(run, "id string, answer string")
    return answered.select("id", after_mark(F.col("answer")).alias("answer"), F.lit(name).alias("model"), F.lit(mode).alias("mode"))


def score(pairs: DataFrame, keys: list[str], claim_col: str, premise_col: str, model: Callable[[], Callable[[list[str], list[str]], list[tuple[float, float, float]]]]) -> DataFrame:
    """The keys and the model's logits e, c, n of each pair, for ``claims.softmax_label``; the order is the model's to keep."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields) + ", e double, c double, n double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = model()
        for batch in batches:
            logits = pd.DataFrame(judge(batch["__premise"].tolist(), batch["__claim"].tolist()), columns=["e", "c", "n"], index=batch.index)
            yield pd.concat([batch[keys], logits], axis=1)

    return pairs.select(*keys, F.col(claim_col).alias("__claim"), F.col(premise_col).alias("__premise")).mapInPandas(run, schema)
