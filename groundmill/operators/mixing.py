"""The whole way from claims and a corpus to mixed contexts: retrieve, label, select, fill up, hydrate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmill.operators.contexts import backfill, choose_profile, claim_features, hydrate, label_of, parse_schedule, sample_pool, select_contexts, text_features
from groundmill.operators.ingest import claims_of
from groundmill.operators.retrieval import build_index, search
from groundmill.session import written

POOL_LEAST = 1_000


def claims_for_mixing(samples: DataFrame, id_col: str, question_col: str, claims_col: str, answers_col: str, max_rows: int | None = None) -> DataFrame:
    """qid, question, claim_id ``qid::cN``, claim_text: one row per claim of a sample, numbered from 0.

    The claims are the sample's own; failing these its answers; failing these its question. ``max_rows`` samples, the
    first by id, are taken if it is given.
    """
    taken = samples.where(F.col(id_col).isNotNull())
    if max_rows is not None:
        taken = taken.orderBy(id_col).limit(max_rows)
    picked = taken.select(F.col(id_col).cast("string").alias("qid"), F.col(question_col).alias("question"), claims_of(F.col(claims_col), F.col(answers_col), F.col(question_col)).alias("claims"))
    rows = picked.select("qid", "question", F.posexplode("claims").alias("n", "claim_text"))
    return rows.select("qid", "question", F.format_string("%s::c%d", "qid", "n").alias("claim_id"), "claim_text")


def mix_contexts(claims: DataFrame, corpus: DataFrame, k: int = 12, top: int = 50, seed: int = 42, schedule: str = "clean:0.34,mixed:0.33,toxic:0.33") -> DataFrame:
    """claim_id, position, doc_id, title, text, label, rank, mix_profile, drawn: k contexts for every claim.

    ``claims``: claim_id ``qid::cN``, claim_text; ``corpus``: doc_id, title, text, one row per id. The profile is drawn per
    qid. Texts join only the documents that were retrieved, and then those that were selected.

    The corpus and the labels are written once, so that what they are made from is not worked out again for each use.
    """
    corpus = written(corpus.select("doc_id", "title", "text"), "corpus")
    hits = search(build_index(corpus, "doc_id", "text"), claims, "claim_id", "claim_text", top).select(F.col("query_id").alias("claim_id"), "doc_id", "rank")
    hits = written(hits, "hits")
    profile = choose_profile(parse_schedule(schedule), seed, F.split("claim_id", "::")[0])
    texts = corpus.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", text_features(F.coalesce("text", F.lit(""))).alias("t"))
    asked = claims.select("claim_id", claim_features(F.col("claim_text")).alias("c"))
    labelled = hits.join(asked, "claim_id").join(texts, "doc_id").select("claim_id", "doc_id", "rank", label_of(F.col("c"), F.col("t")).alias("label"), profile.alias("mix_profile"))
    labelled = written(labelled, "labelled")
    selected = select_contexts(labelled, k, seed)
    size = max(5 * k, POOL_LEAST)
    pool = sample_pool(corpus.where("text is not null"), "doc_id", seed, size)
    filled = backfill(claims, hits, pool, pool.count(), k, seed).select("claim_id", "position", "doc_id", F.col("position").alias("rank"), F.lit("irrelevant").alias("label"), F.lit("backfill").alias("drawn"))
    rows = selected.unionByName(filled).withColumn("title", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string"))
    return hydrate(written(rows, "mixed"), corpus).select("claim_id", "position", "doc_id", "title", "text", "label", "rank", profile.alias("mix_profile"), "drawn")
