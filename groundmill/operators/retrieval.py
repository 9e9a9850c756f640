"""BM25: an inverted index as tables, and top-n retrieval for a batch of queries.

Scale: a query that has a common term meets most documents, so the pairs of queries and documents are far more than
either. They are scored where the postings of a block of documents lie and never moved: a block gives out each query's
best few, and only these are merged.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from groundmill.functions.text import tokens

K1, B = 0.9, 0.4


#: Tokens of the documents, and distinct terms of the queries, that meet in one task at once.
BLOCK = 500_000
ASKED = 200_000


class Index(NamedTuple):
    """postings: doc_id, term, tf, length. terms: term, df, cf. stats: one row of docs, avg_length, corpus (a hash)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tokens(F.col(text_col)).alias("tokens")).where("size(tokens) > 0")


def _corpus_hash() -> Column:
    """The same for the same ids and texts in any order."""
    return F.coalesce(F.sum(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))), F.lit(0)).alias("corpus")


def build_index(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """Documents without tokens are no part of it. One row per id is expected.

    Texts are dealt by id, so that a document's tokens are counted where they are: texts are smaller than postings.
    """
    counted = _counted(docs, id_col, text_col)
    dealt = _counted(docs.select(id_col, text_col).repartition(id_col), id_col, text_col)
    postings = dealt.select("doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = counted.agg(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("avg_length"), _corpus_hash())
    return Index(postings, terms, stats)


def save_index(index: Index, path: str) -> None:
    """Three tables; postings lie by term, so that a query's terms are found by their files' statistics."""
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in Index._fields))


def ensure_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> Index:
    """The saved index if it is of these very ids and texts, else a new one, saved."""
    now = docs.where(F.col(text_col).rlike("(?i)[a-z0-9]")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).agg(_corpus_hash()).first()
    try:
        saved = load_index(docs.sparkSession, path)
        if saved.stats.first().corpus == now.corpus:
            return saved
    except (AnalysisException, AttributeError):
        pass
    save_index(build_index(docs, id_col, text_col), path)
    return load_index(docs.sparkSession, path)


def search(index: Index, queries: DataFrame, query_id: str, query_text: str, top: int = 50, k1: float = K1, b: float = B, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """query_id, doc_id, score, rank for each query's best ``top`` documents; ties by id.

    Documents are dealt over parts of about ``block`` tokens, queries over slices of about ``asked`` terms; every part
    meets every slice in one task. Scores are rounded before ranking, as the order of a distributed sum is not fixed.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    stats = index.stats.first()
    n, average = stats.docs, stats.avg_length or 1.0
    parts, slices = max(1, math.ceil(n * average / block)), max(1, math.ceil(wanted.count() / asked))
    idf = F.ln((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    sides = wanted.join(index.terms.select("term", "df"), "term").select("query_id", "term", idf.alias("idf"), F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice"))
    sides = sides.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    share = F.col("tf") * (k1 + 1.0) / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("length") / F.lit(float(average))))
    used = index.postings.select("term", "doc_id", share.alias("share"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    used = used.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    schema = StructType([sides.schema["query_id"], used.schema["doc_id"], StructField("score", DoubleType())])

    def best(postings: pa.Table, asking: pa.Table) -> pa.Table:
        return _best(postings, asking, top)

    scored = used.groupBy("part", "slice").cogroup(sides.groupBy("part", "slice")).applyInArrow(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")


def _best(postings: pa.Table, asking: pa.Table, top: int) -> pa.Table:
    """query_id, doc_id, score of each query's best ``top`` of these documents, ties by id; scores have six decimals.

    ``postings``: term, doc_id, share; ``asking``: query_id, term, idf. Both may be empty.
    """
    terms, ids, askers = pc.unique(asking["term"]), pc.unique(postings["doc_id"]), pc.unique(asking["query_id"])
    # By id, nulls first, as Spark orders them: a document's number tells its place among ties.
    ids = ids.take(pc.array_sort_indices(ids, null_placement="at_start"))
    term = pc.fill_null(pc.index_in(postings["term"], terms), -1).to_numpy()
    by_term = np.argsort(term, kind="stable")[np.count_nonzero(term < 0) :]
    doc, share = pc.index_in(postings["doc_id"], ids).to_numpy()[by_term], postings["share"].to_numpy()[by_term]
    term = term[by_term]
    ends = np.cumsum(np.bincount(term, minlength=len(terms)))
    starts = np.concatenate(([0], ends[:-1])) if len(terms) else ends
    query, wanted, idf = (x.to_numpy() for x in (pc.index_in(asking["query_id"], askers), pc.index_in(asking["term"], terms), asking["idf"]))
    by_query = np.lexsort((wanted, query))
    bounds = np.searchsorted(query[by_query], np.arange(len(askers) + 1))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for q in range(len(askers)):
        rows = by_query[bounds[q] : bounds[q + 1]]
        spans = [(slice(starts[t], ends[t]), w) for t, w in zip(wanted[rows], idf[rows]) if starts[t] < ends[t]]
        if not spans:
            continue
        met = np.concatenate([doc[s] for s, _ in spans])
        # Weights are above zero, so a score of zero is a document without any of the terms.
        sums = np.bincount(met, np.concatenate([share[s] * w for s, w in spans]), len(ids))
        docs = np.flatnonzero(sums)
        scores = np.floor(sums[docs] * 1e6 + 0.5)
        if len(docs) > top:
            least = np.partition(scores, len(docs) - top)[len(docs) - top]
            above = np.flatnonzero(scores > least)
            kept = np.concatenate((above, np.flatnonzero(scores == least)[: top - len(above)]))
            docs, scores = docs[kept], scores[kept]
        found.append((q, docs, scores / 1e6))
    of = np.repeat([q for q, _, _ in found], [len(d) for _, d, _ in found]).astype(np.int64)
    docs = np.concatenate([np.empty(0, np.int64), *(d for _, d, _ in found)])
    return pa.table({"query_id": askers.take(pa.array(of)), "doc_id": ids.take(pa.array(docs)), "score": pa.array(np.concatenate([np.empty(0), *(x for _, _, x in found)]))})
