"""Sliding windows of tokens over texts, and the corpora built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmill.functions.text import WS, collapse, filled, key_of, pieces


def window_count(n: Column, size: int, step: int) -> Column:
    """How many windows cover n tokens: the last is the first to reach the end."""
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")


def token_windows(df: DataFrame, text_col: str, size: int, overlap: int) -> DataFrame:
    """The columns but the text, ``chunk_index``, ``chunk`` (tokens joined by blanks) and ``n_tokens``.

    Null and token-less texts give no rows. One row in, its windows out: no shuffle.
    """
    step = size - overlap
    if size < 1 or overlap < 0 or step < 1:
        raise ValueError("the size must be positive, the overlap from 0 and below the size")
    rest = [c for c in df.columns if c != text_col]
    cut = df.where(F.col(text_col).rlike(f"[^{WS}]")).select(*rest, pieces(F.col(text_col)).alias("__tokens"))

    def window(i: Column) -> Column:
        part = F.slice("__tokens", i * step + 1, F.lit(size))
        return F.struct(i.alias("chunk_index"), F.array_join(part, " ").alias("chunk"), F.size(part).alias("n_tokens"))

    # Windows are made before they are exploded: a row that is exploded first would carry all its tokens into each window.
    windows = F.transform(F.sequence(F.lit(0), window_count(F.size("__tokens"), size, step) - 1), window)
    return cut.select(*rest, F.explode(windows).alias("__w")).select(*rest, "__w.*")


def passages_of(docs: DataFrame, dataset_col: str, doc_col: str, text_col: str, size: int = 384, overlap: int = 64) -> DataFrame:
    """Corpus passages: passage_id ``dataset::doc::chunkN``, doc_id, text."""
    windows = token_windows(docs.select(F.col(dataset_col).alias("dataset"), F.col(doc_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")), "text", size, overlap)
    return windows.select(F.format_string("%s::%s::chunk%d", "dataset", "doc_id", "chunk_index").alias("passage_id"), "doc_id", F.col("chunk").alias("text"), "n_tokens")


def corpus_of(examples: DataFrame, id_col: str, docs_col: str, fallback_cols: list[str], dataset: Column, size: int = 384, overlap: int = 64) -> DataFrame:
    """Passages of the examples' documents; an example without any gives one of its first filled column.

    A document without an id has its position in the list as id; the fallback's id is that of its example.
    """
    text = lambda d: filled(d["text"])
    docs = examples.select(id_col, dataset.alias("dataset"), F.posexplode(docs_col).alias("pos", "d")).where(text(F.col("d")).isNotNull())
    docs = docs.select(id_col, "dataset", F.coalesce(filled(F.col("d.doc_id")), F.col("pos").cast("string")).alias("doc_id"), F.col("d.text").alias("text"))
    has = F.coalesce(F.exists(F.col(docs_col), lambda d: text(d).isNotNull()), F.lit(False))
    instead = examples.where(~has).select(id_col, dataset.alias("dataset"), F.col(id_col).cast("string").alias("doc_id"), F.coalesce(*(filled(F.col(c)) for c in fallback_cols)).alias("text"))
    passages = token_windows(docs.unionByName(instead), "text", size, overlap)
    return passages.select(id_col, F.format_string("%s::%s::chunk%d", "dataset", "doc_id", "chunk_index").alias("passage_id"), "doc_id", F.col("chunk").alias("text"), "n_tokens")


def external_passages(articles: DataFrame, id_col: str, title_col: str, text_col: str, source_col: str, size: int = 180, overlap: int = 30, least_chars: int = 300) -> DataFrame:
    """Passages of articles of at least ``least_chars`` characters; the article's key may be a hash."""
    keyed = articles.where(F.length(text_col) >= least_chars).select(key_of(F.col(id_col).cast("string"), F.col(title_col), F.col(text_col)).alias("key"), F.col(source_col).alias("source"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    windows = token_windows(keyed, "text", size, overlap)
    return windows.select(F.format_string("%s:%d", "key", "chunk_index").alias("doc_id"), "source", "title", F.col("chunk").alias("text"), F.col("key").alias("article_id"), "chunk_index")


def leads(articles: DataFrame, id_col: str, title_col: str, text_col: str, source_col: str, least_chars: int = 200) -> DataFrame:
    """Articles with collapsed text of at least ``least_chars`` characters; id falls back on the title."""
    out = articles.select(F.coalesce(filled(F.col(id_col).cast("string")), filled(F.col(title_col))).alias("doc_id"), F.coalesce(collapse(F.col(title_col)), F.lit("")).alias("title"), collapse(F.col(text_col)).alias("text"), F.coalesce(filled(F.col(source_col)), F.lit("wiki")).alias("source"))
    return out.where(F.length("text") >= least_chars)


def validated(passages: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "source")) -> tuple[DataFrame, DataFrame]:
    """Rows whose named columns are all filled, and the others."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(filled(F.col(c).cast("string")).isNotNull(), F.lit(False))
    return passages.where(ok), passages.where(~ok)
