"""Problem 5: texts into training contexts of a fixed capacity, by conflict-constrained best fit.

Items are taken from the largest to the smallest (those of a cluster or source that has most of a context count come
before). Bins are kept by what they have left; the search for an item starts at the bins with the least room that is
enough and goes on to the next larger until one is compatible: without the item's duplicate cluster, and without its
source. If none is, a new bin is opened. So no two texts of one cluster or of one source ever share a context; where one
of these has more texts than the items would fill contexts, each of them has a context of its own, and the room that is
left is the constraint's. The bitmaps are kept by source and by cluster, one bit for each bin that holds it, so that all
bins of a residual are tested at once.

A text larger than the capacity is cut into full contexts; what is left over is an item like any other.

Scale: the texts stay where they are read; sizes are shuffled once, dealt by a hash over groups of about
``group_items`` rows, so no key of the data decides how large a group is. Each group packs for itself and leaves at most
a few open bins. A source or cluster in a third of the rows is a third of each group. Items are numbered by a hash of
their row and its place among equal rows, so that neither files nor cores decide what shares a context.

Defined results: null and token-less texts have size 0 and no context; null sources and clusters conflict with nothing;
repeated rows are items of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.llm.near import near_groups, near_links
from groundmill.llm.tokens import RANKS, tokenizer
from groundmill.session import spread, table, written

GROUP_ITEMS = 10_000


class Bins:
    """Open bins by their residual, and for each source and cluster a bitmap of the bins that hold it."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = 0
        self.open = 0  # bit r is set if a bin has r left
        self.with_residual: dict[int, int] = {}  # bit b is set if bin b has that much left
        self.with_cluster: dict[Hashable, int] = {}
        self.with_source: dict[Hashable, int] = {}

    def _tightest(self, size: int, blocked: int) -> tuple[int, int] | None:
        """The compatible bin with the least residual of at least ``size``, the first opened of several, and its residual."""
        rest, at = self.open >> size, size
        while rest:
            step = (rest & -rest).bit_length() - 1
            at += step
            free = self.with_residual[at] & ~blocked
            if free:
                return (free & -free).bit_length() - 1, at
            rest >>= step + 1
            at += 1
        return None

    def put(self, size: int, cluster: Hashable = None, source: Hashable = None) -> int:
        """The bin of an item (None conflicts with nothing)."""
        found = self._tightest(size, self.with_cluster.get(cluster, 0) | self.with_source.get(source, 0))
        if found is None:
            b, residual = self.count, self.capacity
            self.count += 1
        else:
            b, residual = found
            self.with_residual[residual] &= ~(1 << b)
            if not self.with_residual[residual]:
                self.open &= ~(1 << residual)
        for held, key in ((self.with_cluster, cluster), (self.with_source, source)):
            if key is not None:
                held[key] = held.get(key, 0) | 1 << b
        if left := residual - size:
            self.with_residual[left] = self.with_residual.get(left, 0) | 1 << b
            self.open |= 1 << left
        return b


def _shared(values: pd.Series) -> list[int | None]:
    """Each value that occurs more than once; others conflict with nothing."""
    return [v if n > 1 else None for v, n in zip(values, values.map(values.value_counts()).fillna(0))]


def pack_group(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """item, bin of one group; items has item, n, source, cluster (n from 1 to the capacity)."""
    # A cluster or source with more texts than the items fill contexts decides how many there are: its texts come first,
    # one to a context, and the others fill these up.
    contexts = items["n"].sum() / capacity
    sizes = pd.concat([items.groupby(c)["item"].transform("size").where(items[c].notna()) for c in ("cluster", "source")], axis=1).max(axis=1).fillna(0)
    items = items.assign(first=(sizes * 2 > contexts) * sizes * (len(items) > 2)).sort_values(["first", "n", "item"], ascending=[False, False, True], kind="stable")
    bins = Bins(capacity)
    at = [bins.put(n, c, s) for n, c, s in zip(items["n"].tolist(), _shared(items["cluster"]), _shared(items["source"]))]
    return pd.DataFrame({"item": items["item"].to_numpy(), "bin": at})


def sizes(df: DataFrame, columns: list[str], text_col: str, ranks: str = RANKS) -> DataFrame:
    """The columns, ``n_tokens``, and ``copy``: a hash of the text's words without case and spacing (null if none)."""
    source = spread(df.select(*columns, F.col(text_col).alias("__text")))
    at = len(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:at]) + ", n_tokens bigint, copy bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(ranks)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            n = [encoder.size(t) if t else 0 for t in texts]
            copy = [xxhash.xxh3_64_intdigest(" ".join(t.lower().split())) - (1 << 63) if t and not t.isspace() else None for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n, pa.int64()), pa.array(copy, pa.int64())], names=[*batch.schema.names[:at], "n_tokens", "copy"])

    return source.mapInArrow(run, schema)


def near_clusters(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, cluster: the group of near-duplicates (five words, a resemblance of 0.8) of each id that has others in it."""
    groups = near_groups(near_links(df, id_col, text_col)).where("group_size > 1")
    return groups.groupBy(F.col("id").alias(id_col)).agg(F.min(F.xxhash64(F.col("group_id").cast("string"))).alias("cluster"))


def pack(df: DataFrame, id_col: str, text_col: str, source_col: str, capacity: int, clusters: DataFrame | None = None, ranks: str = RANKS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Every row's pieces and their contexts: id, item (the row), piece, token_start, token_end, n_tokens of the text,
    context, and by hash the source and the cluster that the context holds once.

    ``clusters`` (id, cluster) has the duplicate clusters; a text that is in none clusters with those of the same words.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(source_col).cast("string")).alias("hashed"), F.col(source_col).isNull().alias("unsourced"))
    sized = sizes(named, ["id", "hashed", "unsourced"], "text", ranks)
    # Equal rows are counted and then told apart by number, wherever they are read.
    row = ["id", "hashed", "unsourced", "n_tokens", "copy"]
    counted = sized.groupBy(*row).agg(F.count("*").alias("rows"))
    places = counted.select(*row, F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("place"))
    name = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*row, "place"])))
    items = written(places.select(name.alias("item"), "id", F.when(~F.col("unsourced"), F.col("hashed")).alias("source"), F.col("copy").alias("cluster"), "n_tokens"), "sizes")
    if clusters is not None:
        known = clusters.select(F.col(id_col).alias("id"), F.col("cluster").alias("known"))
        items = written(items.join(known, "id", "left").select("item", "id", "source", F.coalesce("known", "cluster").alias("cluster"), "n_tokens"), "items")
    groups = max(1, -(-items.count() // group_items))
    full, rest = F.floor(F.col("n_tokens") / capacity), F.col("n_tokens") % capacity
    left = items.where(rest > 0).select("item", rest.cast("int").alias("n"), "source", "cluster", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("group"))

    def fill(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        return pack_group(rows, capacity).assign(group=key[0])[["item", "group", "bin"]]

    placed = left.groupBy("group").applyInPandas(fill, "item string, group int, bin int")
    last = items.join(placed, "item", "left").select("item", "id", "n_tokens", full.cast("int").alias("piece"), (F.col("n_tokens") - rest).alias("token_start"), F.col("n_tokens").alias("token_end"), F.format_string("g%d-%d", "group", "bin").alias("context"), "bin", "source", "cluster")
    last = last.where("token_end > token_start or n_tokens = 0").withColumn("context", F.when(F.col("bin").isNotNull(), F.col("context"))).drop("bin")
    whole = items.where(full > 0).select("item", "id", "n_tokens", "source", "cluster", F.explode(F.sequence(F.lit(0), full.cast("int") - 1)).alias("piece"))
    whole = whole.select("item", "id", "n_tokens", "piece", (F.col("piece") * capacity).cast("bigint").alias("token_start"), ((F.col("piece") + 1) * capacity).cast("bigint").alias("token_end"), F.format_string("t%s-%d", "item", "piece").alias("context"), "source", "cluster")
    return last.unionByName(whole).select(F.col("id").alias(id_col), "item", "piece", "token_start", "token_end", "n_tokens", "context", "source", "cluster")


def _packed(spark: SparkSession, sf_dir: str, capacity: int) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pack(documents, "doc_id", "text", "article_id", capacity, near_clusters(documents, "doc_id", "text"))


_PIECES = ["doc_id", "piece", "token_start", "token_end", "n_tokens", "context"]


def p5_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of 2 048 tokens of each document; near-duplicates and texts of one article never share one."""
    return _packed(spark, sf_dir, 2_048).select(_PIECES)


def p5_contexts_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of 512 tokens of each document; near-duplicates and texts of one article never share one."""
    return _packed(spark, sf_dir, 512).select(_PIECES)


def p5_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the contexts of 2 048 tokens are."""
    used = p5_contexts(spark, sf_dir).where("context is not null").groupBy("context").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    return used.agg(F.count("*").alias("contexts"), F.sum("n").alias("tokens"), F.avg(F.col("n") / 2_048).alias("fill"), F.max("n").alias("fullest"))


def conflicts(packed: DataFrame) -> DataFrame:
    """context, kind, key, n: the sources and clusters that a context holds more than once."""
    kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key")) for kind in ("source", "cluster")))).alias("k")
    held = packed.where("context is not null").select("context", kinds).where("k.key is not null")
    return held.groupBy("context", "k.kind", "k.key").agg(F.count("*").alias("n")).where("n > 1")


def p5_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles and duplicate clusters that a context of 2 048 tokens holds more than once: none."""
    return conflicts(_packed(spark, sf_dir, 2_048))


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document: whether its pieces follow one another and make up the text, and whether its contexts hold at most 2 048."""
    pieces = written(_packed(spark, sf_dir, 2_048), "pieces")
    used = pieces.where("context is not null").groupBy("context").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    joined = pieces.join(used, "context", "left").withColumn("n", F.col("token_end") - F.col("token_start"))
    in_place = (F.col("token_start") == F.col("piece") * 2_048) & ((F.col("n") == 2_048) | (F.col("token_end") == F.col("n_tokens"))) & (F.col("context").isNotNull() | (F.col("n_tokens") == 0))
    return joined.groupBy("doc_id").agg((F.min(in_place) & (F.sum("n") == F.max("n_tokens")) & (F.countDistinct("piece") == F.count("*"))).alias("whole"), (F.max(F.coalesce("used", F.lit(0))) <= 2_048).alias("fits"))


QUERIES = {f.__name__: f for f in (p5_contexts, p5_contexts_512, p5_fill, p5_conflicts, p5_cover)}
ORACLES = {
    "p5_conflicts": "SELECT CAST(NULL AS VARCHAR) AS context, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS key, CAST(NULL AS BIGINT) AS n FROM documents WHERE FALSE",
    "p5_cover": "SELECT doc_id, TRUE AS whole, TRUE AS fits FROM documents",
}
