"""Problem 3: near-duplicate records, by an inverted join over signature coordinates.

A text's signature has ``coordinates`` coordinates over its runs of ``words`` words, each of ``WIDTH`` MinHash values. Each text is posted under each
(coordinate, value) pair. Two texts that agree on at least ``matches`` coordinates are candidates; texts whose
resemblance is the threshold fall short of that with a probability of at most ``miss``. The join counts collisions
without merging long lists: of each text's postings, up to ``matches - 1`` that are common over the corpus are skipped,
most common first. As all texts skip by one order, what two texts share and did not post is at most the larger of
their numbers of skipped postings, so no pair is lost by skipping: it is retained when its collisions plus that number
reach ``matches``. Retained pairs are verified by their exact resemblance.

A posting travels with a sketch of its signature, five bits of each coordinate. Two sketches agree at least where the
signatures do, so pairs of a long list that cannot reach ``matches`` end in the join and are never put out.

Scale: exact copies are one class from the start, so a text that fills a third of the table is signed, posted and
verified once. What moves is hashes; texts move only for classes in a retained pair. All lists are counted, and those
that are long all the same are split into blocks that meet pairwise, each in a task of its own.

Defined results: null or blank texts and null ids take no part; a text with fewer than ``words`` words resembles
nothing, not even its copies; an id with several texts is linked through any of them; repeated rows count once; an
empty table gives empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.functions.text import WS
from groundmill.llm.words import WORD, Hasher, mix, runs, seeds, segment_minima
from groundmill.session import spread, table, written

#: Common postings known to every task: at most so many, 16 bytes each.
COMMON_LIMIT = 65_536
#: A posting is common from so many texts on.
COMMON_FROM = 64
#: MinHash values joined in one coordinate. A run of words that many texts have is often the least by itself, but seldom
#: twice with the same partner, so the lists of postings stay short as the corpus grows.
WIDTH = 2
#: Rows of one key that meet in one task; longer lists are split.
BLOCK = 2_000
#: Classes whose texts are found by a broadcast list of their hashes (8 bytes each); beyond it, by a shuffled join.
LISTED_CLASSES = 2_000_000
#: Bits of a coordinate in the sketch that travels with a posting, and coordinates in one 64-bit part of it.
SKETCH_BITS, SKETCH_PART = 5, 12
UNITS = {"words": WORD.findall, "chars": list}
_U = np.uint64


class Links(NamedTuple):
    """members: scope, id, cls. links: cls_a < cls_b and their resemblance."""

    members: DataFrame
    links: DataFrame


def match_threshold(coordinates: int, similarity: float, miss: float) -> int:
    """The most matches that a pair at the threshold reaches with a probability of at least 1 - miss."""
    below, m = 0.0, 0
    while m < coordinates:
        below += comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > miss:
            break
        m += 1
    return max(1, m)


def _signatures(texts: list[str], k: int, coordinates: int, hasher: Hasher, units: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the texts that have a run of k units, and their signatures (one row each)."""
    words = [UNITS[units](t.lower()) for t in texts]
    size = np.array([len(w) for w in words], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    has = np.flatnonzero(size >= k)
    if not len(has):
        return has, np.empty((0, coordinates), dtype=_U)
    every = runs(hasher.words([w for ws in words for w in ws]), k)
    out = np.zeros((len(has), coordinates), dtype=_U)
    starts, ends = first[has], first[has] + size[has] - k + 1
    with np.errstate(over="ignore"):
        for c, s in enumerate(seeds(coordinates * WIDTH)):
            out[:, c // WIDTH] = mix(out[:, c // WIDTH] * _U(WIDTH + 1) + segment_minima((every ^ s) * (s | _U(1)), starts, ends))
    return has, out


def _signed(texts: DataFrame, words: int, coordinates: int, units: str) -> DataFrame:
    """cls and signature of each class, once. Copies within a batch are signed once, those across batches folded after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            first = {c: i for i, c in enumerate(batch.column(0).to_pylist())}
            rows = batch.take(pa.array(sorted(first.values()), pa.int64()))
            has, signature = _signatures(rows.column(1).to_pylist(), words, coordinates, hasher, units)
            salt = rows.column(2).to_numpy(zero_copy_only=False)[has]
            flat = pa.array((signature.view(np.int64) ^ salt[:, None]).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, coordinates, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(has)), lists], names=["cls", "signature"])

    return spread(texts.select("cls", "text", "salt")).mapInArrow(run, "cls bigint, signature array<bigint>").dropDuplicates(["cls"])


def _common(signed: DataFrame) -> dict[int, int]:
    """The commonest postings and about how many texts have each: a list of at most COMMON_LIMIT for every task.

    It only sets the order in which postings are skipped. Any order that all tasks share gives the same pairs, so a
    posting that is seldom within each task, and therefore not counted, costs time and no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            keep = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(value[keep]), pa.array(n[keep])], names=["posting", "n"])

    counted = signed.select("signature").mapInArrow(run, "posting bigint, n bigint").groupBy("posting").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM)
    return {r.posting: r.n for r in counted.orderBy(F.desc("n"), "posting").limit(COMMON_LIMIT).collect()}


def _sketch_parts(coordinates: int) -> list[str]:
    return [f"sketch{i}" for i in range(-(-coordinates // SKETCH_PART))]


def _most_matches(coordinates: int) -> Column:
    """How many coordinates of sketch_a and sketch_b are equal: at least as many as those of the signatures."""
    low = sum(1 << (SKETCH_BITS * i) for i in range(SKETCH_PART))
    different = F.lit(0)
    for part in _sketch_parts(coordinates):
        x = F.col(f"{part}_a").bitwiseXOR(F.col(f"{part}_b"))
        any_bit = x
        for i in range(1, SKETCH_BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, i))
        different = different + F.bit_count(any_bit.bitwiseAND(F.lit(low)))
    return F.lit(coordinates) - different


def _postings(signed: DataFrame, matches: int, common: dict[int, int], coordinates: int) -> DataFrame:
    """posting, cls, how many postings of cls were skipped, and the sketch of its signature."""
    parts = _sketch_parts(coordinates)
    order = sorted(common.items())
    known, counts = np.array([p for p, _ in order], dtype=np.int64), np.array([n for _, n in order], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            value = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(cls), -1)
            n = np.zeros(value.shape, dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                n = np.where(known[at] == value, counts[at], 0)
            # Commonest first; among equals by value, so that every text skips by the same order.
            rank = np.lexsort((value, -n), axis=1)
            skipped = np.minimum((n > 0).sum(axis=1), matches - 1)
            place = np.empty_like(rank)
            np.put_along_axis(place, rank, np.broadcast_to(np.arange(value.shape[1]), value.shape), axis=1)
            keep = place >= skipped[:, None]
            row = np.nonzero(keep)[0]
            bits = value & ((1 << SKETCH_BITS) - 1)
            sketch = [(bits[:, i : i + SKETCH_PART] << (SKETCH_BITS * np.arange(min(SKETCH_PART, value.shape[1] - i)))).sum(axis=1) for i in range(0, value.shape[1], SKETCH_PART)]
            columns = [value[keep], cls[row], skipped[row].astype(np.int32), *(part[row] for part in sketch)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["posting", "cls", "skipped", *parts])

    return signed.select("cls", "signature").mapInArrow(run, "posting bigint, cls bigint, skipped int, " + ", ".join(f"{p} bigint" for p in parts))


def _with_blocks(postings: DataFrame) -> DataFrame:
    """``blocks``: into how many a posting's list is split, 1 for all but the long ones.

    Every list is counted. The long ones are a table, which the planner broadcasts while it is small and shuffles beyond.
    """
    long = postings.groupBy("posting").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    long = written(long.select("posting", F.ceil(F.col("n") / BLOCK).cast("int").alias("__blocks")), "long")
    return postings.join(long, "posting", "left").withColumn("blocks", F.coalesce("__blocks", F.lit(1))).drop("__blocks")


def pairs_within(df: DataFrame, keys: list[str], item: str, blocks: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs item_a < item_b of the same key, with the carried columns of both.

    A key with ``blocks`` > 1 has its items dealt over so many blocks; each two blocks, and each block with itself,
    meet as a group of their own. A long list thus becomes many groups of bounded size.
    """
    dealt = df.select(*keys, item, *carry, blocks.alias("__n")).withColumn("__block", F.when(F.col("__n") > 1, F.pmod(F.xxhash64(item), F.col("__n"))).otherwise(0).cast("int"))
    single = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    met = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda j: F.struct(F.least(F.col("__block"), j.cast("int")).alias("x"), F.greatest(F.col("__block"), j.cast("int")).alias("y")))
    rows = dealt.withColumn("__meet", F.explode(F.when(F.col("__n") > 1, met).otherwise(single))).select(*keys, "__meet.x", "__meet.y", "__block", item, *carry)
    side = lambda s: rows.select(*keys, "x", "y", F.col("__block").alias(f"__block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in (item, *carry)))
    apart = (F.col(f"{item}_a") < F.col(f"{item}_b")) & ((F.col("x") == F.col("y")) | (F.col("__block_a") != F.col("__block_b")))
    return side("a").join(side("b"), [*keys, "x", "y"]).where(apart).drop("x", "y", "__block_a", "__block_b")


def _verified(pairs: DataFrame, words: int, similarity: float, units: str) -> DataFrame:
    """Exact resemblance of the pairs' texts: shared runs divided by the runs of both together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        read = lru_cache(4_096)(lambda text: np.unique(runs(hasher.words(UNITS[units](text.lower())), words)))
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            score = np.zeros(len(a))
            for i, (x, y) in enumerate(zip(a, b)):
                p, q = read(x), read(y)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                score[i] = shared / (len(p) + len(q) - shared) if shared else 0.0
            keep = pa.array(np.flatnonzero(score >= similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(score).take(keep)], names=["cls_a", "cls_b", "similarity"])

    return pairs.select("cls_a", "cls_b", "text_a", "text_b").mapInArrow(run, "cls_a bigint, cls_b bigint, similarity double")


def near_links(df: DataFrame, id_col: str, text_col: str, scope_col: str | None = None, words: int = 5, similarity: float = 0.8, coordinates: int = 24, miss: float = 0.003, units: str = "words") -> Links:
    """Which texts resemble each other. Only texts of one scope are compared. ``units`` may be "chars" instead of words.

    cls is the hash of the exact text and its scope. ``links`` has each pair of different texts whose resemblance is
    at least ``similarity`` (of pairs that just reach it a share of up to ``miss`` stays unseen, of closer ones far
    less); copies are in ``members``, not expanded.
    """
    matches = match_threshold(coordinates, similarity**WIDTH, miss)
    scope = F.coalesce(F.col(scope_col).cast("string"), F.lit("")) if scope_col else F.lit("")
    base = df.select(scope.alias("scope"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.where(F.col("id").isNotNull() & F.col("text").rlike(f"[^{WS}]")).withColumn("cls", F.xxhash64("scope", "text")).withColumn("salt", F.xxhash64("scope"))
    signed = written(_signed(base, words, coordinates, units), "signatures")
    members = base.select("scope", "id", "cls").distinct().join(signed.select("cls"), "cls", "left_semi")
    postings = _with_blocks(_postings(signed, matches, _common(signed), coordinates))
    met = pairs_within(postings, ["posting"], "cls", F.col("blocks"), ("skipped", *_sketch_parts(coordinates))).where(_most_matches(coordinates) >= matches)
    counted = met.groupBy("cls_a", "cls_b").agg(F.count("*").alias("n"), F.first(F.greatest("skipped_a", "skipped_b")).alias("skipped"))
    retained = written(counted.where(F.col("n") + F.col("skipped") >= matches).select("cls_a", "cls_b"), "retained")
    wanted = retained.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    listed = retained.count() * 2 <= LISTED_CLASSES
    texts = base.select("cls", "text").join(F.broadcast(wanted) if listed else wanted, "cls", "left_semi").dropDuplicates(["cls"])
    side = lambda s: texts.select(F.col("cls").alias(f"cls_{s}"), F.col("text").alias(f"text_{s}"))
    return Links(members, _verified(retained.join(side("a"), "cls_a").join(side("b"), "cls_b"), words, similarity, units))


def linked_ids(found: Links) -> DataFrame:
    """scope, id_a < id_b: every two ids with resembling or equal texts. As long as its result; see near_groups."""
    members = found.members
    copies = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
    within = pairs_within(members.join(copies, "cls"), ["scope", "cls"], "id", F.ceil(F.col("n") / BLOCK).cast("int")).select("scope", "id_a", "id_b")
    a, b = members.select("scope", F.col("id").alias("x"), F.col("cls").alias("cls_a")), members.select(F.col("id").alias("y"), F.col("cls").alias("cls_b"))
    across = found.links.join(a, "cls_a").join(b, "cls_b").where("x <> y").select("scope", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return within.unionByName(across).distinct()


def components(links: DataFrame) -> DataFrame:
    """cls and the least cls of its component, for the classes in ``links``.

    Each round takes the least label among the neighbours and then that label's label, so a chain of n links needs
    about log n rounds. A round's labels are a table in the shared folder; only a count comes to the driver.
    """
    edges = written(links.select(F.explode(F.array(F.struct(F.col("cls_a").alias("u"), F.col("cls_b").alias("v")), F.struct(F.col("cls_b").alias("u"), F.col("cls_a").alias("v")))).alias("e")).select("e.*"), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        least = labels.join(near, "u").select("u", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        jump = least.select(F.col("u").alias("label"), F.col("label").alias("next"))
        moved = written(least.join(jump, "label").select("u", "was", F.col("next").alias("label")), "labels")
        labels = moved.select("u", "label")
        if moved.where("was <> label").isEmpty():
            return labels.select(F.col("u").alias("cls"), F.col("label").alias("root"))


def near_groups(found: Links) -> DataFrame:
    """One row per scope, id and text: the group's least id, the group's size, and the numbers of links and copies.

    Counting is done per class, after the copies are folded, so that a text in a third of the rows is one row there.
    """
    links = written(found.links, "links")
    sizes = found.members.groupBy("scope", "cls").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    classes = sizes.join(components(links), "cls", "left").join(degree, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = classes.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("group_size"))
    per_class = classes.join(groups, "root").select("cls", "group_id", "group_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    return found.members.join(per_class, "cls").select("scope", "id", "group_id", "group_size", "n_links", "n_copies")


def _texts(passages: DataFrame, candidates: DataFrame) -> DataFrame:
    a = passages.select(F.lit("passages").alias("tbl"), F.col("passage_id").alias("id"), "text")
    return a.unionByName(candidates.select(F.lit("candidate_docs").alias("tbl"), F.col("doc_id").alias("id"), "text"))


def _found(spark: SparkSession, sf_dir: str) -> Links:
    texts = _texts(table(spark, sf_dir, "passages"), table(spark, sf_dir, "candidate_docs"))
    return near_links(texts, "id", "text", "tbl", words=3, similarity=0.6)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_ids(_found(spark, sf_dir)).withColumnRenamed("scope", "tbl")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage and candidate document with its group of near-duplicates."""
    return near_groups(_found(spark, sf_dir)).withColumnRenamed("scope", "tbl")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
_CLASSES_SQL = f"""t AS (SELECT tbl, id, text FROM (SELECT DISTINCT * FROM (
  SELECT 'passages' AS tbl, passage_id AS id, text FROM passages UNION ALL SELECT 'candidate_docs', doc_id, text FROM candidate_docs)) WHERE id IS NOT NULL AND regexp_matches(text, '[^{WS}]')),
c AS (SELECT tbl, text, k, w FROM (SELECT *, row_number() OVER () AS k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT tbl, text FROM t)) WHERE len(w) >= 3),
s AS (SELECT DISTINCT tbl, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM c)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
links AS (SELECT p, q FROM (SELECT a.k AS p, b.k AS q, count(*) AS shared FROM s a JOIN s b ON a.tbl = b.tbl AND a.g = b.g AND a.k < b.k GROUP BY ALL) JOIN n a ON a.k = p JOIN n b ON b.k = q WHERE shared >= 0.6 * (a.n + b.n - shared)),
both_ways AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links)"""
ORACLES = {
    "p3_groups": f"""WITH RECURSIVE {_CLASSES_SQL},
reach AS (SELECT k, k AS r FROM c UNION SELECT reach.k, q FROM reach JOIN both_ways ON p = r),
roots AS (SELECT k, min(r) AS root FROM reach GROUP BY k),
members AS (SELECT t.tbl, t.id, c.k, root FROM t JOIN c USING (tbl, text) JOIN roots USING (k)),
groups AS (SELECT root, min(id) AS group_id, count(*) AS group_size FROM members GROUP BY root),
copies AS (SELECT k, count(*) - 1 AS n_copies FROM members GROUP BY k),
degree AS (SELECT p AS k, count(*) AS n_links FROM both_ways GROUP BY p)
SELECT tbl, id, group_id, group_size, coalesce(n_links, 0) AS n_links, n_copies FROM members JOIN groups USING (root) JOIN copies USING (k) LEFT JOIN degree USING (k)""",
    "p3_found": f"""WITH t AS (SELECT tbl, id, text, row_number() OVER () AS k FROM (SELECT DISTINCT * FROM (
  SELECT 'passages' AS tbl, passage_id AS id, text FROM passages UNION ALL SELECT 'candidate_docs', doc_id, text FROM candidate_docs)) WHERE id IS NOT NULL AND regexp_matches(text, '[^{WS}]')),
w AS (SELECT tbl, id, k, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
s AS (SELECT DISTINCT tbl, id, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.tbl, a.id AS x, b.id AS y, a.k AS p, b.k AS q, count(*) AS shared FROM s a JOIN s b ON a.tbl = b.tbl AND a.g = b.g AND a.k < b.k AND a.id <> b.id GROUP BY ALL)
SELECT DISTINCT tbl, least(x, y) AS id_a, greatest(x, y) AS id_b FROM c JOIN n a ON a.k = p JOIN n b ON b.k = q WHERE shared >= 0.6 * (a.n + b.n - shared)"""
}
