"""Problem 6: evaluation texts inside training texts, by SimHash windows and multi-index Hamming blocks.

Items and documents are read as words: case, accents, punctuation, markup signs, invisible characters and spacing are
put aside. An item is covered by windows of the size that counts as a leak (``window`` words); a document has one at
every word. A window's fingerprint is the SimHash of its weighted shingles (pairs of words, weighted by their length).
Fingerprints are cut into ``radius`` + 1 blocks: any two within the radius agree on a whole block, so looking up each
block of a document's window among the items' finds all of them. Candidates are verified by their exact weighted
shingle similarity, and those of the same words in the same order are marked as exact.

Scale: the items are a stated query set. Their windows are made in tasks and written as a table, which is held against
all documents in slices of about ``slice_windows`` windows (about 150 bytes each): one slice at a time comes to the
driver and is sent to all tasks; documents are read in place, without a shuffle. Only (document, item) pairs come out.

Defined results: null and blank texts, and items shorter than the window, match nothing; repeated rows count once; an
empty table gives no rows; very long texts are worked through in pieces that overlap by a window; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.llm.words import WORD, Hasher, runs
from groundmill.session import spread, table, written

WINDOW = 12
RADIUS = 3
SHINGLE = 2
#: Words whose bit counts are in memory at once, about 1 KB each.
PIECE = 20_000
MOST_WEIGHT = 12
_U = np.uint64


def _class(*categories: str) -> str:
    """A character class of the code points of some Unicode categories, as ranges."""
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in categories]
    spans = [[x for _, x in g] for _, g in groupby(enumerate(points), lambda p: p[1] - p[0])]
    return "[" + "".join(f"{re.escape(chr(s[0]))}-{re.escape(chr(s[-1]))}" for s in spans) + "]+"


_UNSEEN = re.compile(_class("Mn", "Me", "Cf"))
#: The usual ones of these, and whether a text has anything of a script or block where others may be.
_USUAL_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
_ELSEWHERE = re.compile("[\u0483-\u1dff\u2065-\u206f\u20d0-\u20ff\u2c00-\ufefe\uff00-\U0010ffff]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")


def plain_words(text: str) -> list[str]:
    """The words of a text without case, accents, markup and invisible characters; JSON and HTML escapes are read."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.casefold()
    if not text.isascii():
        text = _USUAL_UNSEEN.sub("", unicodedata.normalize("NFKD", text))
        if _ELSEWHERE.search(text):
            text = _UNSEEN.sub("", text)
    return WORD.findall(text)


def _weights(words: list[str]) -> np.ndarray:
    size = np.minimum([len(w) for w in words], MOST_WEIGHT).astype(np.int32)
    return size[:-1] + size[1:]


def simhash_windows(shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The SimHash of every ``n`` consecutive weighted shingles."""
    if len(shingles) < n:
        return np.empty(0, dtype=_U)
    # Sums of 16 bits may wrap; their differences, below 2 * MOST_WEIGHT * n, are right all the same.
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    sums = np.zeros((len(shingles) + 1, 64), dtype=np.int16)
    np.cumsum((2 * bits - 1) * weights.astype(np.int16)[:, None], axis=0, dtype=np.int16, out=sums[1:])
    return np.packbits((sums[n:] - sums[:-n]) > 0, axis=1).view(">u8").ravel().astype(_U)


class BlockIndex:
    """Fingerprints by each of their blocks: finds all within ``radius``."""

    def __init__(self, fingerprints: np.ndarray, radius: int) -> None:
        self.fingerprints, self.radius = fingerprints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:])]
        self.sorted = []
        for shift, width in self.blocks:
            key = self._key(fingerprints, shift, width)
            order = np.argsort(key, kind="stable")
            # Where each value of the block begins in that order, if its values can be listed; else it is searched.
            begins = np.searchsorted(key[order], np.arange((1 << width) + 1, dtype=_U)).astype(np.int32) if width <= 16 else None
            self.sorted.append((key[order], order.astype(np.int32), begins))

    @staticmethod
    def _key(fingerprints: np.ndarray, shift: int, width: int) -> np.ndarray:
        return (fingerprints >> _U(shift)) & _U((1 << width) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a query and of a fingerprint, for each two within the radius, once."""
        found = []
        for (shift, width), (keys, order, begins) in zip(self.blocks, self.sorted):
            wanted = self._key(queries, shift, width)
            if begins is not None:
                wanted = wanted.astype(np.int32)
                low, high = begins[wanted], begins[wanted + 1]
            else:
                low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            has = np.flatnonzero(high > low)
            low, n = low[has], (high - low)[has]
            q = np.repeat(has, n)
            i = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n - low, n)]
            close = np.bitwise_count(queries[q] ^ self.fingerprints[i]) <= self.radius
            found.append(np.stack([q[close], i[close]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]


def weighted_similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Shared weight divided by the weight of both together, over distinct shingles."""
    p, q = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    shared = sum(min(w, q[s]) for s, w in p.items() if s in q)
    return shared / (sum(p.values()) + sum(q.values()) - shared)


WINDOWS = "item bigint, fingerprint bigint, shingles array<bigint>, weights array<int>"


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """A row per window of an item (item, text): item, fingerprint, shingles, weights."""
    n = window - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain_words(text)
                if len(words) < window:
                    continue
                shingles, weights = runs(hasher.words(words), SHINGLE), _weights(words)
                prints = simhash_windows(shingles, weights, n)
                offsets = pa.array(np.arange(0, n * len(prints) + 1, n, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.lib.stride_tricks.sliding_window_view(x, n).ravel())) for x in (shingles.view(np.int64), weights)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), item)), pa.array(prints.view(np.int64)), *lists], names=["item", "fingerprint", "shingles", "weights"])

    return items.select("item", "text").mapInArrow(run, WINDOWS)


class _Items:
    """The windows of a slice of the items, as arrays."""

    def __init__(self, windows: pa.Table, window: int) -> None:
        self.window = window
        columns = [c.combine_chunks() for c in windows.columns]
        values = [(c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False) for c in columns]
        self.ids, self.prints = values[0].astype(np.int64), values[1].astype(np.int64).view(_U)
        self.shingles = values[2].astype(np.int64).view(_U).reshape(len(self.ids), -1 if len(self.ids) else window - SHINGLE + 1)
        self.weights = values[3].astype(np.int32).reshape(self.shingles.shape)


def _pieces(texts: list[str], window: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts' words in pieces of about PIECE, and each word's text; a longer text goes on a window's overlap earlier."""
    words: list[str] = []
    of: list[np.ndarray] = []
    for i, text in enumerate(texts):
        own = plain_words(text)
        for start in range(0, len(own) - window + 1, PIECE):
            part = own[start : start + PIECE + window - 1]
            words += part
            of.append(np.full(len(part), i))
            if len(words) >= PIECE:
                yield words, np.concatenate(of)
                words, of = [], []
    if words:
        yield words, np.concatenate(of)


def _matches(texts: list[str], items: _Items, index: BlockIndex, hasher: Hasher, similarity: float) -> dict[tuple[int, int], tuple[float, int]]:
    """By text and item: the best similarity of their windows, and the number of windows that are equal."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    window, n = items.window, items.window - SHINGLE + 1
    for words, of in _pieces(texts, window):
        shingles, weights = runs(hasher.words(words), SHINGLE), _weights(words)
        inside = np.flatnonzero(of[: len(of) - window + 1] == of[window - 1 :])
        at, item = index.near(simhash_windows(shingles, weights, n)[inside])
        if not len(at):
            continue
        at = inside[at]
        own = np.lib.stride_tricks.sliding_window_view(shingles, n)
        exact = (own[at] == items.shingles[item]).all(axis=1)
        for a, i, same in zip(at.tolist(), item.tolist(), exact.tolist()):
            score = 1.0 if same else weighted_similarity(own[a], weights[a : a + n], items.shingles[i], items.weights[i])
            if score >= similarity:
                key = (int(of[a]), int(items.ids[i]))
                was = best.get(key, (0.0, 0))
                best[key] = (max(was[0], score), was[1] + same)
    return best


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, radius: int = RADIUS, similarity: float = 0.8, slice_windows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, similarity of their closest windows, and how many windows of the document are exactly the item's.

    An item is found in a document if a window of the one and a window of the other have fingerprints within ``radius``
    and a weighted similarity of at least ``similarity``; equal windows always are.
    """
    spark = documents.sparkSession
    items = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    windows = written(item_windows(items, window), "windows")
    slices = max(1, -(-windows.count() // slice_windows))
    source = spread(documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]")))

    def held_against(part: _Items) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, hasher = sent.value, Hasher()
            index = BlockIndex(own.prints, radius)
            for batch in batches:
                found = _matches(batch.column(1).to_pylist(), own, index, hasher, similarity)
                at = pa.array([i for i, _ in found], pa.int64())
                scores = [pa.array([k for _, k in found], pa.int64()), pa.array([x for x, _ in found.values()], pa.float64()), pa.array([n for _, n in found.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *scores], names=["doc", "item", "similarity", "exact_windows"])

        kind = source.schema["doc"].dataType.simpleString()
        return source.mapInArrow(run, f"doc {kind}, item bigint, similarity double, exact_windows bigint"), sent

    found: list[DataFrame] = []
    for k in range(slices):
        # Equal windows have one fingerprint and so lie in one slice.
        part = windows.where(F.pmod(F.xxhash64("fingerprint"), F.lit(slices)) == k) if slices > 1 else windows
        matches, sent = held_against(_Items(part.toArrow(), window))
        if slices > 1:
            matches = written(matches, "matches")
            sent.destroy()
        found.append(matches)
    # A document that has repeated rows, or rows of one id with several texts, has its best.
    per_slice = [f.groupBy("doc", "item").agg(F.max("similarity").alias("similarity"), F.max("exact_windows").alias("exact_windows")) for f in found]
    return reduce(DataFrame.unionByName, per_slice).groupBy(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).agg(F.max("similarity").alias("similarity"), F.sum("exact_windows").alias("exact_windows"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("exact_windows > 0").select("doc_id", "item_id")


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks without a window of the same words: a window within the radius and of a weighted similarity of 0.8."""
    return _leaks(spark, sf_dir).where("exact_windows = 0").select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation item with the number of documents that leak it."""
    leaks = p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "dataset", "split").join(leaks, "item_id", "left")
    return items.select("item_id", "dataset", "split", F.coalesce("documents", F.lit(0)).alias("documents"))


QUERIES = {"p6_found": p6_found, "p6_near": p6_near, "p6_items": p6_items}


def _words_sql(text: str) -> str:
    """The words of a text as the operator reads them, as far as SQL can: JSON escapes of Latin letters only."""
    for code in range(0xA0, 0x180):
        text = f"replace({text}, '\\u{code:04x}', '{chr(code)}')"
    for code in "nrt":
        text = f"replace({text}, '\\{code}', ' ')"
    unseen = "[\\p{Mn}\\p{Me}\\p{Cf}]+"
    return f"regexp_extract_all(regexp_replace(strip_accents(lower({text})), '{unseen}', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def _runs_sql(source: str, key: str) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM (SELECT {key}, {_words_sql('text')} AS w FROM {source} WHERE text IS NOT NULL)))"


_FOUND_SQL = f"SELECT DISTINCT doc_id, item_id FROM {_runs_sql('documents', 'doc_id')} JOIN {_runs_sql('eval_items', 'item_id')} USING (run)"
ORACLES = {
    "p6_found": _FOUND_SQL,
    "p6_items": f"SELECT item_id, dataset, split, coalesce(documents, 0) AS documents FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS documents FROM ({_FOUND_SQL}) GROUP BY item_id) USING (item_id)",
}
