"""Problem 7: oversized texts cut at natural boundaries, by lexical cohesion.

The vocabularies of the blocks of words before and after each sentence or paragraph end are compared. Where their
similarity lies in a valley, the topic changes; the depth of the valley is the sum of the climbs to the peaks on both
sides. Each piece ends at the deepest valley among the sentence and paragraph ends in the upper half of the size window;
failing that at the last one before it, at the last word end, or, in a text without blanks, between two tokens at a
character's end. The next piece begins ``overlap`` tokens earlier, at the start of the word that these begin in.

Scale: one row in, its pieces out, where the row is read; no shuffle. Work is linear in the length of a text.

Defined results: a text within the limit is one piece; null, blank and empty texts give no piece; repeated rows give
repeated pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundmill.llm.tokens import RANKS, Tokenizer, tokenizer
from groundmill.llm.words import WORD
from groundmill.session import spread, table

#: Units (sentences) of a block on either side of a cut; hashed dimensions of its vocabulary; letters of a word that counts.
BLOCK = 4
DIMENSIONS = 128
LEAST_LETTERS = 4
KNOWN_WORDS = 500_000
#: What a paragraph end is worth as compared with a sentence end, in depth of valley.
PARAGRAPH = 0.1
_SENTENCE_END = re.compile(r"[.!?。！？][\"”»')\]]*(\s+)")


class Piece(NamedTuple):
    start: int
    end: int
    overlap: int
    boundary: str


def _line_ends(text: str) -> Iterator[int]:
    """Where the white space begins that holds a line end or several."""
    at = text.find("\n")
    while at >= 0:
        start = at
        while start and text[start - 1].isspace():
            start -= 1
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text):
            yield start
        at = text.find("\n", at)


def _boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets where a sentence or paragraph has ended, and which are paragraphs' ends."""
    lines = np.fromiter(_line_ends(text), dtype=np.int64)
    sentences = np.array([m.start(1) for m in _SENTENCE_END.finditer(text) if m.end() < len(text)], dtype=np.int64)
    at = np.union1d(lines, sentences)
    at = at[at > 0]
    return at, np.isin(at, lines)


class _Dimensions:
    """The hashed dimension of each word, or none if it is too short; keeps those it has seen, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh32_intdigest(w) % DIMENSIONS if len(w) >= LEAST_LETTERS else -1
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


_DIMENSIONS = _Dimensions()


def valley_depths(text: str, at: np.ndarray) -> np.ndarray:
    """How deep a valley of similarity each boundary lies in."""
    if not len(at):
        return np.empty(0)
    edges = [0, *at.tolist(), len(text)]
    words = [WORD.findall(text[a:b].lower()) for a, b in zip(edges, edges[1:])]
    unit = np.repeat(np.arange(1, len(words) + 1), [len(w) for w in words])
    code = _DIMENSIONS.of([w for ws in words for w in ws])
    counts = np.bincount((unit * DIMENSIONS + code)[code >= 0], minlength=(len(words) + 1) * DIMENSIONS)
    sums = np.cumsum(counts.reshape(len(words) + 1, DIMENSIONS), axis=0)
    gap = np.arange(1, len(at) + 1)
    before = (sums[gap] - sums[np.maximum(gap - BLOCK, 0)]).astype(np.float64)
    after = (sums[np.minimum(gap + BLOCK, len(at) + 1)] - sums[gap]).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", before, before) * np.einsum("ij,ij->i", after, after))
    similarity = np.divide(np.einsum("ij,ij->i", before, after), norm, out=np.zeros(len(at)), where=norm > 0)
    return _climbs(similarity.tolist()) + _climbs(similarity[::-1].tolist())[::-1]


def _climbs(similarity: list[float]) -> np.ndarray:
    """How far each lies below the peak that the way back from it climbs to without going down."""
    peak, last, out = 0.0, -1.0, []
    for x in similarity:
        peak = peak if last >= x else x
        out.append(peak - x)
        last = x
    return np.array(out)


def _char_starts(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The character at each token's start, and whether the token starts at a character's first byte."""
    if text.isascii():
        return starts, np.ones(len(starts), dtype=bool)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    first = np.append((raw & 0xC0) != 0x80, True)
    return np.concatenate(([0], np.cumsum(first[:-1])))[starts], first[starts]


def cut(text: str, encoder: Tokenizer, limit: int, overlap: int) -> Iterator[tuple[Piece, int, int, int]]:
    """The pieces by token offsets, with their character offsets and sizes."""
    tokens = encoder.tokens(text)
    total = len(tokens)
    if total <= limit:
        yield Piece(0, total, 0, "end"), 0, len(text), total
        return
    char, whole = _char_starts(text, encoder.starts(tokens))
    word = np.append(encoder.word_ends(tokens), True) & whole
    word[0] = True
    words, wholes = np.flatnonzero(word), np.flatnonzero(whole)
    at, paragraph = _boundaries(text)
    depth = valley_depths(text, at) + PARAGRAPH * paragraph
    # The first token that starts at or after a boundary; boundaries that fall inside a token are word ends at most.
    token = np.searchsorted(char, at)
    fits = (char[np.minimum(token, total)] == at) & whole[np.minimum(token, total)]
    token, depth, paragraph = token[fits], depth[fits], paragraph[fits]

    def last(of: np.ndarray, above: int, most: int) -> int | None:
        i = np.searchsorted(of, most, "right") - 1
        return int(of[i]) if i >= 0 and of[i] > above else None

    def size(start: int, end: int) -> int:
        exact = word[start] and word[end]
        return end - start if exact else encoder.size(text[char[start] : char[end]])

    start, shared, done = 0, 0, 0
    while True:
        if total - start <= limit and size(start, total) <= limit:
            yield Piece(start, total, shared, "end"), int(char[start]), len(text), size(start, total)
            return
        end, kind = None, ""
        most = min(start + limit, total - 1)
        while end is None or size(start, end) > limit:
            for least in (max(done, start + limit // 2), done):
                low, high = np.searchsorted(token, [least, most], "right")
                if high > low:
                    # The deepest valley of the upper half; below it, the last boundary.
                    i = low + (int(np.argmax(depth[low:high])) if least > done or done >= start + limit // 2 else high - low - 1)
                    end, kind = int(token[i]), "paragraph" if paragraph[i] else "sentence"
                    break
            else:
                end, kind = last(words, done, most), "word"
                if end is None:
                    end, kind = last(wholes, done, most) or done + 1, "token"
            most = end - 1
            if most <= done:
                break
        yield Piece(start, end, shared, kind), int(char[start]), int(char[end]), size(start, end)
        back = max(end - overlap, 0)
        start_word = last(words, start, back)
        following = start_word if start_word is not None and end - start_word <= overlap + max(8, overlap // 2) else last(wholes, start, back)
        following = end if following is None or overlap == 0 else following
        done, shared, start = end, end - following, following


def split(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, ranks: str = RANKS) -> DataFrame:
    """Every text's pieces in order: id, piece, n_pieces, char_start, char_end, n_tokens, overlap_tokens, boundary, text."""
    if limit < 1 or overlap < 0 or 3 * overlap > limit:
        raise ValueError("the limit must be positive and at least three times the overlap")
    source = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\S")))
    names = ["piece", "n_pieces", "char_start", "char_end", "n_tokens", "overlap_tokens", "boundary", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(ranks)
        for batch in batches:
            at, rows, held = [], [], 0
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                pieces = list(cut(text, encoder, limit, overlap))
                at += [i] * len(pieces)
                rows += [(k, len(pieces), a, b, n, p.overlap, p.boundary, text[a:b]) for k, (p, a, b, n) in enumerate(pieces)]
                held += len(text)
                if held > 8_000_000 or i == len(texts) - 1:
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["id", *names])
                    at, rows, held = [], [], 0

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, n_pieces int, char_start bigint, char_end bigint, n_tokens int, overlap_tokens int, boundary string, text string").withColumnRenamed("id", id_col)


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in pieces of at most 512 tokens, each repeating 32 of the one before."""
    return split(table(spark, sf_dir, "documents"), "doc_id", "text", 512, 32)


def p7_pieces_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in pieces of at most 256 tokens, each repeating 32 of the one before."""
    return split(table(spark, sf_dir, "documents"), "doc_id", "text", 256, 32)


def p7_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document: a hash of its pieces put together without what they repeat, and whether all are within 512 tokens and
    each goes on where the one before has ended or earlier."""
    before = F.lag("char_end", 1, 0).over(Window.partitionBy("doc_id").orderBy("piece"))
    pieces = p7_pieces(spark, sf_dir).withColumn("before", before).withColumn("new", F.expr("substr(text, int(before - char_start + 1))"))
    in_order = (F.col("char_start") <= F.col("before")) & (F.col("char_end") > F.col("before")) & ((F.col("piece") == 0) | (F.col("overlap_tokens") > 0))
    parts = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "new"))).alias("parts"), (F.max("n_tokens") <= 512).alias("within"), F.min(in_order).alias("in_order"))
    return parts.select("doc_id", F.md5(F.array_join("parts.new", "")).alias("text_md5"), "within", "in_order")


QUERIES = {f.__name__: f for f in (p7_pieces, p7_pieces_256, p7_joined)}
ORACLES = {"p7_joined": r"SELECT doc_id, md5(text) AS text_md5, TRUE AS within, TRUE AS in_order FROM documents WHERE regexp_matches(text, '[^ \t\n\x0b\f\r]')"}
