"""Problem 4: texts that were cut off, found by a hashed logistic regression trained on artificial cuts.

Values that end as whole texts do (at a sentence's end, as a list, as a short answer) are cut at random and at the
lengths where the corpus itself piles up; the model learns to tell cut from whole by the closing characters, the
closing words and how often other texts have them before their end, open quotes and brackets, and how the length stands
to such limits. Every text is then scored, copies once.

The model is fitted on about ``sample`` whole texts, those with the least hash, those that at least one in ``HOT_SHARE``
rows has (at most so many), and about ``sample`` prompts: a documented bound. Word counts, length counts and scores
cover all rows.

Scale: texts are folded once and described where they lie; what is joined afterwards are hashes, closing words and
feature names. A word that closes, or a text that fills, a large share of the rows is joined by broadcast (there are at
most ``HOT_SHARE`` such keys, as their shares add up to one), all others by a shuffle that no key dominates.

Defined results: null, blank and word-less texts are not cut; repeated rows get equal scores; an empty table, or one
without whole texts to learn from, gives scores of 0; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.session import HOT_SHARE, generation, join_hot, spread, table, written

DIMENSIONS = 1 << 16
SAMPLE = 20_000
THRESHOLD = 0.5
#: A length is a limit of its source if so many times as many texts have it as have a length near it.
PILE = 4
NEAR = 12
LEAST_LIMIT = 64
#: Words of a text that counts as short; what a cut that leaves so few words counts, as such are rarer than the
#: artificial ones; and what a cut inside a list's item counts, for the same reason.
SHORT = 4
EARLY_CUT = 0.04
ITEM_CUT = 0.1
#: What a prompt counts that is given back without its mark or by a label; for how many rows a whole text counts at most.
CHANGED_PROMPT = 0.2
MOST_COPIES = 100
#: Characters at a text's end in which marks of a cut are looked for at once.
TAIL = 200

# What systems leave where they cut.
MARKS = ("…", "...", "[…]", "[...]", "[truncated]", "(more)", "<eot>", "�")
# Abbreviations after which a sentence goes on.
OPEN_ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Rev", "Gen", "Capt", "Lt", "Sgt", "Gov", "Mt", "Ft", "Vol", "vols", "pp", "cf", "vs", "viz", "approx", "ca", "i.e", "e.g", "Mme", "Mlle", "bzw", "Nr", "Sra", "Dra")
_MARKS = re.compile(r"(?:\s|…|\.\.\.+|�|[\[(<](?:…|\.\.\.|truncated|cut|more|continued|eot|eos)[\])>])+$", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
WORD_IN_SQL = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»')\]]*\s+|(?<=[。！？])[」』）]*|\n+")
_BLANKLESS = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_UNSPACED = re.compile(f"[{_BLANKLESS}]")
_UNIT = re.compile(rf"[{_BLANKLESS}]{{1,2}}|[^\W_{_BLANKLESS}]+(?:['’][^\W_{_BLANKLESS}]+)*")
_ITEM = re.compile(r"\s*(?:[-*•–]|\d+[.)])\s+\S")
_CITED = re.compile(r"(?:\[\d+\])+$")
_LABEL = re.compile(r"(?:^|\n)\w+:$")
_STOPPED = re.compile(r"[.!?。！？][\"”»')\]」』）]*$")
#: A full stop that ends no sentence: after an abbreviation, after a letter by itself.
_OPEN_STOP = re.compile(rf"(?:(?<![^\W_])(?:{'|'.join(map(re.escape, OPEN_ABBREVIATIONS))})|(?<![^\W_])(?<![^\W_]\.)[^\W\d_])\.$", re.I)
_FEW_DIGITS = re.compile(r"(?<![\d.,])\d{1,3}\.$")
_NUMBER = re.compile(r"(?<=\s)\d+(?=[\s,.\d])")


def core(text: str) -> tuple[str, bool]:
    """The text without blanks and marks of a cut at its end, and whether there were such marks."""
    bare = text.rstrip()
    unblanked = len(bare)
    while True:
        tail = bare[-TAIL:]
        kept = _MARKS.sub("", tail)
        if len(kept) == len(tail):
            return bare, len(bare) < unblanked
        bare = (bare[: len(bare) - len(tail)] + kept).rstrip()


def whole_end(bare: str) -> bool:
    """Whether the text ends with the end of a sentence."""
    return bool(_STOPPED.search(bare[-TAIL:])) and not _OPEN_STOP.search(bare[-TAIL:])


def closing_word(text: str) -> str:
    words = _WORD.findall(text[-200:])
    return words[-1].lower() if words else ""


def _before_end(bare: str, word: str) -> bool:
    """Whether the text has the word also before its end."""
    low = bare.lower()
    end, at = low.rfind(word), low.find(word)
    while 0 <= at < end:
        if not (low[at - 1 : at].isalnum() or low[at + len(word) : at + len(word) + 1].isalnum()):
            return True
        at = low.find(word, at + 1)
    return False


def _bucket(n: float, *edges: float) -> int:
    return sum(n >= e for e in edges)


def _length(text: str) -> int:
    """Words; in scripts without blanks, two characters count as one."""
    return len(_UNIT.findall(text))


class Features(NamedTuple):
    """Names of features: those that hold, those that go with how well the closing word is known, and those that hold
    if it is a common one."""

    plain: list[str]
    by_known: list[str]
    if_common: list[str]


def describe(bare: str, marked: bool, at_limit: bool, copies: int = 1) -> Features:
    """``bare``, ``marked``: as of :func:`core`; ``copies``: in how many rows the text is."""
    start = max(bare.rfind("\n") + 1, 0)
    # Ten words are as good as more, so that the last sentence is looked for near the end.
    parts = [p for p in _SENTENCE.split(bare[-5 * TAIL :]) if p]
    last = parts[-1] if parts else ""
    words = _WORD.findall(last)
    final = _WORD.findall(bare[-40:])
    word = final[-1] if final else ""
    end = bare[-1:]
    tail = bare[-TAIL:]
    stopped = bool(_STOPPED.search(tail))
    if not end:
        ending = "none"
    elif stopped and _OPEN_STOP.search(tail):
        ending = "abbreviation"
    elif stopped:
        ending = "number." if _FEW_DIGITS.search(tail) else "stop"
    elif _CITED.search(tail):
        ending = "cited"
    elif _LABEL.search(tail):
        ending = "label"
    elif end.isdigit():
        ending = "digit"
    elif _UNSPACED.match(end):
        ending = "unspaced"
    else:
        ending = "lower" if end.islower() else "upper" if end.isupper() else end
    shape = "digits" if word.isdigit() else "name" if word[:1].isupper() else "plain"
    item = bool(_ITEM.match(bare, start)) and not stopped
    long = _bucket(len(words), 2, 4, 5, 7, 10)
    several = len(parts) > 1 or len(bare) > 5 * TAIL and bool(_SENTENCE.search(bare))
    open_quote = bare.count('"') % 2 == 1 or bare.count("“") > bare.count("”")
    open_bracket = bare.count("(") > bare.count(")") or bare.count("[") > bare.count("]")
    before = final[-2].lower() if len(final) > 1 else ""
    first = words[0].lower() if words else ""
    length = _length(bare[:TAIL])
    if length <= SHORT and not (marked or at_limit or open_quote or open_bracket):
        # Features of their own: what ends a long text as a whole one does not end a short one, and the reverse.
        return Features(
            [
                f"short,item={item}",
                f"short={length},end={ending}",
                f"short,first={first},end={ending}",
                f"short={length},first={first},end={ending}",
                f"short,before={before},shape={shape},end={ending}",
                f"short,copies={_bucket(copies, 4, 16)}",
            ],
            [f"short={length},shape={shape},end={ending}", f"short,shape={shape},end={ending}"],
            [] if word.isdigit() else [f"short,word={word.lower()},end={ending}"],
        )
    return Features(
        [
            f"end={ending}",
            f"end={ending},marked={marked},limit={at_limit}",
            f"limit={at_limit}",
            f"marked={marked}",
            f"item={item},end={ending}",
            f"open={open_quote},{open_bracket}",
            f"open={open_quote},{open_bracket},item={item}",
            f"item={item},open={open_quote or open_bracket},marked={marked},limit={at_limit}",
            f"several={several},long={long},end={ending},item={item}",
            f"several={several},words={_bucket(length, 2, 3, 4, 5, 7, 10)},end={ending}",
            f"first={first},several={several},end={ending}",
        ],
        [f"item={item}", f"shape={shape},end={ending}", f"shape={shape},item={item},several={several},long={long}"],
        [f"word={word.lower()}", f"word={word.lower()},item={item}", f"words={before} {word.lower()}"] if ending in ("lower", "upper", "digit") else [],
    )


def _whole(text: str, at_limit: bool) -> bool:
    """Ends as whole texts do, as far as can be told without a model: what the model learns wholeness from."""
    bare, marked = core(text)
    words = _length(bare[:TAIL])
    if marked or at_limit or not words or bare.count('"') % 2 or bare.count("(") > bare.count(")"):
        return False
    tail = bare[-TAIL:]
    if _OPEN_STOP.search(tail):
        return False
    lines = bare.rsplit("\n", 1)
    listed = len(lines) > 1 and bool(_ITEM.match(lines[-1])) and len(_WORD.findall(lines[-1])) <= 4
    return bool(_STOPPED.search(tail) or _CITED.search(tail) or listed or words <= SHORT or bare.endswith('"') or _LABEL.search(tail))


def _cuts(text: str, limits: list[int], n: int) -> list[tuple[str, float]]:
    """The text cut at ``n`` places inside a sentence, fixed by the text's hash, some with what systems leave there.

    With each what it counts: cuts inside a list's item, and those that leave a few words, less.
    """
    out: list[tuple[str, float]] = []
    bare = text.rstrip()
    if bare.rstrip("\"')]").endswith("?") and not _SENTENCE.search(bare):
        return out  # a lone question is given back whole, with or without its mark
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF)
    most = len(text) - 1
    # Every third cut is among the first words, where a random one seldom is.
    early = min(most, next((m.end() for i, m in enumerate(_WORD.finditer(text), 1) if i == SHORT), most))
    fits = [x for x in limits if 2 < x < most]
    for k in range(n):
        at = int(rng.choice(fits)) if fits and k % 3 == 0 else int(rng.integers(1, early + 1)) if k == 2 else int(rng.integers(1, most)) if most > 1 else most
        left, right = text[:at], text[at:]
        bare = left.rstrip()
        if whole_end(bare) or _CITED.search(bare[-TAIL:]) or _LABEL.search(bare[-TAIL:]) or not _WORD.search(right) or not _WORD.search(bare):
            continue
        line = bare[bare.rfind("\n") + 1 :]
        listed = bool(_ITEM.match(line)) and bare.count("(") <= bare.count(")")
        if listed and right[:1] in ("\n", "\r"):
            continue  # a list that ends with a whole item cannot be told from a whole one
        counts = (EARLY_CUT if _length(bare[:TAIL]) <= SHORT else 1.0) * (ITEM_CUT if listed else 1.0)
        roll = int(rng.integers(0, 3 * len(MARKS)))
        out.append((left + (" " if roll % 2 else "") + MARKS[roll] if roll < len(MARKS) and k != 2 else left, counts))
    if n > 1 and rng.random() < 0.2:
        out += _stopped_cuts(text, rng)
    return out


def _stopped_cuts(text: str, rng: np.random.Generator) -> list[tuple[str, float]]:
    """Cuts whose last character is a full stop all the same: after an abbreviation, and inside a decimal number."""
    out = []
    gaps = [m.start() for m in re.finditer(r"(?<=[^\W_]) (?=[^\W_])", text)]
    if len(gaps) > SHORT:
        out.append((f"{text[: gaps[int(rng.integers(SHORT, len(gaps)))]]} {OPEN_ABBREVIATIONS[int(rng.integers(len(OPEN_ABBREVIATIONS)))]}.", 1.0))
    numbers = [m for m in _NUMBER.finditer(text) if len(_WORD.findall(text[: m.start()])) > SHORT]
    if numbers:
        m = numbers[int(rng.integers(len(numbers)))]
        out.append((f"{text[: m.start()]}{m[0][:2]}.", 1.0))
    return out


#: The text without marks and blanks at its end, as far as lengths need it: blanks and marks in its last characters.
_ENDS = r"(?U)(?i)(?:\s|…|\.\.\.+|\x{fffd}|[\[(<](?:…|\.\.\.|truncated|cut|more|continued|eot|eos)[\])>])+$"


def _sizes(text: Column) -> dict[str, Column]:
    """The lengths that a system may limit: of the text and of its bare form, in characters and in bytes."""
    tail = F.right(text, F.lit(TAIL))
    kept = F.regexp_replace(tail, _ENDS, "")
    return {
        "chars": F.length(text),
        "bytes": F.octet_length(text),
        "bare": F.length(text) - F.length(tail) + F.length(kept),
        "bare_bytes": F.octet_length(text) - F.octet_length(tail) + F.octet_length(kept),
    }


def _limits(texts: DataFrame) -> DataFrame:
    """source, unit, length: where the lengths of a source's texts pile up, in characters or in bytes."""
    every = F.explode(F.array(*(F.struct(F.lit(unit).alias("unit"), size.alias("length")) for unit, size in _sizes(F.col("text")).items()))).alias("s")
    counts = texts.select("source", every).select("source", "s.*").where(F.col("length") >= LEAST_LIMIT).groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    offsets = F.explode(F.sequence(F.lit(-NEAR), F.lit(NEAR)))
    near = counts.select("source", "unit", offsets.alias("o"), (F.col("length") + F.col("o")).alias("length"), "n").where("o <> 0").groupBy("source", "unit", "length").agg(F.sum("n").alias("near"))
    piled = counts.join(near, ["source", "unit", "length"], "left")
    return piled.where((F.col("n") >= 12) & (F.col("n") * 2 * NEAR >= PILE * F.coalesce("near", F.lit(0)))).select("source", "unit", "length")


def _with_limits(texts: DataFrame, limits: DataFrame) -> DataFrame:
    """``at_limit``: whether any of a text's lengths is a limit of its source.

    Cut at a limit, then stripped or marked: the bare length is at the limit or up to a blank short of it.
    """
    sizes = _sizes(F.col("text"))
    out = texts.withColumns({f"__{u}": size for u, size in sizes.items()})
    for u in sizes:
        at = limits.where(F.col("unit") == u).select("source", F.col("length").alias(f"__{u}"), F.lit(True).alias(f"__at_{u}"))
        out = out.join(at, ["source", f"__{u}"], "left")
    return out.select(*texts.columns, F.coalesce(*(F.col(f"__at_{u}") for u in sizes), F.lit(False)).alias("at_limit"))


def _map(df: DataFrame, columns: list[str], schema: str, fn) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.select(*columns).mapInArrow(run, schema)


_DESCRIBED = "word string, own int, plain array<string>, by_known array<string>, if_common array<string>"


def _described(texts: list[str], at_limit: list[bool], copies: list[int]) -> list[pa.Array]:
    """The columns of ``_DESCRIBED``."""
    cores = [core(t) for t in texts]
    word = [closing_word(bare) for bare, _ in cores]
    own = [int(_before_end(bare, w)) for (bare, _), w in zip(cores, word)]
    named = [describe(bare, marked, a, c) for (bare, marked), a, c in zip(cores, at_limit, copies)]
    lists = [pa.array([f[i] for f in named], pa.list_(pa.string())) for i in range(3)]
    return [pa.array(word, pa.string()), pa.array(own, pa.int32()), *lists]


def _named(df: DataFrame) -> Column:
    """The features, once ``seen`` (how many texts have the closing word before their end) is known."""
    others = F.greatest(F.coalesce("seen", F.lit(0)) - F.col("own"), F.lit(0))
    known = sum(((others >= edge).cast("int") for edge in (1, 3, 10, 40)), F.lit(0))
    graded = F.transform("by_known", lambda name: F.concat(name, F.lit(",known="), known.cast("string")))
    return F.concat("plain", graded, F.when(known >= 3, F.col("if_common")).otherwise(F.array().cast("array<string>")))


class Cuts(NamedTuple):
    """What a corpus has taught: the model (None if there was nothing to learn from), limits, words (word, seen)."""

    model: LogisticRegressionModel | None
    limits: DataFrame
    words: DataFrame


def fold(df: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """id, source, text, copies: the texts that have a letter or digit, each once per source."""
    rows = df.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return rows.groupBy("source", "text").agg(F.count("*").alias("copies")).select(_text_id().alias("id"), "source", "text", "copies")


def _text_id() -> Column:
    return F.struct(F.xxhash64("source", "text").alias("h"), F.length("text").alias("n"))


def _below(text: Column, share: float) -> Column:
    """About this share of the texts, those of least hash."""
    return F.pmod(F.xxhash64(text, F.lit(11)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def fit_cuts(texts: DataFrame, sample: int = SAMPLE, whole: DataFrame | None = None) -> Cuts:
    """``texts`` as of :func:`fold`, written. ``whole`` (text) has further texts that are known to be whole."""
    limits = written(_limits(texts), "limits")
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit(WORD_IN_SQL), F.lit(0))
    inner = texts.select(words(F.col("text")).alias("w")).select(F.array_distinct(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("w"))
    if whole is not None:
        whole = whole.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("text").distinct()
        inner = inner.unionByName(whole.select(F.array_distinct(words(F.col("text"))).alias("w")))
    vocabulary = written(inner.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("seen")), "vocabulary")
    return Cuts(_fitted(texts, vocabulary, limits, sample, whole), limits, vocabulary)


def score_texts(texts: DataFrame, cuts: Cuts) -> DataFrame:
    """id, copies and the probability that the text was cut."""
    if cuts.model is None:
        return texts.select("id", "copies", F.lit(0.0).alias("score"))
    schema = f"id struct<h: bigint, n: int>, copies bigint, {_DESCRIBED}"

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = _described(*(batch.column(i).to_pylist() for i in (2, 3, 1)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "copies", "word", "own", "plain", "by_known", "if_common"])

    known = written(_map(_with_limits(spread(texts), cuts.limits), ["id", "copies", "text", "at_limit"], schema, read), "described")
    closing = known.groupBy("word").agg(F.count("*").alias("closes"))
    seen = join_hot(known, closing.join(cuts.words, "word", "left"), "word", "closes", known.count())
    hashing = HashingTF(numFeatures=DIMENSIONS, inputCol="features", outputCol="hashed", binary=True)
    named = hashing.transform(seen.select("id", "copies", _named(seen).alias("features")))
    return cuts.model.transform(named).select("id", "copies", vector_to_array("probability")[1].alias("score"))


def score_cuts(df: DataFrame, keys: list[str], text_col: str, source_col: str, sample: int = SAMPLE, whole: DataFrame | None = None, cuts: Cuts | None = None) -> DataFrame:
    """The key columns and ``score``: the probability that the text was cut, for every row.

    ``whole`` (text) has further texts that are known to be whole, for the model to learn from; about ``sample`` at
    most. ``cuts`` is what another table has taught, in place of fitting on this one.
    """
    texts = written(fold(df, text_col, source_col), "texts")
    scored = written(score_texts(texts, cuts or fit_cuts(texts, sample, whole)), "scored")
    rows = df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    rows = rows.select(*(f"__k{i}" for i in range(len(keys))), _text_id().alias("id"))
    out = join_hot(rows, scored, "id", "copies", scored.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    return out.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)), F.coalesce("score", F.lit(0.0)).alias("score"))


def _fitted(texts: DataFrame, vocabulary: DataFrame, limits: DataFrame, sample: int, whole: DataFrame | None) -> LogisticRegressionModel | None:
    """The regression, fitted on whole texts and on their artificial cuts; None if there are none to learn from."""
    n, rows = texts.agg(F.count("*"), F.sum("copies")).first()
    # Texts that recur so often that they are few are all learnt from.
    bounded = _with_limits(spread(texts.where(_below(F.col("text"), sample / max(1, n)) | (F.col("copies") * HOT_SHARE >= (rows or 0)))), limits)
    at = limits.where("unit = 'chars'").groupBy("source").agg(F.collect_set("length").alias("limits"))
    schema = f"label double, counts double, {_DESCRIBED}"
    names = ["label", "counts", "word", "own", "plain", "by_known", "if_common"]

    def labelled(texts: list[str], rows: list[tuple[str, float, bool, float, int]]) -> pa.RecordBatch:
        labels, counts = pa.array([r[1] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())
        return pa.RecordBatch.from_arrays([labels, counts, *_described([r[0] for r in rows], [r[2] for r in rows], [r[4] for r in rows])], names=names)

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[str, float, bool, float, int]] = []
        for text, limit, copies, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            if not _whole(text, limit):
                continue
            rows.append((text, 0.0, False, float(min(copies, MOST_COPIES)), copies))
            limits = sorted(lengths or [])
            rows += [(cut, 1.0, len(cut) in limits or len(core(cut)[0]) in limits, counts, 1) for cut, counts in _cuts(text, limits, 3 if _length(text[:TAIL]) > SHORT else int(_length(text[:TAIL]) > 1))]
        return labelled([r[0] for r in rows], rows)

    def as_whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        # A prompt is given back with its mark or without, and by a label or without.
        rows = [(t, 0.0, False, 1.0 if t == text else CHANGED_PROMPT, 1) for text in batch.column(0).to_pylist() for bare in [text.rstrip(" ?")] for t in {text, bare, f"Question: {bare}"}]
        return labelled([r[0] for r in rows], rows)

    training = _map(bounded.join(F.broadcast(at), "source", "left"), ["text", "at_limit", "copies", "limits"], schema, label)
    if whole is not None:
        others = whole.where(_below(F.col("text"), sample / max(1, whole.count())))
        training = training.unionByName(_map(others, ["text"], schema, as_whole))
    training = written(training, "labelled")
    seen = training.join(vocabulary, "word", "left")
    named = written(seen.select("label", "counts", _named(seen).alias("features")), "training")
    if named.select("label").distinct().count() < 2:
        return None
    vectors = HashingTF(numFeatures=DIMENSIONS, inputCol="features", outputCol="hashed", binary=True).transform(named)
    # Without standardization, which would let a name that only one text has tell that text's label by heart.
    model = LogisticRegression(featuresCol="hashed", labelCol="label", weightCol="counts", standardization=False, maxIter=40, regParam=1e-4, aggregationDepth=2).fit(vectors.coalesce(4))
    # The summary holds the session, which tasks cannot be sent once it has observed anything, and the training table.
    model._java_obj.setSummary(texts.sparkSession._jvm.scala.Option.empty())
    return model


PHASES = {"phase1_gen_sample100": "model", "phase5_grounded_answers_sample100": "mode"}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, ord, answer, source (the model or the mode) and writer (both)."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "ord", "answer", F.col(source).alias("source")) for t, source in PHASES.items()]
    return parts[0].unionByName(parts[1]).withColumn("writer", F.concat_ws("/", "tbl", "source"))


_KNOWN: dict[tuple, Cuts] = {}


def _cuts_of(spark: SparkSession, sf_dir: str, texts: DataFrame) -> Cuts:
    """What all answers of both phases teach, fitted once per application for the same answers and written tables.

    The examples' queries are whole texts, which some answers give back.
    """
    print_of = texts.agg(F.count("*"), F.sum(F.xxhash64("text", "source") % (1 << 40)), F.sum("copies")).first()
    key = (spark.sparkContext.applicationId, generation(), sf_dir, *print_of)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = fit_cuts(texts, whole=table(spark, sf_dir, "examples").select(F.col("query").alias("text")))
    return _KNOWN[key]


def scored_answers(spark: SparkSession, sf_dir: str, keys: list[str], phases: tuple[str, ...] = tuple(PHASES)) -> DataFrame:
    """The scores of the answers of the named tables, by a model of both."""
    rows = answers(spark, sf_dir)
    cuts = _cuts_of(spark, sf_dir, written(fold(rows, "answer", "writer"), "texts"))
    return score_cuts(rows.where(F.col("tbl").isin(*phases)), keys, "answer", "writer", cuts=cuts)


def is_cut(score: Column) -> Column:
    return score >= THRESHOLD


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_answers(spark, sf_dir, ["tbl", "ord"]).where(is_cut(F.col("score"))).select("tbl", "ord")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut answers per model (phase 1) and per mode (phase 5)."""
    scored = scored_answers(spark, sf_dir, ["tbl", "source", "ord"])
    counts = scored.groupBy("tbl", "source").agg(F.count("*").alias("answers"), F.count_if(is_cut(F.col("score"))).alias("cut"))
    return counts.withColumn("share", F.col("cut") / F.col("answers"))


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table and model or mode: the answers, and whether the share of cut ones is that of the rows found."""
    shares = p4_shares(spark, sf_dir)
    rows = answers(spark, sf_dir).select("tbl", "source", "ord").join(p4_found(spark, sf_dir).distinct(), ["tbl", "ord"], "left_semi")
    cut = rows.groupBy("tbl", F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("found"))
    agree = (F.col("cut") == F.coalesce("found", F.lit(0))) & (F.col("share") == F.col("cut") / F.col("answers")) & F.col("share").between(0, 1)
    return shares.withColumn("source", F.coalesce("source", F.lit("none"))).join(cut, ["tbl", "source"], "left").select("tbl", "source", "answers", agree.alias("agree"))


QUERIES = {"p4_found": p4_found, "p4_shares": p4_shares, "p4_agreement": p4_agreement}
ORACLES = {
    "p4_agreement": " UNION ALL ".join(f"SELECT '{t}' AS tbl, coalesce({source}, 'none') AS source, count(*) AS answers, TRUE AS agree FROM {t} GROUP BY ALL" for t, source in PHASES.items()),
}
