import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from groundmill import session
from groundmill.llm import truncation
from groundmill.llm.truncation import core, describe, score_cuts, whole_end

NAMES = ["Varno", "Ostelin", "Brekka", "Tollund", "Mirave", "Quenby", "Harrow", "Selkirk", "Lindow", "Arden"]
NOUNS = ["bridge", "museum", "harbour", "library", "tunnel", "orchestra", "market", "archive"]
VERBS = ["opened", "moved", "described", "restored", "financed", "painted"]


def sentence(rng):
    return f"In {rng.randint(1700, 2010)}, the {rng.choice(NOUNS)} of {rng.choice(NAMES)} was {rng.choice(VERBS)} by {rng.choice(NAMES)} {rng.choice(NAMES)} near the {rng.choice(NOUNS)}."


def whole(rng):
    kind = rng.randint(0, 9)
    if kind == 0:
        return f"{rng.choice(NAMES)} {rng.choice(NAMES)}"
    if kind == 1:
        return str(rng.randint(1700, 2010))
    if kind == 2:
        return "These are:\n" + "\n".join(f"- {rng.choice(NAMES)} ({rng.choice(NOUNS)})" for _ in range(rng.randint(2, 4)))
    return " ".join(sentence(rng) for _ in range(rng.randint(1, 6))) + (" [1]" if kind == 3 else "")


def cut_off(rng):
    while True:
        text = " ".join(sentence(rng) for _ in range(rng.randint(2, 6)))
        n = 180 if rng.random() < 0.5 else rng.randint(30, len(text) - 5)
        out = text[:n]
        if not re.search(r"[.]\s*$", out) and len(text) > n:
            return out + rng.choice(["", "", "", "…", " [truncated]", "�", "\n"])


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    rows = [(i, "t", cut_off(rng), True) if i % 6 == 0 else (i, "t", whole(rng), False) for i in range(1500)]
    df = spark.createDataFrame(rows, "ord bigint, tbl string, answer string, truth boolean").withColumns({"score": F.lit("x"), "source": F.lit("y"), "text": F.lit("z"), "features": F.lit(0)})
    got = {r.ord: r.score >= 0.5 for r in score_cuts(df, ["ord"], "answer", "tbl").collect()}
    truth = {r[0]: r[3] for r in rows}
    right = sum(got[i] and t for i, t in truth.items())
    assert right / sum(truth.values()) >= 0.95 and right / max(1, sum(got.values())) >= 0.95
    assert len(got) == len(rows)


def test_nulls_blanks_marks_and_repeated_rows(spark):
    rng = random.Random(9)
    rows = [(i, whole(rng)) for i in range(300)] + [(i, x) for i, x in enumerate([None, "", "  ", "...", "-", "​", "[]"], 1000)] + [(2000, cut_off(rng))] * 3
    df = spark.createDataFrame(rows, "ord bigint, answer string").withColumn("tbl", F.lit(None).cast("string"))
    out = score_cuts(df, ["ord"], "answer", "tbl").collect()
    assert len(out) == len(rows) and all(r.score == 0 for r in out if 1000 <= r.ord < 2000)
    assert len({r.score for r in out if r.ord == 2000}) == 1


def test_empty_table_and_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "ord bigint, answer string, tbl string")
    assert score_cuts(df, ["ord"], "answer", "tbl").count() == 0
    one = spark.createDataFrame([(1, "yes", "t")], "ord bigint, answer string, tbl string")
    assert [r.score for r in score_cuts(one, ["ord"], "answer", "tbl").collect()] == [0.0]


@pytest.mark.parametrize(("text", "bare", "marked"), [("so the […]", "so the", True), ("so the… (more)", "so the", True), ("so the�", "so the", True), ("whole. [2][3]", "whole. [2][3]", False), ("whole.\n", "whole.", False), ("a (built in 1800)", "a (built in 1800)", False)])
def test_marks_of_a_cut(text, bare, marked):
    assert core(text) == (bare, marked)


def test_lengths_that_pile_up_are_limits(spark):
    rng = random.Random(10)
    rows = [("s", whole(rng) + " " + "x" * rng.randint(60, 400)) for _ in range(800)] + [("s", (whole(rng) + " " + "word " * 99)[:300]) for _ in range(60)]
    found = {(r.unit, r.length) for r in truncation._limits(spark.createDataFrame(rows, "source string, text string").distinct()).collect()}
    assert ("chars", 300) in found and len(found) < 8


def test_features_of_long_text_are_few():
    assert sum(map(len, describe(*core("word " * 200_000), False))) < 20


def test_shares_add_up(spark, sf):
    rows = truncation.p4_shares(spark, sf).collect()
    assert sum(r.answers for r in rows) == sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("phase1_gen_sample100", "phase5_grounded_answers_sample100"))
    assert all(0 <= r.share <= 1 and r.cut <= r.answers for r in rows) and {r.tbl for r in rows} == {"phase1_gen_sample100", "phase5_grounded_answers_sample100"}


def test_cuts_among_the_first_words_and_in_scripts_without_blanks(spark):
    rng = random.Random(11)
    japanese = [f"{rng.choice(NAMES)}は{rng.choice(NAMES)}川のほとりにあり、{rng.randint(1700, 2010)}年に設立されました。" for _ in range(60)]
    short = [f"The {rng.choice(NOUNS)}" + rng.choice(["", "."]) for _ in range(60)] + [f"{a} {b}" for a in NAMES for b in NAMES]
    wholes = [whole(rng) for _ in range(600)] + japanese + short
    cuts = ["In 1843, the brid", "In 1901, the orches", "VarnoはOstelin川のほとりにあ", "QuenbyはArden川のほとりにあり、1851年に設立"]
    df = spark.createDataFrame([(i, "t", x) for i, x in enumerate([*cuts, *wholes])], "ord bigint, tbl string, answer string")
    got = {r.ord: r.score >= 0.5 for r in score_cuts(df, ["ord"], "answer", "tbl").collect()}
    assert all(got[i] for i in range(len(cuts)))
    assert sum(got[i] for i in range(len(cuts), len(got))) <= len(wholes) // 50


@pytest.mark.parametrize(("text", "whole"), [("It was led by Dr.", False), ("sold to the house of St.", False), ("at 10 a.", False), ("signed by Ann, i.e.", False), ("It is run by Works Inc.", True), ("It opened at 10 a.m.", True), ("in 1843.", True), ("She said “no.”", True)])
def test_full_stops_that_end_no_sentence(text, whole):
    assert whole_end(text) == whole


def test_closing_words_and_texts_in_a_third_of_the_rows(spark):
    rng = random.Random(12)
    rows = [(i, "I don't know." if i % 3 == 0 else whole(rng) if i % 5 else cut_off(rng)) for i in range(900)]
    df = spark.createDataFrame(rows, "ord bigint, answer string").withColumn("tbl", F.lit("t"))
    out = {r.ord: r.score for r in score_cuts(df, ["ord"], "answer", "tbl").collect()}
    assert len(out) == len(rows) and len({out[i] for i in range(0, 900, 3)}) == 1 and out[0] < 0.5


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_SHARE", 3)
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(100)] + [(200, None)], "i int, k string")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"), F.lit(None).cast("int").alias("none")).where("k <> 'k0'")
    got = session.join_hot(left, right, "k", "n", left.count())
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, left.join(right.drop("n"), "k", "left").select("i", "k", "least", "none").collect()), key=repr)


def test_what_one_table_teaches_serves_another(spark):
    rng = random.Random(13)
    texts = truncation.fold(spark.createDataFrame([("t", whole(rng)) for _ in range(400)], "s string, a string"), "a", "s")
    cuts = truncation.fit_cuts(truncation.written(texts, "t"))
    other = spark.createDataFrame([(1, "t", "In 1843, the museum of Varno was opened by Qu"), (2, "t", "In 1843, the museum of Varno was opened by Arden Lindow near the bridge.")], "ord int, s string, a string")
    assert {r.ord: r.score > 0.5 for r in score_cuts(other, ["ord"], "a", "s", cuts=cuts).collect()} == {1: True, 2: False}


def test_a_session_that_has_observed_something_scores_texts(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    rng = random.Random(14)
    texts = truncation.written(truncation.fold(spark.createDataFrame([("t", whole(rng)) for _ in range(400)], "s string, a string"), "a", "s"), "t")
    cuts = truncation.fit_cuts(texts)
    assert not cuts.model.hasSummary
    assert truncation.written(truncation.score_texts(texts, cuts), "scored").count() == texts.count()
