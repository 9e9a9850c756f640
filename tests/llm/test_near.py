import random

import numpy as np
import pytest

from groundmill.llm import near
from groundmill.llm.words import WORD, Hasher, mix, runs, segment_minima

random.seed(11)
VOCABULARY = [f"w{i}" for i in range(4000)]


def text(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def edited(t, n):
    words = t.split()
    for _ in range(n):
        i = random.randrange(len(words))
        words[i : i + random.randint(0, 1)] = [random.choice(VOCABULARY)]
    return " ".join(words)


def shingles(t, k):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, least):
    out = set()
    for n, (s, i, t) in enumerate(rows):
        for r, j, u in rows[n + 1 :]:
            if s == r and i is not None and j is not None and i != j and t and u:
                a, b = shingles(t, k), shingles(u, k)
                if a and b and len(a & b) / len(a | b) >= least:
                    out.add((s, *sorted((i, j))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "tbl string, id string, body string").withColumnsRenamed({}).selectExpr("*", "1 AS cls", "2 AS signature", "'x' AS scope")


def pairs(spark, rows, k=3, least=0.6):
    found = near.near_links(frame(spark, rows), "id", "body", "tbl", words=k, similarity=least)
    return {tuple(r) for r in near.linked_ids(found).collect()}


def test_pairs_equal_brute_force(spark):
    rows = []
    for f in range(60):
        base = text(random.randint(20, 80))
        rows += [("ab"[f % 2], f"f{f}-{i}", base if i == 0 else edited(base, random.choice([0, 1, 3, 6, 12]))) for i in range(5)]
    # A run of words that many texts share must neither hide nor make pairs.
    common = text(12)
    rows += [("a", f"c{i}", f"{text(25)} {common} {text(25)}") for i in range(120)]
    assert pairs(spark, rows) == brute(rows, 3, 0.6)


def test_nulls_blanks_short_texts_copies_and_case(spark):
    long = text(40)
    rows = [("a", None, long), ("a", "n", None), ("a", "b", " \n"), ("a", "s", "two words"), ("a", "t", "two words"), ("a", "x", long), ("a", "x", long), ("a", "y", long.upper().replace(" ", " ; ")), ("b", "z", long), ("a", "m", text(40)), ("a", "m", edited(long, 1)), ("a", "v", " ".join([long] * 400))]
    assert pairs(spark, rows) == {("a", "x", "y"), ("a", "m", "x"), ("a", "m", "y"), ("a", "v", "x"), ("a", "v", "y"), ("a", "m", "v")} & brute(rows, 3, 0.6) == brute(rows, 3, 0.6)


def test_empty_table(spark):
    df = frame(spark, []).where("false")
    found = near.near_links(df, "id", "body", "tbl")
    assert near.linked_ids(found).count() == 0 and near.near_groups(found).count() == 0


def test_a_text_in_a_third_of_the_rows_is_one_class(spark):
    base = text(50)
    rows = [("a", f"h{i:04}", base) for i in range(300)] + [("a", f"o{i}", text(50)) for i in range(300)] + [("a", "e", edited(base, 1))]
    found = near.near_links(frame(spark, rows), "id", "body", "tbl", words=5, similarity=0.8)
    assert found.links.count() == 1
    groups = {r.id: r for r in near.near_groups(found).collect()}
    assert len(groups) == 601 and {groups[i].group_size for _, i, _ in rows if i[0] in "he"} == {301}
    assert groups["e"].group_id == "e" and groups["h0000"].group_id == "e" and groups["h0000"].n_copies == 299 and groups["h0000"].n_links == 1
    assert groups["o5"].group_size == 1


def test_blocks_give_each_pair_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(50)], "k int, i int")
    for blocks in (1, 4, 7):
        got = [tuple(r) for r in near.pairs_within(df, ["k"], "i", F.lit(blocks)).select("k", "i_a", "i_b").collect()]
        assert len(got) == len(set(got)) == 2 * 50 * 49 // 2 and all(a < b for _, a, b in got)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "cls_a bigint, cls_b bigint")
    assert {r.root for r in near.components(links).collect()} == {0, 900}


def test_threshold_leaves_few_unseen():
    m = near.match_threshold(24, 0.36, 0.003)
    assert m == 3 and np.mean(np.random.default_rng(0).binomial(24, 0.36, 100_000) < m) < 0.004


def test_hashes():
    h = Hasher()
    a = runs(h.words("a b c d e".split()), 3)
    assert len(a) == 3 and (a == runs(h.words("a b c d e".split()), 3)).all() and a[0] != runs(h.words("c b a".split()), 3)[0]
    assert len(set(mix(np.arange(1000, dtype=np.uint64)).tolist())) == 1000
    assert segment_minima(np.array([5, 3, 9, 1], dtype=np.uint64), np.array([0, 2]), np.array([2, 4])).tolist() == [3, 1]


def test_found_on_given_tables_equals_brute_force(spark, sf):
    got = {tuple(r) for r in near.p3_found(spark, sf).collect()}
    rows = []
    for tbl, key in (("passages", "passage_id"), ("candidate_docs", "doc_id")):
        rows += [(tbl, r[0], r[1]) for r in spark.read.parquet(f"{sf}/{tbl}.parquet").select(key, "text").distinct().collect()]
    assert got == brute(rows, 3, 0.6) and got


@pytest.mark.parametrize("units", ["words", "chars"])
def test_units(spark, units):
    df = spark.createDataFrame([("p", "the context says nothing of this"), ("q", "the context says nothing of that"), ("r", "an entirely different kind of clause")], "id string, body string")
    found = near.near_links(df, "id", "body", words=1 if units == "words" else 5, similarity=0.6, units=units)
    assert {tuple(r)[1:] for r in near.linked_ids(found).collect()} == {("p", "q")}


def test_every_long_list_is_split(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 20)
    monkeypatch.setattr(near, "COMMON_LIMIT", 1)
    postings = spark.createDataFrame([(k, i) for k in range(3) for i in range(10 + 25 * k)], "posting bigint, cls bigint")
    assert {(r.posting, r.blocks) for r in near._with_blocks(postings).collect()} == {(0, 1), (1, 2), (2, 3)}


def test_lists_in_a_third_of_the_texts_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 10)
    monkeypatch.setattr(near, "COMMON_FROM", 10_000)  # nothing is skipped
    rng = random.Random(6)
    shared = " ".join(f"boiler{i}" for i in range(30))
    texts = [(i, f"{shared} {rng.randint(0, 9**9)} end") for i in range(60)] + [(100 + i, " ".join(str(rng.randint(0, 9**9)) for _ in range(30))) for i in range(120)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    links = near.near_links(df, "id", "text", words=3, similarity=0.8)
    assert links.links.count() == 60 * 59 // 2
