import random
from collections import defaultdict

import pytest

from groundmill.llm import packing
from groundmill.llm.packing import Bins, pack
from groundmill.llm.tokens import RANKS, tokenizer


def packed(spark, rows, capacity, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, article string").selectExpr("*", "1 AS item", "'x' AS n", "2 AS context", "3 AS n_tokens")
    return [r.asDict() for r in pack(df, "doc_id", "text", "article", capacity, **more).collect()]


def words(n, key):
    return " ".join(f"{key} alpha" for _ in range(n))


@pytest.mark.parametrize("group_items", [10, 10_000])
def test_contexts_keep_the_constraints(spark, group_items):
    random.seed(4)
    rows = [(i, words(random.randint(0, 30), f"k{i}"), random.choice(["a", "b", "c", None])) for i in range(150)]
    rows += [(1000 + i, words(9, "same"), f"s{i}") for i in range(40)] + [(2000, words(300, "huge"), "a"), (3000, None, None), (3001, "", "a"), (3002, "\n", None), (7, words(3, "again"), "a"), (7, words(3, "again"), "a")]
    out = packed(spark, rows, 64, group_items=group_items)
    size = tokenizer(RANKS).size
    used, kinds, pieces = defaultdict(int), defaultdict(list), defaultdict(list)
    texts = dict((i, t) for i, t, _ in rows)
    for r in out:
        n = r["token_end"] - r["token_start"]
        assert r["n_tokens"] == size(texts[r["doc_id"]] or "") or r["doc_id"] == 7
        if r["context"] is None:
            assert n == 0
        else:
            used[r["context"]] += n
            kinds[r["context"]].append((texts[r["doc_id"]], r["piece"] if r["n_tokens"] > 64 else 0))
        pieces[r["doc_id"]].append((r["piece"], r["token_start"], r["token_end"]))
    assert max(used.values()) <= 64
    assert all(len(k) == len(set(k)) for k in kinds.values()), "two texts of a duplicate cluster share a context"
    huge = sorted(pieces[2000])
    assert [a for _, a, _ in huge][1:] == [b for _, _, b in huge][:-1] and all(b - a == 64 for _, a, b in huge[:-1]) and len(huge) > 5
    split = {r["doc_id"] for r in out if r["n_tokens"] > 64}
    assert all((len(p) == 1) != (i in split) for i, p in pieces.items() if i != 7) and len(pieces[7]) == 3
    assert {r["doc_id"] for r in out} == set(texts)


def test_little_room_is_left(spark):
    random.seed(5)
    rows = [(i, words(random.randint(1, 60), f"k{i}"), f"a{i % 50}") for i in range(600)]
    out = packed(spark, rows, 256)
    total = sum(r["token_end"] - r["token_start"] for r in out)
    assert len({r["context"] for r in out}) <= 1.02 * total / 256 + 1


@pytest.mark.parametrize("size", [(2, 12), (20, 60)])
def test_a_source_in_a_third_of_the_rows_needs_a_context_each_and_no_more(spark, size):
    rows = [(i, words(random.randint(*size), f"k{i}"), "hot" if i % 3 == 0 else f"a{i}") for i in range(300)]
    out = packed(spark, rows, 256)
    least = max(100, sum(r["token_end"] - r["token_start"] for r in out) / 256)
    assert least <= len({r["context"] for r in out}) <= 1.04 * least + 1
    hot = [r["context"] for r in out if r["doc_id"] % 3 == 0]
    assert len(hot) == len(set(hot))


def test_contexts_depend_on_the_rows_alone(spark):
    rows = [(i % 140, words(i % 11, f"k{i % 140 % 90}"), f"a{i % 7}") for i in range(150)]
    schema = "doc_id bigint, text string, article string"
    first, second = (spark.createDataFrame(r, schema).repartition(n) for r, n in ((rows, 1), (rows[::-1], 7)))
    got = [sorted((tuple(r) for r in pack(d, "doc_id", "text", "article", 64).select("doc_id", "piece", "context", "n_tokens").collect()), key=repr) for d in (first, second)]
    assert got[0] == got[1] and len(got[0]) >= 150


def test_conflicts_are_seen(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 1, 6), ("y", 1, 6), ("y", None, 7), (None, 1, 6), ("z", 2, 8), ("z", 3, 8)], "context string, source bigint, cluster bigint")
    assert {tuple(r) for r in packing.conflicts(df).collect()} == {("x", "source", 1, 2), ("z", "cluster", 8, 2)}


def test_a_cluster_in_a_third_of_the_rows_needs_a_context_each_and_no_more(spark):
    rows = [(i, words(4, "same") if i % 3 == 0 else words(random.randint(2, 12), f"k{i}"), None) for i in range(600)]
    out = packed(spark, rows, 128)
    assert 200 <= len({r["context"] for r in out}) <= 206


def test_named_clusters_are_kept_apart(spark):
    rows = [(i, words(3, f"k{i}"), None) for i in range(20)]
    clusters = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, cluster bigint")
    out = {r["doc_id"]: r["context"] for r in packed(spark, rows, 512, clusters=clusters)}
    assert out[0] != out[2] and out[1] != out[3]


def test_empty_table_and_bad_capacity(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, article string")
    assert pack(df, "doc_id", "text", "article", 8).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "text", "article", 0)


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = Bins(10)
    assert [bins.put(6, "a"), bins.put(7, "b"), bins.put(9)] == [0, 1, 2]
    assert bins.put(3, "b") == 0  # bin 1 has just 3 left, but the same cluster
    assert bins.put(3, "c") == 1
    assert bins.put(1, "a") == 2 and bins.put(1, "a") == 3  # bin 0 has 1 left, but the same cluster
    apart = Bins(10)
    assert apart.put(5, None, "s") == 0 and apart.put(5, None, "s") == 1 and apart.put(5, None, "t") == 0


def test_near_clusters(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, base), (2, base + " more"), (3, "something else " * 9), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.cluster for r in packing.near_clusters(df, "doc_id", "text").collect()}
    assert set(got) == {1, 2} and got[1] == got[2]
