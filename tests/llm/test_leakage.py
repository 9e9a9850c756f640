import random

import numpy as np
import pytest

from groundmill.llm import leakage
from groundmill.llm.leakage import BlockIndex, find_leaks, plain_words, simhash_windows

random.seed(3)
WORDS = [f"word{i}" for i in range(3000)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS item", "'y' AS doc", "1.0 AS similarity")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS item")
    return {(r.doc_id, r.item_id): (r.similarity, r.exact_windows) for r in find_leaks(d, "doc_id", "text", i, "item_id", "text", **more).collect()}


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = plain_words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs if d is not None for w in [plain_words(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def test_partial_and_whole_passages(spark):
    items = [(i, text(40)) for i in range(30)] + [(99, "too short to count"), (98, None)]
    docs = []
    for d in range(200):
        own = items[d % 30][1].split()
        n = random.choice([0, 5, 11, 12, 13, 25, 40])
        at = random.randint(0, len(own) - n)
        docs.append((d, f"{text(30)} {' '.join(own[at : at + n])} {text(20)}"))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, items[0][1]), (5, docs[5][1])]
    got = leaks(spark, docs, items)
    assert {k for k, v in got.items() if v[1]} == brute(docs, items) and len(brute(docs, items)) > 60
    assert all(v[0] == 1.0 for v in got.values() if v[1])


def test_case_accents_markup_escapes_and_invisible_characters():
    want = "cafe strasse d arc 1 356 readers".split()
    for t in ("Café STRASSE d'Arc 1,356 readers", "café straße, **d** _Arc_ 1 356 <b>readers</b>", "ca­fe⁠ strasse ​d Arc 1 &amp; 356 readers", '{"t": "caf\\u00e9'.replace('{"t": "', "") + "\\nstrasse d Arc\\t1 356 readers"):
        assert plain_words(t) == want


def test_very_long_texts_are_read_to_the_end(spark, monkeypatch):
    item = text(20)
    docs = [(1, f"{text(50_000)} {item}"), (2, " ".join([text(leakage.PIECE - 6), item]))]
    assert set(leaks(spark, docs, [(7, item)])) == {(1, 7), (2, 7)}


def test_slices_of_items_give_the_same(spark):
    items = [(i, text(30)) for i in range(20)]
    docs = [(d, f"{text(5)} {items[d % 20][1]}") for d in range(40)]
    assert leaks(spark, docs, items, slice_windows=100) == leaks(spark, docs, items) and len(leaks(spark, docs, items)) == 40


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, text(20))]) == {} and leaks(spark, [(1, text(20))], []) == {}


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_index_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 2**63, 500, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, radius, replace=False))) for _ in range(200)]
    queries = np.concatenate([prints[:200] ^ np.array(flips, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)])
    q, i = BlockIndex(prints, radius).near(queries)
    distance = np.bitwise_count(queries[:, None] ^ prints[None, :])
    assert set(zip(q.tolist(), i.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))


def test_simhash_is_the_sign_of_weighted_bit_sums():
    rng = np.random.default_rng(1)
    shingles, weights = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(2, 25, 5000).astype(np.int32)
    got = simhash_windows(shingles, weights, 11)
    for at in (0, 17, 4989):
        want = 0
        for b in range(64):
            total = sum(int(w) if int(s) >> b & 1 else -int(w) for s, w in zip(shingles[at : at + 11], weights[at : at + 11]))
            want |= (total > 0) << b
        assert int(got[at]) == want
    assert len(simhash_windows(shingles[:5], weights[:5], 11)) == 0


def test_found_equals_brute_force_on_given_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "text").collect()]
    assert {tuple(r) for r in leakage.p6_found(spark, sf).select("doc_id", "item_id").collect()} == brute(docs, items)


def near_by_brute_force(docs, items, n=12, radius=3, least=0.8):
    """doc, item: a window of each within the radius, of that weighted similarity."""
    from groundmill.llm.leakage import _weights, weighted_similarity
    from groundmill.llm.words import Hasher, runs

    def windows(t):
        w = plain_words(t)
        s, v = runs(Hasher().words(w), 2), _weights(w)
        return [(p, s[k : k + n - 1], v[k : k + n - 1]) for k, p in enumerate(simhash_windows(s, v, n - 1))]

    out = set()
    for i, t in items:
        own = windows(t)
        for d, u in docs:
            if any(bin(int(p) ^ int(q)).count("1") <= radius and weighted_similarity(a, wa, b, wb) >= least for p, a, wa in own for q, b, wb in windows(u)):
                out.add((d, i))
    return out


def test_near_leaks_equal_brute_force(spark):
    items = [(i, text(16)) for i in range(12)]
    docs = []
    for d in range(40):
        own = items[d % 12][1].split()
        at = random.randint(0, 4)
        part = own[at : at + 11] + [text(1)]  # a window but for its last word
        docs.append((d, f"{text(6)} {' '.join(part)} {text(6)}"))
    got = leaks(spark, docs, items, radius=9)
    want = near_by_brute_force(docs, items, radius=9)
    assert set(got) == want and len(want) > 3 and not brute(docs, items)


@pytest.mark.parametrize("slice_windows", [7, 10_000])
def test_slices_give_the_same(spark, slice_windows):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(6)]
    docs = [(d, f"a b c {' '.join(items[d % 6][1].split()[:13])} d e {items[(d + 1) % 6][1]}") for d in range(9)]
    got = leaks(spark, docs, items, slice_windows=slice_windows)
    assert {k: v[1] for k, v in got.items()} == {(d, d % 6): 2 for d in range(9)} | {(d, (d + 1) % 6): 19 for d in range(9)}
