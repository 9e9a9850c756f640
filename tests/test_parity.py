import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from groundmill.operators import chunking, claims, contexts, ingest, reports, retrieval
from groundmill.plans import nested, parity
from groundmill.sources import jsonl

SQL = {**parity.ORACLES, **nested.ORACLES}
ALL = {**parity.QUERIES, **nested.QUERIES}


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = ALL[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    result = duck.execute(SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert rows == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_scans_read_whole_tables(spark, sf):
    plan = parity.bm25_topn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<passage_id:string,text:string>" in plan


@pytest.mark.parametrize(("size", "overlap"), [(3, 0), (3, 1), (5, 4), (1, 0)])
def test_windows_equal_a_plain_loop(spark, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(13)] + [None, "", "  \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunking.token_windows(df, "text", size, overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.chunk)
    for i, text in enumerate(texts):
        words, want, at = (text or "").split(), [], 0
        while words:
            want.append(" ".join(words[at : at + size]))
            if at + size >= len(words):
                break
            at += size - overlap
        assert got.get(i, []) == want
    with pytest.raises(ValueError):
        chunking.token_windows(df, "text", 3, 3)


def test_labels_of_each_kind(spark):
    claim = "Marie Curie discovered radium in 1898."
    texts = {
        "In 1898 Marie Curie discovered radium.": "support",
        "Marie Curie did not discover radium; Pierre discovered it.": "conflict",
        "Another view: Marie Curie discovered radium.": "conflict",
        "Marie Curie discovered radium in 1902.": "conflict",
        "someone discovered radium here": "decoy",
        "Paris in spring": "irrelevant",
        "": "irrelevant",
    }
    df = spark.createDataFrame([(claim, t) for t in texts], "c string, t string")
    assert {r.t: r.l for r in df.select("t", contexts.label(F.col("c"), F.col("t")).alias("l")).collect()} == texts


def test_recipes_and_schedules():
    table = {1: ((1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 1)), 5: ((4, 1, 0, 0), (2, 2, 1, 0), (1, 2, 2, 0)), 8: ((5, 2, 0, 1), (3, 3, 1, 1), (2, 3, 3, 0)), 12: ((8, 3, 0, 1), (5, 4, 2, 1), (3, 4, 4, 1))}
    for k, rows in table.items():
        assert tuple(tuple(contexts.scaled_recipe(p, k).values()) for p in ("clean", "mixed", "toxic")) == rows
    assert contexts.parse_schedule("clean:1, toxic:3,mixed:0") == [("clean", 0.25), ("toxic", 0.75)]
    for bad in ("", "clean:0", "odd:1"):
        with pytest.raises(ValueError):
            contexts.parse_schedule(bad)


def test_every_claim_with_candidates_gets_k_contexts(spark):
    rows = [(f"q::c{n}", f"d{i}", i, ("support", "decoy", "conflict", "irrelevant")[i % 4], "mixed") for n in range(1, 30) for i in range(n)]
    df = spark.createDataFrame(rows, "claim_id string, doc_id string, rank int, label string, mix_profile string")
    out = contexts.select_contexts(df, 6, 7)
    assert {r["count"] for r in out.groupBy("claim_id").count().collect()} == {6}
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in contexts.select_contexts(df.repartition(7), 6, 7).collect()}
    assert contexts.select_contexts(df.where("false"), 6, 7).count() == 0


def test_claims_keep_order_and_drop_short_ones(spark):
    df = spark.createDataFrame([(1, "Short one. This one is long enough! And this one too?   Yes. "), (2, None), (3, "")], "id int, a string")
    got = [(r.id, r.claim_id, r.claim) for r in claims.answer_claims(df, ["id"], "a").collect()]
    assert got == [(1, 0, "This one is long enough!"), (1, 1, "And this one too?")]


def test_last_row_wins_even_if_null(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("b", 1, "y")], "id string, ord int, v string")
    assert {tuple(r) for r in claims.last_wins(df, ["id"], "ord").collect()} == {("a", 2, None), ("b", 1, "y")}


def test_ties_of_logits_go_to_support_then_conflict(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 1.0, 1.0), (0.0, 0.0, 1.0)], "e double, c double, n double")
    assert [r.label for r in claims.softmax_label(df).collect()] == ["support", "conflict", "irrelevant"]


def test_published_classification_example(spark):
    pairs = [("support", "support"), ("support", "decoy"), ("decoy", "decoy"), ("conflict", "support"), ("conflict", "conflict")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    assert reports.classification_metrics(df).first().asDict() == {"n": 5, "csp": 0.5, "ucr": 1.0, "fcr": 0.5, "scc": 0.4, "frr": 0.5, "cdr": 0.2}
    assert reports.classification_metrics(df.where("false")).first().asDict() == dict.fromkeys(("n", "csp", "ucr", "fcr", "scc", "frr", "cdr"), 0)
    with pytest.raises(Exception, match="unknown label"):
        reports.classification_metrics(spark.createDataFrame([("odd", "support")], "label string, prediction string")).collect()


def test_apportionment(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1), ("c", 0)], "k string, n int")
    got = {(r.k, r.label): r.n for r in reports.apportion(df, "k", "n", {"support": 0.5, "decoy": 0.3, "conflict": 0.2}).collect()}
    assert [got["a", x] for x in reports.CLASSES] == [5, 3, 2] and [got["b", x] for x in reports.CLASSES] == [1, 0, 0]
    even = {(r.k, r.label): r.n for r in reports.apportion(df, "k", "n", dict.fromkeys(reports.CLASSES, 1.0)).collect()}
    assert [even["b", x] for x in reports.CLASSES] == [1, 0, 0] and sum(even["a", x] for x in reports.CLASSES) == 10
    with pytest.raises(ValueError):
        reports.apportion(df, "k", "n", {"support": 1.0})


def test_bm25_finds_the_right_animal(spark):
    docs = spark.createDataFrame([("d1", "Cats are small domesticated animals."), ("d2", "Dogs bark."), ("d3", "Birds fly."), ("d4", None), ("d5", "!!!")], "id string, text string")
    index = retrieval.build_index(docs, "id", "text")
    hits = retrieval.search(index, spark.createDataFrame([(1, "cats domesticated"), (2, "zebra"), (3, None)], "q int, t string"), "q", "t", top=2).collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in hits] == [(1, "d1", 1)]
    assert index.stats.first().docs == 3


def test_jsonl_scans_and_sinks(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"doc_id": "a", "title": "T", "text": "x y"}\n\n  \n[1]\n{"doc_id": 0, "text": "z"}\n{"id": "b", "text": " "}\n')
    assert jsonl.scan_tolerant(spark, path).count() == 3 and jsonl.scan_strict(spark, path).count() == 4 and jsonl.scan_objects(spark, path).count() == 3
    kept, seen = jsonl.scan_counted(spark, path)
    assert {tuple(r) for r in kept.collect()} == {("a", "T", "x y"), ("0", "", "z")} and seen.get == {"kept": 2, "skipped": 2}
    with open(path, "a") as f:
        f.write("{broken\n")
    assert jsonl.scan_tolerant(spark, path).count() == 3
    with pytest.raises(Exception):
        jsonl.scan_strict(spark, path).collect()
    out = str(tmp_path / "out")
    jsonl.write_jsonl(kept, out)
    with pytest.raises(Exception):
        jsonl.write_jsonl(kept, out, overwrite=False)
    assert jsonl.scan_documents(spark, out).count() == 2


def test_run_ids():
    a = jsonl.run_id({"k": 1, "j": 2}, ["x"])
    assert a == jsonl.run_id({"j": 2, "k": 1}, ["x"]) != jsonl.run_id({"j": 2, "k": 1}, ["y"]) and re.fullmatch("[0-9a-f]{64}", a)
    assert jsonl.output_path("d", "s", "r") == "d/s_r.json"


def test_adapters(spark):
    rows = [
        (1, "mirror/alce-data", "train", '{"question": "q?", "answer": "a"}'),
        (2, "mirror/asqa", "dev", '"{\\"query\\": \\"q\\", \\"long_answer\\": null, \\"answer\\": \\"x\\"}"'),
        (3, "mirror/qampari", "dev", '{"row": {"question": "q", "targets": ["a", null, "b"]}}'),
        (4, "mirror/fever", "dev", '{"claim": "c", "label": "SUPPORTS"}'),
        (5, "other", "dev", '{"claim": "c"}'),
        (6, "mirror/fever", "dev", "{"),
        (7, "mirror/qampari", None, '{"query": "", "answers": "one"}'),
    ]
    df = spark.createDataFrame(rows, "rec_id int, dataset_id string, split string, payload string")
    got = {r.id: (r.query, r.gold_answer, r.gold_claims, r.label) for r in ingest.examples_of(df, "rec_id", "dataset_id", "split", "payload", unknown="skip").collect()}
    assert got == {1: ("q?", "a", None, None), 2: ("q", None, None, None), 3: ("q", None, ["a", "b"], None), 4: ("c", None, None, "SUPPORTS"), 7: ("", None, ["one"], None)}


def test_samples(spark):
    rows = [
        (1, "dev", '{"ambiguous_question": "N/A", "question": " q ", "annotations": [{"long_answer": "L"}, {"long_answer": "L"}, {"long_answer": "none"}]}'),
        (2, "dev", '{"question": "q", "metadata": {"annotations": [{"qa_pairs": [{"short_answers": ["s", "?"]}, {}]}]}}'),
        (3, "dev", '{"question": "q"}'),
        (4, "dev", '{"question": "??", "answer": "a", "annotations": [{"long_answer": "L"}]}'),
        (5, "dev", '{"instruction": "i", "output": "o"}'),
    ]
    df = spark.createDataFrame(rows, "rec_id int, split string, payload string")
    assert {(r.id, r.question, tuple(r.answers)) for r in ingest.asqa_samples(df, "rec_id", "split", "payload").collect()} == {(1, "q", ("L",)), (2, "q", ("s",))}
    assert {(r.qid, r.question, r.answer) for r in ingest.alce_samples(df, "rec_id", "split", "payload").collect()} == {("alce_dev_000005", "i", "o")}


def test_articles_metadata_and_claims(spark):
    df = spark.createDataFrame([('{"page_id": 7, "name": " N ", "page": {"content": "deep"}}',), ('{"id": 0, "title": "", "text": "flat", "page": {"text": "x"}}',), ("{}",)], "p string")
    parts = ingest.article_of(F.try_parse_json("p"))
    assert [tuple(r) for r in df.select(*(c.alias(k) for k, c in parts.items())).collect()] == [("7", "N", "deep"), (None, None, "flat"), (None, None, None)]
    maps = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"b": "3"}), (None, None)], "x map<string,string>, y map<string,string>")
    merged = maps.select(ingest.merged_metadata(F.col("x"), F.col("y"), True).alias("t"), ingest.merged_metadata(F.col("x"), F.col("y"), False).alias("f")).collect()
    assert [(r.t, r.f) for r in merged] == [({"a": "1", "b": "3"}, {"a": "1", "b": "2"}), ({"b": "3"}, {"b": "3"}), ({}, {})]
    rows = spark.createDataFrame([(["c", None], ["a"], "q"), ([None], ["a"], "q"), (None, [], "q"), (None, None, " ")], "c array<string>, a array<string>, q string")
    assert [r.x for r in rows.select(ingest.claims_of(F.col("c"), F.col("a"), F.col("q")).alias("x")).collect()] == [["c"], ["a"], ["q"], None]


def test_claims_without_hits_are_backfilled_whole(spark):
    from groundmill.operators.mixing import mix_contexts

    corpus = spark.createDataFrame([(f"d{i}", f"T{i}", f"Marie Curie discovered radium, note {i}") for i in range(30)], "doc_id string, title string, text string")
    asked = spark.createDataFrame([("q1::c0", "Marie Curie discovered radium."), ("q2::c0", "zzz"), ("q3::c0", "")], "claim_id string, claim_text string")
    out = mix_contexts(asked, corpus, k=6).collect()
    by = {}
    for r in out:
        by.setdefault(r.claim_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"q1::c0": 6, "q2::c0": 6, "q3::c0": 6}
    assert {r.drawn for r in by["q2::c0"]} == {"backfill"} and {r.label for r in by["q3::c0"]} == {"irrelevant"} and all(r.text and r.title for r in out)
