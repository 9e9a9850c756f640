"""Keys that much of the rows have, and forms that the given tables do not show."""

import json
import math

import pytest
from pyspark.sql import functions as F

from groundmill import session
from groundmill.operators import contexts, ingest, mixing, reports, retrieval
from groundmill.sources import jsonl


def test_a_term_in_most_documents_is_dealt_over_parts(spark):
    docs = spark.createDataFrame([(f"d{i:03}", f"the word{i % 7} {'extra ' * (i % 3)}") for i in range(200)], "id string, text string")
    queries = spark.createDataFrame([(q, f"the word{q}") for q in range(5)], "q int, text string")
    index = retrieval.build_index(docs, "id", "text")
    whole, parts = (retrieval.search(index, queries, "q", "text", top=9, block=b) for b in (10**6, 16))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() == 45


def test_an_edited_corpus_gets_a_new_index(spark, tmp_path):
    first = spark.createDataFrame([("a", "one two"), ("b", "three four"), ("c", None), ("d", "...")], "id string, text string")
    edited = spark.createDataFrame([("a", "one five"), ("b", "three four")], "id string, text string")
    path = str(tmp_path / "index")
    retrieval.ensure_index(first, "id", "text", path)
    assert {r.term for r in retrieval.ensure_index(first, "id", "text", path).terms.collect()} == {"one", "two", "three", "four"}
    assert {r.term for r in retrieval.ensure_index(edited, "id", "text", path).terms.collect()} == {"one", "five", "three", "four"}


def test_documents_in_a_third_of_the_contexts_are_hydrated_like_others(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"d{i % 5}" if i % 7 else None, "own", f"t{i}") for i in range(90)], "i int, doc_id string, title string, text string")
    lookup = spark.createDataFrame([("hot", "H", "hot text"), ("d1", None, None), ("d2", "two", "text two")], "doc_id string, title string, text string")
    got = {r.i: (r.title, r.text, r.missing_doc) for r in contexts.hydrate(rows, lookup).collect()}
    known = {"hot": ("H", "hot text", False), "d1": ("", "", False), "d2": ("two", "text two", False)}
    assert got == {r.i: known.get(r.doc_id, ("own", r.text, True)) for r in rows.collect()}


def test_a_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


@pytest.mark.parametrize(("profile", "k", "want"), [("clean", 12, (8, 3, 0, 1)), ("clean", 6, (4, 2, 0, 0)), ("mixed", 6, (3, 2, 1, 0)), ("toxic", 6, (2, 2, 2, 0)), ("clean", 5, None), ("toxic", 1, None), ("mixed", 0, (0, 0, 0, 0)), ("toxic", 30, None)])
def test_recipes_add_up(profile, k, want):
    got = contexts.scaled_recipe(profile, k)
    assert sum(got.values()) == k and min(got.values()) >= 0
    assert want is None or tuple(got[x] for x in ("support", "decoy", "conflict", "irrelevant")) == want


def raw(spark, payloads, dataset="mirror/alce-data"):
    return spark.createDataFrame([(i, dataset, "dev", json.dumps(p) if p is not None else None) for i, p in enumerate(payloads)], "id bigint, d string, s string, payload string")


def test_questions_in_the_metadata(spark):
    payloads = [{"metadata": {"title": "T"}}, {"metadata": {"query": {"value": "V"}}}, {"question": " ", "metadata": {"question": "n/a", "prompt": "P"}}, {"metadata": {"question": {"x": 1}, "input": {"input": "I"}}}, {"metadata": 3}, {"question": "Q", "metadata": {"question": "M"}}]
    got = raw(spark, payloads).select("id", ingest.question_of(ingest.parsed(F.col("payload")), ["question", "query"]).alias("q")).collect()
    assert [r.q for r in sorted(got)] == ["T", "V", "P", "I", None, "Q"]


def test_answers_of_any_form(spark):
    payloads = [{"gold_answer": " a "}, {"answers": ["x", {"text": "y"}, {"text": "n/a"}, 5, " ", "x"]}, {"gold_answers": None, "answers": [], "output": "o"}, {"answer": "none"}, {}]
    got = raw(spark, payloads).select("id", ingest.answers_of(ingest.parsed(F.col("payload"))).alias("a")).collect()
    assert [r.a for r in sorted(got)] == [["a"], ["x", "y"], ["o"], [], []]


def test_adapters_give_documents_citations_and_evidence_and_know_their_datasets(spark):
    alce = raw(spark, [{"question": "q", "docs": [{"id": 3, "title": "t", "text": "x"}, {"document": {"text": "in"}}, {"sents": ["a", "b"]}, {"title": "none"}, "lone"], "citation": "[1]", "id": "r"}, None])
    out = ingest.examples_of(alce, "id", "d", "s", "payload").collect()
    assert len(out) == 1 and [tuple(d) for d in out[0].docs] == [("3", "t", "x"), (None, None, "in"), (None, None, "a b")]
    assert (out[0].citations, out[0].record_id, out[0].evidence) == ("[1]", "r", None)
    fever = ingest.examples_of(raw(spark, [{"claim": "c", "evidence": [[["a", "b", "page", 1]]]}], "mirror/fever"), "id", "d", "s", "payload").first()
    assert json.loads(fever.evidence) == [[["a", "b", "page", 1]]] and fever.docs == []
    other = raw(spark, [{"question": "q"}], "mirror/other")
    assert ingest.examples_of(other, "id", "d", "s", "payload", unknown="skip").count() == 0
    with pytest.raises(Exception, match="unknown dataset: mirror/other"):
        ingest.examples_of(other, "id", "d", "s", "payload").collect()


def test_samples_with_pairs_at_the_top(spark):
    payloads = [{"question": "q", "qa_pairs": [{"short_answers": ["a", "b"]}, {"short_answers": ["a"]}]}, {"question": "q", "annotations": [{"long_answer": "", "qa_pairs": [{"short_answers": ["c"]}]}], "qa_pairs": [{"short_answers": ["d"]}]}]
    got = {r.id: (r.answers, r.n_pairs) for r in ingest.asqa_samples(raw(spark, payloads), "id", "s", "payload").collect()}
    assert got == {0: (["a", "b"], 2), 1: (["c"], 1)}


def test_claims_for_mixing_and_their_limit(spark):
    df = spark.createDataFrame([("b", "q", ["x", None, "y"], None), ("a", "q", [], ["z"]), ("c", "why", None, None), ("d", " ", None, None), (None, "q", ["x"], None)], "id string, q string, c array<string>, a array<string>")
    args = ("id", "q", "c", "a")
    assert {(r.claim_id, r.claim_text) for r in mixing.claims_for_mixing(df, *args).collect()} == {("b::c0", "x"), ("b::c1", "y"), ("a::c0", "z"), ("c::c0", "why")}
    assert {r.qid for r in mixing.claims_for_mixing(df, *args, max_rows=2).collect()} == {"a", "b"}


def test_documents_without_an_id_go_by_their_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a", "text": "one"}\n\n{"text": "two"}\nnot json\n{"text": " "}\n{"text": "three"}\n')
    assert {(r.doc_id, r.text) for r in jsonl.scan_documents(spark, str(tmp_path / "x.jsonl")).collect()} == {("a", "one"), ("1", "two"), ("4", "three")}


def test_report_row(spark):
    scores = {p: spark.createDataFrame([(i, lab) for i in ids for lab in labels], "id string, label string") for p, ids, labels in (("phase3", "ab", ["support", "conflict"]), ("phase4", "bc", ["support"]))}
    row = reports.report_row(reports.phase_rows(scores), reports.shared_phase_rows(scores), "t").first()
    assert row.shared_ids == 1 and row.phases["phase3"].ids == 2 and row.phases["phase3"].with_conflict == 2 and row.phases["phase4"].support_macro == 1.0


def test_backfill_draws_differ_by_position(spark):
    claims = spark.createDataFrame([(f"c{i}",) for i in range(30)], "claim_id string")
    none = spark.createDataFrame([], "claim_id string")
    for size in (60, 4):
        pool = spark.createDataFrame([(f"d{i}", i) for i in range(size)], "doc_id string, ordinal int")
        rows = contexts.backfill(claims, none, pool, size, 6, 42).collect()
        by = {}
        for r in rows:
            by.setdefault(r.claim_id, []).append(int(r.doc_id[1:]))
        assert len(rows) == 180 and (size < 6 or all(len(set(v)) == 6 for v in by.values()))
        assert size < 6 or len({tuple(b - a for a, b in zip(v, v[1:])) for v in map(sorted, by.values())}) > 20


def shuffled_rows(df):
    """Rows that the shuffles of the collected ``df`` wrote."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        elif name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(f"d{i:03}", f"the word{i % 7}") for i in range(300)], "id string, text string")
    queries = spark.createDataFrame([(q, f"the word{q % 7}") for q in range(100)], "q int, text string")
    hits = retrieval.search(retrieval.build_index(docs, "id", "text"), queries, "q", "text", top=3)
    assert len(hits.collect()) == 300
    assert 0 < shuffled_rows(hits) < 5_000  # of 30 000 pairs


def test_search_equals_a_plain_loop(spark):
    texts = {f"d{i}": " ".join(f"t{(i * j) % 9}" for j in range(1 + i % 5)) for i in range(80)} | {"blank": " ", "none": None}
    asked = [(q, f"t{q} T{q + 1} t{(q * q) % 9} zzz") for q in range(9)] + [(10, "zzz"), (11, None), (None, "t3")]
    split = {d: t.split() for d, t in texts.items() if t and t.strip()}
    average, want = sum(map(len, split.values())) / len(split), set()
    for q, text in asked:
        scores = {}
        for term in set((text or "").lower().split()):
            df = sum(term in words for words in split.values())
            for d, words in split.items():
                if tf := words.count(term):
                    scores[d] = scores.get(d, 0) + math.log((len(split) - df + 0.5) / (df + 0.5) + 1) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(words) / average))
        best = sorted((-round(s, 6), d) for d, s in scores.items())[:7]
        want |= {(q, d, -s, i) for i, (s, d) in enumerate(best, 1)}
    index = retrieval.build_index(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text")
    queries = spark.createDataFrame(asked, "q int, text string")
    for block, most in ((10**6, 10**6), (20, 10**6), (10**6, 5), (20, 5)):
        assert {tuple(r) for r in retrieval.search(index, queries, "q", "text", top=7, block=block, asked=most).select("query_id", "doc_id", "score", "rank").collect()} == want
