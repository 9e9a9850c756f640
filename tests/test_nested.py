import json

import pytest
from pyspark.sql import functions as F

from groundmill.operators.inlining import Names, analyse, records_of, relation_table, shred_column, shred_json
from groundmill.plans import nested

# Fixed values, as in the plans: the same keys for an independent reading.
WRAP = ("row", "data", "example")
LISTS = ("docs", "documents", "passages", "contexts", "ctxs", "retrieved_docs", "references")
TEXT = ("text", "content", "paragraph_text", "passage", "sentence", "sent", "ctx", "context", "wikipedia_text", "wiki_text", "body")
IDS = ("doc_id", "id", "docid", "document_id", "passage_id", "pid", "idx")


def text_of(d):
    for k in TEXT:
        if isinstance(d.get(k), str) and d[k].strip():
            return d[k].strip()
    for k in ("sentences", "sents", "sent", "sentence"):
        if isinstance(d.get(k), list) and " ".join(str(x).strip() for x in d[k] if x).strip():
            return " ".join(str(x).strip() for x in d[k] if x)
    for k in ("document", "doc", "passage", "ctx"):
        if isinstance(d.get(k), dict) and text_of(d[k]):
            return text_of(d[k])
    return ""


def children(text):
    """A plain reading of the statement, apart from the operator."""
    try:
        v = json.loads(text)
        v = json.loads(v) if isinstance(v, str) else v
    except (ValueError, TypeError):
        return
    if not isinstance(v, dict):
        return
    for k in WRAP:
        v = v[k] if isinstance(v.get(k), dict) else v
    for k in LISTS:
        if k in v and v[k] is not None:
            docs = v[k]
            if isinstance(docs, dict) and not text_of(docs):
                docs = next((docs[i] for i in LISTS if isinstance(docs.get(i), list)), [])
            if isinstance(docs, str):
                if docs.strip():
                    yield "doc", "0", ""
                continue
            for i, d in enumerate(docs if isinstance(docs, list) else [docs]):
                if isinstance(d, dict) and text_of(d):
                    yield "doc", str(i), next((str(d[x]).strip() for x in IDS if d.get(x) is not None and str(d[x]).strip()), "")
    for home in (v, v.get("metadata")):
        if isinstance(home, dict):
            for k in ("evidence", "evidence_sentences", "evidence_sets"):
                for i, s in enumerate(home.get(k) or []):
                    for j, e in enumerate(s or []):
                        if e is not None:
                            page = e[2] if isinstance(e, list) else e.get("page") or e.get("title")
                            yield "evidence", f"{i}.{j}", page or ""
            for i, a in enumerate(home.get("annotations") or []):
                for j, p in enumerate((a or {}).get("qa_pairs") or []):
                    if isinstance(p, dict):
                        yield "qa_pair", f"{i}.{j}", p.get("wikipage") or ""


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_found_equals_plain_reading(spark, size):
    d = f"/root/testdata/{size}"
    got = {tuple(r) for r in nested.p1_found(spark, d).collect()}
    want = set()
    for r in spark.read.parquet(f"{d}/raw_examples.parquet").select("rec_id", "payload").collect():
        want |= {("raw_examples", str(r.rec_id), *c) for c in children(r.payload)}
    for r in spark.read.parquet(f"{d}/examples.parquet").select("example_id", "docs", "metadata").collect():
        want |= {("examples", r.example_id, *c) for c in children(r.metadata)}
        want |= {("examples", r.example_id, "doc", str(i), (x.doc_id or "").strip()) for i, x in enumerate(r.docs or []) if x and (x.text or "").strip()}
    for r in spark.read.parquet(f"{d}/mixed_contexts.parquet").select("ord", "contexts").collect():
        want |= {("mixed_contexts", str(r.ord), "context", str(i), (x.label or "").strip().lower()) for i, x in enumerate(r.contexts or []) if x}
    assert got == want and len(want) > 100


def rows(spark, payloads):
    return spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "id bigint, payload string, node string")


def test_plan_names_repeated_shared_and_recursive(spark):
    df = rows(spark, ['{"a": {"x": {"y": 1}}, "b": {"x": {"y": 2}}, "c": [{"d": 1}, null], "t": {"t": {"t": {"v": 1}}}, "one": {"z": {"w": 3}}}'])
    names, plan = analyse(df, "payload")
    assert not names.maps and plan.relations == {"record": "root", "x": "shared", "c": "repeated", "t": "shared+recursive"}


def test_foreign_keys_lead_to_parents_and_singletons_are_inlined(spark):
    doc = {"id": 7, "m": {"o": {"rev": 2}}, "list": [{"v": "a", "list": [{"v": "b"}, 5, {"v": "c"}]}, None, {"v": "d", "tags": ["x", "y"]}]}
    nodes = shred_json(rows(spark, [json.dumps(doc), json.dumps(json.dumps(doc))]), ["id"], "payload").cache()
    assert nodes.where("relation = 'record'").select(F.col("fields")["m.o.rev"]).distinct().collect()[0][0] == "2"
    got = {(r.id, r.node, r.parent_node, r.v, tuple(r.ordinals)) for r in relation_table(nodes, ["id"], "list", ["v", "tags"]).collect()}
    one = {("$.list[0]", "$", "a", (0,)), ("$.list[0].list[0]", "$.list[0]", "b", (0, 0)), ("$.list[0].list[1]", "$.list[0]", None, (0, 1)), ("$.list[0].list[2]", "$.list[0]", "c", (0, 2)), ("$.list[2]", "$", "d", (2,))}
    assert got == {(i, *x) for i in (0, 1) for x in one}
    keys = {(r.id, r.node) for r in nodes.collect()}
    assert all((r.id, r.parent_node) in keys for r in nodes.where("parent_node is not null").collect())


def test_unreadable_null_empty_and_clashing_names(spark):
    df = rows(spark, [None, "", "  ", '{"docs": [', "null", "7", '"text"', "[]", '{"docs": [], "node": {"node": [{"node": 1}]}}'])
    nodes = shred_json(df, ["id"], "payload")
    assert {(r.id, r.relation) for r in nodes.collect()} == {(8, "record"), (8, "node")}
    empty = rows(spark, []).where("id < 0")
    assert shred_json(empty, ["id"], "payload").count() == 0


def test_very_long_and_deep_payloads(spark):
    deep = '{"a":' * 5000 + '{"docs": [{"text": "x"}]}' + "}" * 5000
    listed = '{"docs": ' + "[" * 50_000 + "1" + "]" * 50_000 + "}"
    long = json.dumps({"docs": [{"text": "word " * 200_000, "id": i} for i in range(3)]})
    df = rows(spark, [long, "[" * 100_000, deep, deep[:-1], listed])
    got = {(r.id, r.relation): r.n for r in nested.nodes(df, "id", "payload", None).groupBy("id", "relation").agg(F.count("*").alias("n")).collect()}
    assert got[0, "docs"] == 3 and got[2, "docs"] == 1 and got[2, "record"] == 1 and got[2, "a"] == 5000
    assert {i for i, _ in got} == {0, 2, 4} and got[4, "docs_item"] == 49_998
    inner = [r.parent_node for r in nested.nodes(df, "id", "payload", ["docs"]).where("id = 2").collect()]
    assert len(inner) == 1 and inner[0].startswith("#") and len(inner[0]) < 300


@pytest.mark.parametrize(("text", "want"), [('{"a": [1, {"b": null}, "x\\"]"], "c": {}}', [{"a": [1, {"b": None}, 'x"]'], "c": {}}]), ('[{"a": 1}, "{\\"b\\": 2}", [{"c": 3}], 7, "x"]', [{"a": 1}, {"b": 2}, {"c": 3}]), (json.dumps(json.dumps(json.dumps(json.dumps(json.dumps({"a": 1}))))), [{"a": 1}]), ('{"a": 1,}', []), ("{} {}", []), ("", []), (None, [])])
def test_records_of_a_payload(text, want, monkeypatch):
    assert records_of(text) == want
    # The reader for what is too deep reads the same.
    real = json.loads
    monkeypatch.setattr("groundmill.operators.inlining.json.loads", lambda t: real(t) if t[:1] not in ("{", "[") else (_ for _ in ()).throw(RecursionError))
    assert records_of(text) == want


def test_each_record_of_a_list_has_its_rows(spark):
    df = rows(spark, ['[{"docs": [{"text": "a", "id": 1}]}, {"docs": [{"text": "b", "id": 2}]}]'])
    shredded = nested.nodes(df, "id", "payload")
    assert {(r.child_path, r.item) for r in nested._once(nested._json_children(shredded, "t", "id")).collect()} == {("0", "1"), ("1/0", "2")}
    assert {(r.node, r.record_node) for r in shredded.where("relation = 'docs'").collect()} == {("$[0].docs[0]", "$[0]"), ("$[1].docs[0]", "$[1]")}


@pytest.mark.parametrize(("map_keys", "max_edges"), [(50, 20_000), (1_000, 40)])
def test_keys_that_are_data_are_folded_into_a_map(spark, map_keys, max_edges):
    df = rows(spark, [json.dumps({"by_id": {f"k{i}_{j}": {"v": i, "w": {f"x{i}_{j}": [{"y": j}]}} for j in range(3)}, "one": {"z": {"q": 1}}}) for i in range(40)])
    names, plan = analyse(df, "payload", map_keys=map_keys, max_edges=max_edges)
    assert "by_id" in names.maps and "by_id_entry" in plan.relations and len(plan.relations) < 10
    nodes = shred_json(df, ["id"], "payload", names, plan)
    entries = nodes.where("relation = 'by_id_entry'").select("id", F.col("fields")["@key"].alias("k"), F.col("fields")["v"].alias("v")).where("k like 'k%'").collect()
    assert {(r.id, r.k, r.v) for r in entries} == {(i, f"k{i}_{j}", str(i)) for i in range(40) for j in range(3)}
    assert nodes.select(F.explode("fields").alias("k", "v")).where("k = 'y' and v in ('0', '1', '2')").count() == 120


def test_halves_of_characters_are_replaced(spark):
    df = rows(spark, ['{"docs": [{"text": "a\\ud800b", "\\udfff": {"x": 1}}]}'])
    assert [r.fields["text"] for r in nested.nodes(df, "id", "payload", ["docs"]).collect()] == ["a?b"]


def test_flat_tables_link_to_their_parents(spark, sf):
    counts = {r.relation: (r.n, r.orphans) for r in nested.p1_orphans(spark, sf).collect()}
    assert set(counts) >= {"documents", "qa_pairs", "evidence"} and all(n > 0 and o == 0 for n, o in counts.values())


def test_documents_in_an_object_that_is_none_belong_to_its_record(spark):
    df = rows(spark, ['{"docs": {"docs": [{"text": "a"}]}}', '{"docs": [{"text": "b", "docs": [{"text": "c"}]}, {"docs": [{"text": "d"}]}]}']).withColumnRenamed("id", "rec_id")
    got = {(r.text, r.parent_relation, r.parent_node) for r in nested.documents(nested.nodes(df, "rec_id", "payload")).collect()}
    assert got == {("a", "record", "$"), ("b", "record", "$")}


def test_typed_columns_at_any_depth(spark):
    df = spark.createDataFrame(
        [(1, [(1, [("a", ("x",)), None]), None]), (2, None), (3, [])],
        "id int, l array<struct<n: int, m: array<struct<v: string, s: struct<w: string>>>>>",
    )
    tables = shred_column(df, ["id"], "l")
    assert [tuple(r) for r in tables["l"].collect()] == [(1, [0], 1)]
    assert [tuple(r) for r in tables["l_m"].collect()] == [(1, [0, 0], "a", "x")]


STRAYS = ['{"document": {"v": 1}, "metadata": {"doc": {"v": 1}, "passage": [{"v": 1}]}, "ctx": {"ctx": {"v": 1}}}', '{"text": [{"v": 1}], "id": {"id": {"v": 1}}, "a": {"sents": [{"v": 1}]}, "page": [{"v": 1}], "wikipage": [{"v": 1}]}']
CASES = [
    {"docs": [{"id": "a", "document": {"text": "one"}}, {"doc": {"content": "two"}}, {"passage": {"sents": ["three", "four"]}}, {"ctx": {"body": "five"}}, {"document": {"v": 1}}]},
    {"passages": [{"id": "b", "text": "six"}, {"passage": "seven"}, {"sents": ["eight"]}]},
    {"evidence": [[{"page": "p"}, ["x", "y", "z", 1]]], "annotations": [{"qa_pairs": [{"wikipage": "w"}]}]},
]
LONE = [{"docs": {"id": "c", "text": "nine"}}, {"docs": "ten"}]


@pytest.mark.parametrize("payloads", [[*map(json.dumps, CASES), *STRAYS], [*map(json.dumps, CASES)], [json.dumps(LONE[0])], [json.dumps(LONE[1])], [*map(json.dumps, LONE), *STRAYS]])
def test_children_do_not_depend_on_other_records(spark, payloads):
    df = rows(spark, payloads)
    got = {(r.parent, r.kind, r.child_path, r.item) for r in nested._once(nested._json_children(nested.nodes(df, "id", "payload"), "t", "id")).collect()}
    assert got == {(str(i), *c) for i, p in enumerate(payloads) for c in children(p)} and got
