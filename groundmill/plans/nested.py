"""Problem 1: the flat tables of raw_examples, examples and mixed_contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.functions.text import WS, strip
from groundmill.operators.inlining import Names, analyse, shred_column, shred_json
from groundmill.session import table, written

# The keys under which records and documents are known to carry their parts.
DOC_LIST_KEYS = ("docs", "documents", "passages", "contexts", "ctxs", "retrieved_docs", "references")
TEXT_KEYS = ("text", "content", "paragraph_text", "passage", "sentence", "sent", "ctx", "context", "wikipedia_text", "wiki_text", "body")
NESTED_TEXT_KEYS = ("document", "doc", "passage", "ctx")
SENTENCE_LIST_KEYS = ("sentences", "sents", "sent", "sentence")
TITLE_KEYS = ("title", "source", "article_title", "wiki_title", "doc_title")
ID_KEYS = ("doc_id", "id", "docid", "document_id", "passage_id", "pid", "idx")
EVIDENCE_KEYS = ("evidence", "evidence_sentences", "evidence_sets")
RECORD_ID_KEYS = ("id", "example_id")
QUESTION_KEYS = ("ambiguous_question", "question", "query", "claim", "prompt", "instruction", "input")

NAMES = Names(aliases=dict.fromkeys(DOC_LIST_KEYS, "docs") | dict.fromkeys(EVIDENCE_KEYS, "evidence"), transparent=frozenset({"row", "data", "example"}), copied=frozenset(NESTED_TEXT_KEYS))
CHILDREN = ["docs", "evidence_item", "qa_pairs"]
RELATIONS = ["record", "docs", "annotations", "qa_pairs", "knowledge", "evidence", "evidence_item"]


def _filled(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def _first(*values: Column) -> Column:
    return F.coalesce(*values)


def _field(*keys: str) -> Column:
    """The first of the fields that is not blank."""
    found = F.transform(F.array(*map(F.lit, keys)), lambda k: _filled(F.try_element_at("fields", k)))
    return F.get(F.filter(found, lambda x: x.isNotNull()), 0)


def document_text() -> Column:
    """A document's text: under a text key, one object deeper, or as a list of sentences; null if there is none.

    A list under a text key starts with a bracket only if it was one. Such text is joined if it is a list of sentences,
    and taken as it is under the other text keys.
    """
    places = [(home + k, k in SENTENCE_LIST_KEYS, k in TEXT_KEYS) for home in ("", *(f"{k}." for k in NESTED_TEXT_KEYS)) for k in (*(t for t in TEXT_KEYS if t not in SENTENCE_LIST_KEYS), *SENTENCE_LIST_KEYS)]

    def read(place: Column) -> Column:
        raw = F.try_element_at("fields", place["key"])
        items = F.filter(F.transform(F.from_json(raw, "array<string>"), strip), lambda x: x != "")
        listed = F.when(place["sentences"] & F.ltrim(raw).startswith("["), F.array_join(items, " "))
        return _filled(F.coalesce(listed, F.when(place["text"], raw)))

    found = F.transform(F.array(*(F.struct(F.lit(key).alias("key"), F.lit(listed).alias("sentences"), F.lit(text).alias("text")) for key, listed, text in places)), read)
    return F.get(F.filter(found, lambda x: x.isNotNull()), 0)


def document_id() -> Column:
    return _field(*ID_KEYS)


def nodes(df: DataFrame, key: str, payload: str, relations: list[str] | None = RELATIONS) -> DataFrame:
    names, plan = analyse(df, payload, NAMES, always=RELATIONS)
    return shred_json(df, [key], payload, names, plan, relations)


def _places() -> Column:
    return F.when(F.size("ordinals") == 0, F.lit("0")).otherwise(F.array_join(F.col("ordinals").cast("array<string>"), "."))


def _child_path() -> Column:
    """The places from the outermost list inwards; before them, in a payload of several records, that of a later record."""
    return F.concat(F.coalesce(F.concat(F.nullif(F.regexp_extract("record_node", r"\[(\d*[1-9]\d*)\]$", 1), F.lit("")), F.lit("/")), F.lit("")), _places())


def _is_document() -> Column:
    kind, alone = F.col("kind"), F.size("ordinals") == 0
    return (F.size("ordinals") <= 1) & (((kind == "object") & document_text().isNotNull()) | ((kind == "scalar") & alone & _filled(F.col("fields").getItem("")).isNotNull()))


def _json_children(shredded: DataFrame, tbl: str, key: str) -> DataFrame:
    """The children of interest in one pass over the nodes."""
    relation, kind, fields = F.col("relation"), F.col("kind"), F.col("fields")
    is_doc = (relation == "docs") & _is_document()
    is_entry = (relation == "evidence_item") & (F.size("ordinals") == 2)
    is_pair = (relation == "qa_pairs") & (kind == "object") & (F.size("ordinals") == 2)
    page = F.when(kind == "list", F.from_json(fields.getItem(""), "array<string>").getItem(2)).when(kind == "object", _field("page", "title"))
    what = F.when(is_doc, F.lit("doc")).when(is_entry, F.lit("evidence")).when(is_pair, F.lit("qa_pair"))
    item = F.when(is_doc & (kind == "object"), document_id()).when(is_entry, page).when(is_pair, fields.getItem("wikipage"))
    out = shredded.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("parent"), what.alias("kind"), _child_path().alias("child_path"), F.coalesce(strip(item), F.lit("")).alias("item"))
    return out.where(F.col("kind").isNotNull())


def _once(children: DataFrame) -> DataFrame:
    """Repeated parents give their children once."""
    return children.groupBy("tbl", "parent", "kind", "child_path").agg(F.max("item").alias("item"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, examples, mixed = (table(spark, sf_dir, t) for t in ("raw_examples", "examples", "mixed_contexts"))
    path = F.array_join(F.col("ordinals").cast("array<string>"), ".").alias("child_path")
    typed_docs = shred_column(examples.where("example_id is not null"), ["example_id"], "docs")["docs"]
    typed_docs = typed_docs.where(_filled(F.col("text")).isNotNull()).select(F.lit("examples").alias("tbl"), F.col("example_id").alias("parent"), F.lit("doc").alias("kind"), path, F.coalesce(strip(F.col("doc_id")), F.lit("")).alias("item"))
    contexts = shred_column(mixed, ["ord"], "contexts")["contexts"]
    contexts = contexts.select(F.lit("mixed_contexts").alias("tbl"), F.col("ord").cast("string").alias("parent"), F.lit("context").alias("kind"), path, clean_label(F.col("label")).alias("item"))
    parts = [
        _once(_json_children(nodes(raw.where("rec_id is not null"), "rec_id", "payload", CHILDREN), "raw_examples", "rec_id")),
        _once(_json_children(nodes(examples.where("example_id is not null"), "example_id", "metadata", CHILDREN), "examples", "example_id").unionByName(typed_docs)),
        contexts,
    ]
    return reduce(DataFrame.unionByName, parts)


def clean_label(label: Column) -> Column:
    return F.coalesce(F.lower(strip(label)), F.lit(""))


def _raw(spark: SparkSession, sf_dir: str, *relations: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "raw_examples"), "rec_id", "payload", list(relations)).where(F.col("rec_id").isNotNull())


def _part(rows: DataFrame, **columns: Column) -> DataFrame:
    """A flat table: the key, the node, its parent's, and the named columns."""
    return rows.select("rec_id", "node", "parent_relation", "parent_node", _child_path().alias("child_path"), *(c.alias(n) for n, c in columns.items()))


def records(shredded: DataFrame) -> DataFrame:
    return shredded.where("relation = 'record'").select("rec_id", "node", _field(*RECORD_ID_KEYS).alias("id"), _field(*QUESTION_KEYS).alias("question"), _field("label").alias("label"))


def documents(shredded: DataFrame) -> DataFrame:
    """A document in a list that stands inside another object has that object's record as parent, unless the object is a
    document itself."""
    kept = shredded.where((F.col("relation") == "docs") & _is_document())
    text = F.when(F.col("kind") == "scalar", _filled(F.col("fields").getItem(""))).otherwise(document_text())
    flat = kept.select("record_node", *_part(kept).columns[:4], _child_path().alias("child_path"), document_id().alias("doc_id"), _field(*TITLE_KEYS).alias("title"), text.alias("text"))
    # Only lists in lists have documents as parents, so few rows look for one.
    top, inner = flat.where("parent_relation <> 'docs'"), flat.where("parent_relation = 'docs'")
    parents = kept.select("rec_id", F.col("node").alias("parent_node"), F.lit(True).alias("__held"))
    inner = inner.join(parents, ["rec_id", "parent_node"], "left")
    inner = inner.withColumn("parent_relation", F.when(F.col("__held"), F.col("parent_relation")).otherwise("record")).withColumn("parent_node", F.when(F.col("__held"), F.col("parent_node")).otherwise(F.col("record_node")))
    return top.drop("record_node").unionByName(inner.drop("record_node", "__held"))


def annotations(shredded: DataFrame) -> DataFrame:
    return _part(shredded.where("relation = 'annotations'"), long_answer=_field("long_answer"))


def qa_pairs(shredded: DataFrame) -> DataFrame:
    return _part(shredded.where("relation = 'qa_pairs' and kind = 'object'"), **{k: F.col("fields").getItem(k) for k in ("question", "short_answers", "wikipage", "context")})


def knowledge(shredded: DataFrame) -> DataFrame:
    return _part(shredded.where("relation = 'knowledge' and kind = 'object'"), **{k: F.col("fields").getItem(k) for k in ("content", "wikipage")})


def evidence_sets(shredded: DataFrame) -> DataFrame:
    return _part(shredded.where("relation = 'evidence'"))


def evidence(shredded: DataFrame) -> DataFrame:
    values, fields = F.from_json(F.col("fields").getItem(""), "array<string>"), F.col("fields")
    pick = lambda i, *keys: _first(values.getItem(i), *(fields.getItem(k) for k in keys))
    return _part(shredded.where("relation = 'evidence_item'"), annotation_id=pick(0, "annotation_id"), page=pick(2, "page", "title"), line=pick(3, "line"))


#: The flat tables of the raw records: the relations each is made of, and how.
FLAT = {"records": (records, "record"), "documents": (documents, "docs"), "annotations": (annotations, "annotations"), "qa_pairs": (qa_pairs, "qa_pairs"), "knowledge": (knowledge, "knowledge"), "evidence_sets": (evidence_sets, "evidence"), "evidence": (evidence, "evidence_item")}


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the raw records: the parents of documents, annotations and evidence sets."""
    return records(_raw(spark, sf_dir, "record"))


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the documents of the raw records, each with its record."""
    return documents(_raw(spark, sf_dir, "docs"))


def p1_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the annotations of the raw records: the parents of question-answer pairs and knowledge."""
    return annotations(_raw(spark, sf_dir, "annotations"))


def p1_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the question-answer pairs of the raw records, each with its annotation."""
    return qa_pairs(_raw(spark, sf_dir, "qa_pairs"))


def p1_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the knowledge of annotations, each with its annotation."""
    return knowledge(_raw(spark, sf_dir, "knowledge"))


def p1_evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the evidence sets of the raw records: the parents of evidence entries."""
    return evidence_sets(_raw(spark, sf_dir, "evidence"))


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the evidence entries of the raw records, each with its set."""
    return evidence(_raw(spark, sf_dir, "evidence_item"))


def p1_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By flat table: its rows, and those whose parent is in none of the tables."""
    shredded = written(_raw(spark, sf_dir, *RELATIONS), "nodes")
    tables = {name: make(shredded) for name, (make, _) in FLAT.items()}
    held = reduce(DataFrame.unionByName, [t.select("rec_id", "node") for t in tables.values()])
    links = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("relation"), "rec_id", F.col("parent_node").alias("node")) for n, t in tables.items() if n != "records"])
    met = links.join(held.distinct().withColumn("held", F.lit(True)), ["rec_id", "node"], "left")
    return met.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("held").isNull()).alias("orphans"))


def p1_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat table of the mixed contexts with a clean label, each with its row."""
    contexts = shred_column(table(spark, sf_dir, "mixed_contexts"), ["ord"], "contexts")["contexts"]
    return contexts.select("ord", F.element_at("ordinals", -1).alias("pos"), "doc_id", "title", "text", clean_label(F.col("label")).alias("label"), "rank", "metadata_backfill", "metadata_backfill_reason", "metadata_missing_doc")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_documents, p1_annotations, p1_qa_pairs, p1_knowledge, p1_evidence_sets, p1_evidence, p1_contexts, p1_orphans)}


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _filled_sql(x: str) -> str:
    return f"nullif({_strip_sql(x)}, '')"


def _first_sql(parts: list[str]) -> str:
    return f"coalesce({', '.join(parts)})"


def _text_at(d: str, path: str) -> str:
    return f"CASE WHEN json_type({d}, '{path}') = 'VARCHAR' THEN {_filled_sql(f"json_extract_string({d}, '{path}')")} END"


def _list_at(d: str, path: str) -> str:
    return f"CASE WHEN json_type({d}, '{path}') = 'ARRAY' THEN {_filled_sql(f"array_to_string(list_filter(list_transform(json_extract_string({d}, '{path}[*]'), lambda x: {_strip_sql('x')}), lambda x: x <> ''), ' ')")} END"


def _document_text_sql(d: str) -> str:
    homes = ["$", *(f"$.{k}" for k in NESTED_TEXT_KEYS)]
    return _first_sql([x for h in homes for x in (*(_text_at(d, f"{h}.{k}") for k in TEXT_KEYS), *(_list_at(d, f"{h}.{k}") for k in SENTENCE_LIST_KEYS))])


def _records_sql(source: str, key: str, payload: str) -> str:
    """k, v, w: the readable records, unwrapped, and the path to them."""
    wrapped = [(w, f"json_type(v, '$.{w}') = 'OBJECT'") for w in ("row", "data", "example")]
    inner, path = " ".join(f"WHEN {c} THEN json_extract(v, '$.{w}')" for w, c in wrapped), " ".join(f"WHEN {c} THEN '$.{w}'" for w, c in wrapped)
    return f"""(SELECT k, CASE {inner} ELSE v END AS v, CASE {path} ELSE '$' END AS w FROM (SELECT k, CASE WHEN json_type(p) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(p, '$')) THEN json_extract_string(p, '$')::JSON END ELSE p END AS v
  FROM (SELECT DISTINCT CAST({key} AS VARCHAR) AS k, CASE WHEN json_valid({payload}) THEN {payload}::JSON END AS p FROM {source} WHERE {key} IS NOT NULL)) WHERE json_type(v) = 'OBJECT')"""


def _items_sql(source: str, keep: str, value: str, i: str, x: str) -> str:
    """One row per element of a JSON array: its place and the element."""
    return f"(SELECT {keep}, {i}, json_extract({value}, '$[' || {i} || ']') AS {x} FROM (SELECT *, unnest(range(CAST(json_array_length({value}) AS BIGINT))) AS {i} FROM {source} WHERE json_type({value}) = 'ARRAY'))"


def _children_sql(tbl: str, records: str) -> str:
    held = _first_sql([f"CASE WHEN json_type(v, '$.{k}') <> 'NULL' THEN json_extract(v, '$.{k}') END" for k in DOC_LIST_KEYS])
    inner = _first_sql([f"CASE WHEN json_type(x, '$.{k}') = 'ARRAY' THEN json_extract(x, '$.{k}') END" for k in DOC_LIST_KEYS])
    docs = f"(SELECT k, CASE WHEN json_type(x) = 'OBJECT' THEN coalesce({inner}, json_array(x)) ELSE x END AS l, x FROM (SELECT k, {held} AS x FROM {records}))"
    ids = _first_sql([*(_filled_sql(f"json_extract_string(d, '$.{k}')") for k in ID_KEYS), "''"])
    homes = lambda keys: " UNION ALL ".join(f"SELECT k, json_extract(v, '{h}.{key}') AS l FROM {records}" for h in ("$", "$.metadata") for key in keys)
    entries = _items_sql(_items_sql(f"({homes(EVIDENCE_KEYS)})", "k", "l", "i", "s"), "k, i", "s", "j", "e")
    page = f"CASE json_type(e) WHEN 'ARRAY' THEN json_extract_string(e, '$[2]') WHEN 'OBJECT' THEN {_first_sql([_filled_sql(f"json_extract_string(e, '$.{k}')") for k in ('page', 'title')])} END"
    pairs = _items_sql(f"(SELECT k, i, json_extract(a, '$.qa_pairs') AS q FROM {_items_sql(f'({homes(("annotations",))})', 'k', 'l', 'i', 'a')})", "k, i", "q", "j", "p")
    return f"""SELECT '{tbl}' AS tbl, k AS parent, 'doc' AS kind, CAST(i AS VARCHAR) AS child_path, {ids} AS item FROM {_items_sql(docs, 'k', 'l', 'i', 'd')} WHERE json_type(d) = 'OBJECT' AND {_document_text_sql('d')} IS NOT NULL
UNION ALL SELECT '{tbl}', k, 'doc', '0', '' FROM {docs} WHERE json_type(x) = 'VARCHAR' AND {_filled_sql("json_extract_string(x, '$')")} IS NOT NULL
UNION ALL SELECT '{tbl}', k, 'evidence', i || '.' || j, coalesce({_strip_sql(page)}, '') FROM {entries} WHERE json_type(e) <> 'NULL'
UNION ALL SELECT '{tbl}', k, 'qa_pair', i || '.' || j, coalesce({_strip_sql("json_extract_string(p, '$.wikipage')")}, '') FROM {pairs} WHERE json_type(p) = 'OBJECT'"""


_RAW = _records_sql("raw_examples", "rec_id", "payload")
_K = "CAST(k AS BIGINT) AS rec_id"


def _string(d: str, key: str) -> str:
    return _filled_sql(f"json_extract_string({d}, '$.{key}')")


def _homes_sql(keys: tuple[str, ...]) -> str:
    """k, l, p: the lists under the keys, at the top of a record or in its metadata, and the path to each."""
    return "(" + " UNION ALL ".join(f"SELECT k, json_extract(v, '{h}.{key}') AS l, w || '{h[1:]}.{key}' AS p FROM {_RAW}" for h in ("$", "$.metadata") for key in keys) + ")"


_ANNOTATIONS_SQL = f"(SELECT k, i, a, p || '[' || i || ']' AS node FROM {_items_sql(_homes_sql(('annotations',)), 'k, p', 'l', 'i', 'a')} WHERE json_type(a) <> 'NULL')"
_SETS_SQL = f"(SELECT k, i, s, p || '[' || i || ']' AS node FROM {_items_sql(_homes_sql(EVIDENCE_KEYS), 'k, p', 'l', 'i', 's')} WHERE json_type(s) <> 'NULL')"
_ENTRIES_SQL = f"(SELECT k, i, j, e, node AS parent_node, node || '[' || j || ']' AS node FROM {_items_sql(_SETS_SQL, 'k, i, node', 's', 'j', 'e')} WHERE json_type(e) <> 'NULL')"


def _of_annotations(key: str) -> str:
    return f"(SELECT k, i, j, x, node AS parent_node, node || '.{key}[' || j || ']' AS node FROM {_items_sql(f'(SELECT *, json_extract(a, ' + repr(f'$.{key}') + f') AS l FROM {_ANNOTATIONS_SQL})', 'k, i, node', 'l', 'j', 'x')} WHERE json_type(x) = 'OBJECT')"


def _documents_of_sql() -> str:
    key = "CASE " + " ".join(f"WHEN json_type(v, '$.{k}') <> 'NULL' THEN '{k}'" for k in DOC_LIST_KEYS) + " END"
    inner = "CASE " + " ".join(f"WHEN json_type(x, '$.{k}') = 'ARRAY' THEN '{k}'" for k in DOC_LIST_KEYS) + " END"
    held = f"(SELECT k, w || '.' || y AS p, json_extract(v, '$.' || y) AS x, w FROM (SELECT *, {key} AS y FROM {_RAW}) WHERE y IS NOT NULL)"
    listed = f"(SELECT k, p, x AS l FROM {held} WHERE json_type(x) = 'ARRAY' UNION ALL SELECT k, p || '.' || z, json_extract(x, '$.' || z) FROM (SELECT *, {inner} AS z FROM {held} WHERE json_type(x) = 'OBJECT') WHERE z IS NOT NULL)"
    every = f"""SELECT k, p || '[' || i || ']' AS node, CAST(i AS VARCHAR) AS child_path, d FROM {_items_sql(listed, 'k, p', 'l', 'i', 'd')} WHERE json_type(d) = 'OBJECT'
UNION ALL SELECT k, p, '0', x FROM {held} WHERE json_type(x) = 'OBJECT' OR json_type(x) = 'VARCHAR'"""
    text = f"CASE WHEN json_type(d) = 'VARCHAR' THEN {_filled_sql("json_extract_string(d, '$')")} ELSE {_document_text_sql('d')} END"
    title, doc_id = (_first_sql([_string("d", k) for k in keys]) for keys in (TITLE_KEYS, ID_KEYS))
    return f"(SELECT {_K}, node, 'record' AS parent_relation, '$' AS parent_node, child_path, {doc_id} AS doc_id, {title} AS title, {text} AS text FROM ({every}) WHERE {text} IS NOT NULL)"


_AT = "json_extract_string(e, '$.{}')"
_PICK = lambda i, *keys: f"CASE json_type(e) WHEN 'ARRAY' THEN json_extract_string(e, '$[{i}]') ELSE {_first_sql([_AT.format(k) for k in keys])} END"
_TABLES_SQL = {
    "records": f"SELECT {_K}, '$' AS node, {_first_sql([_string('v', k) for k in RECORD_ID_KEYS])} AS id, {_first_sql([_string('v', k) for k in QUESTION_KEYS])} AS question, {_string('v', 'label')} AS label FROM {_RAW}",
    "documents": f"SELECT * FROM {_documents_of_sql()}",
    "annotations": f"SELECT {_K}, node, 'record' AS parent_relation, '$' AS parent_node, CAST(i AS VARCHAR) AS child_path, {_string('a', 'long_answer')} AS long_answer FROM {_ANNOTATIONS_SQL}",
    "qa_pairs": f"""SELECT {_K}, node, 'annotations' AS parent_relation, parent_node, i || '.' || j AS child_path, json_extract_string(x, '$.question') AS question, replace(CAST(json_extract(x, '$.short_answers') AS VARCHAR), '","', '", "') AS short_answers,
 json_extract_string(x, '$.wikipage') AS wikipage, json_extract_string(x, '$.context') AS context FROM {_of_annotations('qa_pairs')}""",
    "knowledge": f"SELECT {_K}, node, 'annotations' AS parent_relation, parent_node, i || '.' || j AS child_path, json_extract_string(x, '$.content') AS content, json_extract_string(x, '$.wikipage') AS wikipage FROM {_of_annotations('knowledge')}",
    "evidence_sets": f"SELECT {_K}, node, 'record' AS parent_relation, '$' AS parent_node, CAST(i AS VARCHAR) AS child_path FROM {_SETS_SQL}",
    "evidence": f"SELECT {_K}, node, 'evidence' AS parent_relation, parent_node, i || '.' || j AS child_path, {_PICK(0, 'annotation_id')} AS annotation_id, {_PICK(2, 'page', 'title')} AS page, {_PICK(3, 'line')} AS line FROM {_ENTRIES_SQL}",
}
_CONTEXTS_SQL = "(SELECT ord, i, contexts[i] AS c FROM (SELECT ord, contexts, unnest(range(1, len(contexts) + 1)) AS i FROM mixed_contexts))"
ORACLES = {f"p1_{name}": sql for name, sql in _TABLES_SQL.items()} | {
    "p1_orphans": " UNION ALL ".join(f"SELECT '{name}' AS relation, count(*) AS n, CAST(0 AS BIGINT) AS orphans FROM ({sql}) HAVING count(*) > 0" for name, sql in _TABLES_SQL.items() if name != "records"),
    "p1_contexts": f"""SELECT ord, CAST(i - 1 AS INTEGER) AS pos, c.doc_id AS doc_id, c.title AS title, c.text AS text, coalesce(lower({_strip_sql('c.label')}), '') AS label, c.rank AS rank,
       c.metadata.backfill AS metadata_backfill, c.metadata.backfill_reason AS metadata_backfill_reason, c.metadata.missing_doc AS metadata_missing_doc FROM {_CONTEXTS_SQL} WHERE c IS NOT NULL""",
    "p1_found": f"""{_children_sql('raw_examples', _records_sql('raw_examples', 'rec_id', 'payload'))}
UNION ALL SELECT DISTINCT * FROM ({_children_sql('examples', _records_sql('examples', 'example_id', 'metadata'))})
UNION ALL SELECT DISTINCT 'examples', example_id, 'doc', CAST(i - 1 AS VARCHAR), coalesce({_strip_sql('d.doc_id')}, '') FROM (SELECT example_id, i, docs[i] AS d FROM (SELECT example_id, docs, unnest(range(1, len(docs) + 1)) AS i FROM examples WHERE example_id IS NOT NULL)) WHERE {_filled_sql('d.text')} IS NOT NULL
UNION ALL SELECT 'mixed_contexts', CAST(ord AS VARCHAR), 'context', CAST(i - 1 AS VARCHAR), coalesce(lower({_strip_sql('c.label')}), '') FROM {_CONTEXTS_SQL} WHERE c IS NOT NULL""",
}
