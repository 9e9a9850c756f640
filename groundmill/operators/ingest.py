"""Raw question-answer records of unknown schema into unified examples and samples, over VARIANT columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmill.functions.picks import at, present, truthy, worded
from groundmill.functions.text import filled, not_junk

# The keys, in order, under which each dataset's records carry their parts.
QUERY_KEYS = {
    "mirror/alce-data": ["question", "query", "prompt", "instruction"],
    "mirror/asqa": ["question", "query", "prompt"],
    "mirror/qampari": ["question", "query", "prompt"],
    "mirror/fever": ["claim", "query", "text"],
}
ANSWER_KEYS = {
    "mirror/alce-data": ["answer", "output", "reference_answer", "gold_answer"],
    "mirror/asqa": ["long_answer", "answer", "response"],
}
CLAIM_KEYS = ["answers", "targets", "gold_answers", "answer"]
LABEL_KEYS = ["label", "verdict"]
RECORD_KEYS = ["id", "example_id"]
CITATION_KEYS = ["citations", "citation", "source_citations"]
EVIDENCE_KEYS = ["evidence", "evidence_sentences", "evidence_sets"]
DOC_LIST_KEYS = {
    "mirror/alce-data": ["docs", "documents", "passages", "contexts", "ctxs", "retrieved_docs"],
    "mirror/asqa": ["docs", "documents", "contexts", "ctxs", "references", "passages"],
}
DOC_TEXT_KEYS = ["text", "content", "paragraph_text", "passage", "sentence", "sent", "ctx", "context", "wikipedia_text", "wiki_text", "body"]
DOC_HOMES = ["document", "doc", "passage", "ctx"]
SENTENCE_KEYS = ["sentences", "sents", "sent", "sentence"]
DOC_TITLE_KEYS = ["title", "source", "article_title", "wiki_title", "doc_title"]
DOC_ID_KEYS = ["doc_id", "id", "docid", "document_id", "passage_id", "pid", "idx"]
QUESTION_KEYS = ["ambiguous_question", "question", "query", "q"]
METADATA_QUESTION_KEYS = ["question", "original_question", "query", "prompt", "input", "instruction", "title"]
METADATA_QUESTION_HOMES = ["question", "query", "prompt", "input"]
INNER_QUESTION_KEYS = ["text", "value", "question", "query", "prompt", "input"]
SAMPLE_ANSWER_KEYS = ["gold_answer", "answer", "output", "reference_answer"]
PSEUDO_KEYS = ["gold_answer", "long_answer", "answer", "output", "response", "final_answer", "context", "prompt", "question", "query", "claim", "instruction", "input", "text"]
ARTICLE_TEXT_KEYS = ["text", "content", "article", "body", "wikipedia_text", "wiki_text", "raw_text"]
ARTICLE_HOMES = ["document", "doc", "page", "article"]
ARTICLE_TITLE_KEYS = ["title", "page_title", "article_title", "name"]
ARTICLE_ID_KEYS = ["id", "page_id", "pageid", "article_id", "doc_id", "document_id"]
WRAPPERS = ("row", "data", "example")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def parsed(payload: Column) -> Column:
    """The payload as a VARIANT object, unwrapped: encoded once more, or under a wrapper key; null if unreadable."""
    text = _let(F.try_parse_json(payload), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(payload))

    def unwrapped(v: Column) -> Column:
        wrapped = [F.when(F.schema_of_variant(at(v, k)).startswith("OBJECT"), at(v, k)) for k in WRAPPERS]
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(*wrapped, v))

    return _let(F.try_parse_json(text), unwrapped)


def as_list(value: Column) -> Column:
    """A VARIANT as an array of texts: a list as it is without nulls, a scalar as its only member, null as empty."""
    kind = F.schema_of_variant(value)
    listed = F.from_json(F.to_json(value), "array<string>")
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<string>")).when(kind.startswith("ARRAY"), F.filter(listed, lambda x: x.isNotNull())).otherwise(F.array(F.try_variant_get(value, "$", "string")))


def _present_variant(value: Column, keys: list[str]) -> Column:
    """By presence, as a VARIANT."""
    out = F.lit(None).cast("variant")
    for key in reversed(keys):
        out = F.when(at(value, key).isNotNull(), at(value, key)).otherwise(out)
    return out


def document_of(d: Column) -> Column:
    """doc_id, title and text of a document's VARIANT; the text may be one object deeper, or a list of sentences."""
    joined = F.filter(F.array(*(F.array_join(F.try_variant_get(d, f"$.{k}", "array<string>"), " ") for k in SENTENCE_KEYS)), lambda t: filled(t).isNotNull())
    text = F.coalesce(worded(d, DOC_TEXT_KEYS), F.get(joined, 0), *(worded(at(d, k), DOC_TEXT_KEYS) for k in DOC_HOMES))
    return F.struct(truthy(d, DOC_ID_KEYS).alias("doc_id"), worded(d, DOC_TITLE_KEYS).alias("title"), text.alias("text"))


def documents_of(value: Column) -> Column:
    """The documents with text of a VARIANT list, in order; none if it is no list."""
    listed = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(listed, document_of), lambda d: d["text"].isNotNull())


def examples_of(raw: DataFrame, id_col: str, dataset_col: str, split_col: str, payload_col: str, unknown: str = "error") -> DataFrame:
    """Unified examples: id, dataset_id, split, query, gold_answer, gold_claims, label, docs, record_id, citations, evidence.

    Each dataset has its own keys; a key counts by presence, so a null under an earlier key is the value. Unreadable
    records are left out; a record of another dataset is an error, or left out if ``unknown`` is "skip".
    """
    if unknown not in ("error", "skip"):
        raise ValueError("unknown must be error or skip")
    v, dataset = F.col("v"), F.col("dataset_id")
    rows = raw.select(F.col(id_col).alias("id"), F.col(dataset_col).alias("dataset_id"), F.col(split_col).alias("split"), parsed(F.col(payload_col)).alias("v")).where("v is not null")
    if unknown == "skip":
        rows = rows.where(dataset.isin(*QUERY_KEYS))
    else:
        named = F.when(dataset.isin(*QUERY_KEYS), dataset).otherwise(F.raise_error(F.concat(F.lit("unknown dataset: "), F.coalesce(dataset, F.lit("null")))).cast("string"))
        rows = rows.withColumn("dataset_id", named)
    by = lambda keys: F.coalesce(*(F.when(dataset == d, present(v, k)) for d, k in keys.items()))
    claims = F.when(dataset == "mirror/qampari", as_list(_present_variant(v, CLAIM_KEYS)))
    docs = F.coalesce(*(F.when(dataset == d, documents_of(_present_variant(v, k))) for d, k in DOC_LIST_KEYS.items()))
    return rows.select(
        "id",
        "dataset_id",
        "split",
        F.coalesce(by(QUERY_KEYS), F.lit("")).alias("query"),
        by(ANSWER_KEYS).alias("gold_answer"),
        F.when(F.size(claims) > 0, claims).alias("gold_claims"),
        F.when(dataset == "mirror/fever", present(v, LABEL_KEYS)).alias("label"),
        F.coalesce(docs, F.array().cast("array<struct<doc_id:string,title:string,text:string>>")).alias("docs"),
        present(v, RECORD_KEYS).alias("record_id"),
        F.when(dataset == "mirror/alce-data", present(v, CITATION_KEYS)).alias("citations"),
        F.when(dataset == "mirror/fever", present(v, EVIDENCE_KEYS)).alias("evidence"),
    )


def question_of(v: Column, keys: list[str]) -> Column:
    """The first question under the keys; failing these in the metadata, there also one object deeper."""
    metadata = at(v, "metadata")
    inner = [worded(at(metadata, home), INNER_QUESTION_KEYS, junk=True) for home in METADATA_QUESTION_HOMES]
    return F.coalesce(worded(v, keys, junk=True), worded(metadata, METADATA_QUESTION_KEYS, junk=True), *inner)


def answers_of(v: Column) -> Column:
    """The distinct answers of a record in order: a text, or a list of texts or of objects with text; failing these one
    under the other keys."""
    raw = F.coalesce(*(F.when(~F.is_variant_null(at(v, k)), at(v, k)) for k in ("gold_answer", "gold_answers", "answers")))
    listed = F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.when(F.schema_of_variant(raw) == "STRING", F.array(raw)), F.array().cast("array<variant>"))
    texts = F.transform(listed, lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", filled(F.try_variant_get(x, "$", "string"))), not_junk(F.when(F.schema_of_variant(at(x, "text")) == "STRING", F.try_variant_get(x, "$.text", "string")))))
    found = F.array_distinct(F.filter(texts, lambda t: t.isNotNull()))
    other = worded(v, SAMPLE_ANSWER_KEYS, junk=True)
    return F.when(F.size(found) > 0, found).when(other.isNotNull(), F.array(other)).otherwise(F.array().cast("array<string>"))


def asqa_samples(raw: DataFrame, id_col: str, split_col: str, payload_col: str) -> DataFrame:
    """Samples with a question and at least one answer: distinct long answers, else distinct short answers.

    id, qid ``asqa_{split}_{id}``, question, answers, and the numbers of annotations and pairs. Pairs stand in
    annotations or, where there are none, at the top.
    """
    v = F.col("v")
    pair = "array<struct<short_answers array<string>>>"
    annotation = f"array<struct<long_answer string, qa_pairs {pair}>>"
    home = F.coalesce(at(v, "annotations"), F.try_variant_get(v, "$.metadata.annotations", "variant"))
    rows = raw.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), parsed(F.col(payload_col)).alias("v")).where("v is not null")
    rows = rows.select("id", "split", question_of(v, QUESTION_KEYS).alias("question"), F.coalesce(F.from_json(F.to_json(home), annotation), F.array().cast(annotation)).alias("a"), F.from_json(F.to_json(at(v, "qa_pairs")), pair).alias("top"))
    clean = lambda texts: F.array_distinct(F.filter(F.transform(texts, not_junk), lambda x: x.isNotNull()))
    empty = F.array().cast("array<string>")
    inner = F.flatten(F.transform("a", lambda x: F.coalesce(x["qa_pairs"], F.array().cast(pair))))
    pairs = F.when(F.size(inner) > 0, inner).otherwise(F.coalesce("top", F.array().cast(pair)))
    long = clean(F.transform("a", lambda x: x["long_answer"]))
    short = clean(F.flatten(F.transform(pairs, lambda p: F.coalesce(p["short_answers"], empty))))
    out = rows.select("id", F.format_string("asqa_%s_%06d", "split", F.col("id")).alias("qid"), "question", F.when(F.size(long) > 0, long).otherwise(short).alias("answers"), F.size("a").alias("n_annotations"), F.size(pairs).alias("n_pairs"))
    return out.where("question is not null and size(answers) > 0")


def alce_samples(raw: DataFrame, id_col: str, split_col: str, payload_col: str) -> DataFrame:
    """Samples with a question and one answer: id, qid, question, answer."""
    v = F.col("v")
    rows = raw.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), parsed(F.col(payload_col)).alias("v")).where("v is not null")
    out = rows.select("id", F.format_string("alce_%s_%06d", "split", F.col("id")).alias("qid"), question_of(v, ["question", "query", "instruction", "input"]).alias("question"), not_junk(truthy(v, ["answer", "output", "response", "gold", "reference"])).alias("answer"))
    return out.where("question is not null and answer is not null")


def article_of(v: Column) -> dict[str, Column]:
    """id, title and text of an article record; the text may be one object deeper."""
    text = F.coalesce(worded(v, ARTICLE_TEXT_KEYS), *(worded(at(v, k), ARTICLE_TEXT_KEYS) for k in ARTICLE_HOMES))
    return {"id": truthy(v, ARTICLE_ID_KEYS), "title": worded(v, ARTICLE_TITLE_KEYS), "text": text}


def merged_metadata(base: Column, extra: Column, extra_wins: bool) -> Column:
    """Two string maps as one; of a key that both have, the extra's value counts or the base's."""
    first, last = (base, extra) if extra_wins else (extra, base)
    first, last = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (first, last))
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(last), k)), last)


def claims_of(claims: Column, answers: Column, question: Column) -> Column:
    """The claims; failing these the answers; failing these the question; null if there is nothing."""
    full = lambda a: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, a)
    return F.coalesce(full(F.filter(claims, lambda c: c.isNotNull())), full(F.filter(answers, lambda a: a.isNotNull())), F.when(filled(question).isNotNull(), F.array(question)))


def pseudo_documents(examples: DataFrame, id_col: str, text_cols: list[str] | None = None) -> DataFrame:
    """A document in place of missing ones: the first filled text column, by default of ``PSEUDO_KEYS``, else the row as
    JSON, without its documents and metadata."""
    named = [c for c in text_cols or PSEUDO_KEYS if c in examples.columns]
    rest = [c for c in examples.columns if c not in (id_col, "docs", "metadata")]
    text = F.coalesce(*(filled(F.col(c)) for c in named), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))
    return examples.select(id_col, text.alias("text"))
