"""The data processing of retrieval-grounded question answering, over the given tables, with the SQL each query is held against."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.functions.picks import present, truthy, worded
from groundmill.functions.text import JUNK, NEGATION_CUES, STOPWORDS, WS, entities, filled, key_of, keywords, negated, numbers, safe_name, strip, tokens
from groundmill.plans.nested import _document_text_sql, _filled_sql, _first_sql, _items_sql
from groundmill.operators import chunking, claims, contexts, ingest, mixing, prompts, reports, retrieval
from groundmill.session import join_hot, shared_dir, spread, table, written
from groundmill.sources import jsonl
from groundmill.streaming import arrivals

SEED, SCHEDULE = 42, "clean:0.34,mixed:0.33,toxic:0.33"
POOL = 1_000
RATIOS = {"support": 0.5, "decoy": 0.3, "conflict": 0.2}

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _filled(x: str) -> str:
    return f"nullif({_strip(x)}, '')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _keywords(x: str) -> str:
    return f"list_distinct(list_filter({_tokens(x)}, lambda t: length(t) > 1 AND t NOT IN ({_STOP})))"


def _entities(x: str) -> str:
    return rf"list_distinct(list_transform(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')), lambda w: lower(w)))"


def _numbers(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^\p{{Nd}}+$')))"


def _negated(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{c}')" for c in NEGATION_CUES) + ")"


def _uniform(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""SELECT doc_id, len({_tokens('text')}) AS n_tokens, len(list_distinct({_tokens('text')})) AS n_terms,
       len({_keywords('text')}) AS n_keywords, len({_entities('text')}) AS n_entities, len({_numbers('text')}) AS n_numbers,
       {_negated('text')} AS negated FROM documents WHERE text IS NOT NULL""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, keywords, entities, numbers and denial of each document."""
    t = F.col("text")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")).select("doc_id", F.size(tokens(t)).alias("n_tokens"), F.size(F.array_distinct(tokens(t))).alias("n_terms"), F.size(keywords(t)).alias("n_keywords"), F.size(entities(t)).alias("n_entities"), F.size(numbers(t)).alias("n_numbers"), negated(t).alias("negated"))


def _windows_sql(source: str, size: int, overlap: int, where: str = "TRUE") -> str:
    step = size - overlap
    return f"""SELECT * EXCLUDE (tok), list_slice(tok, i * {step} + 1, i * {step} + {size}) AS part FROM (
  SELECT *, unnest(range(CASE WHEN len(tok) = 0 THEN 0 WHEN len(tok) <= {size} THEN 1 ELSE CAST(ceil((len(tok) - {size}) / {step}.0) AS BIGINT) + 1 END)) AS i
  FROM (SELECT *, regexp_extract_all(text, '[^{WS}]+') AS tok FROM {source} WHERE text IS NOT NULL AND {where}))"""


@query(f"""SELECT coalesce(source, 'none') || '::' || doc_id || '::chunk' || i AS passage_id, CAST(doc_id AS VARCHAR) AS doc_id,
       md5(array_to_string(part, ' ')) AS text_md5, len(part) AS n_tokens FROM ({_windows_sql('documents', 384, 64)})""")
def chunk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("dataset")))
    return chunking.passages_of(docs, "dataset", "doc_id", "text").select("passage_id", "doc_id", F.md5("text").alias("text_md5"), "n_tokens")


_KEY = f"""coalesce({_filled('article_id')}, CASE WHEN {_filled('title')} IS NOT NULL THEN 'title:' || substr(md5({_strip('title')}), 1, 16) END,
       'row:' || substr(md5(substr(text, 1, 512)), 1, 16))"""


@query(f"""SELECT {_KEY} || ':' || i AS doc_id, source, title, md5(array_to_string(part, ' ')) AS text_md5, CAST(i AS INTEGER) AS chunk_index
FROM ({_windows_sql('documents', 180, 30, 'length(text) >= 300')})""")
def chunk_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.external_passages(spread(table(spark, sf_dir, "documents").select("article_id", "title", "text", "source")), "article_id", "title", "text", "source")
    return out.select("doc_id", "source", "title", F.md5("text").alias("text_md5"), "chunk_index")


@query(f"""SELECT doc_id, {_KEY} AS article_key FROM documents""")
def article_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", key_of(F.col("article_id"), F.col("title"), F.col("text")).alias("article_key"))


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


@query(f"""SELECT coalesce(CAST(doc_id AS VARCHAR), {_filled('title')}) AS doc_id, coalesce({_collapsed('title')}, '') AS title,
       md5({_collapsed('text')}) AS text_md5, coalesce({_filled('source')}, 'wiki') AS source FROM documents WHERE length({_collapsed('text')}) >= 200""")
def wiki_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.leads(table(spark, sf_dir, "documents"), "doc_id", "title", "text", "source")
    return out.select("doc_id", "title", F.md5("text").alias("text_md5"), "source")


@query(f"""SELECT source, count(*) FILTER (WHERE {_filled('text')} IS NOT NULL AND {_filled('source')} IS NOT NULL) AS valid,
       count(*) FILTER (WHERE {_filled('text')} IS NULL OR {_filled('source')} IS NULL) AS rejected FROM documents GROUP BY source""")
def passage_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = chunking.validated(table(spark, sf_dir, "documents"))
    flagged = good.select("source", F.lit(1).alias("ok")).unionByName(bad.select("source", F.lit(0).alias("ok")))
    return flagged.groupBy("source").agg(F.sum("ok").alias("valid"), F.sum(1 - F.col("ok")).alias("rejected"))


@query("""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'corpus') AS safe_source FROM documents""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", safe_name(F.col("source"), "corpus").alias("safe_source"))


_CORPUS = "(SELECT passage_id AS doc_id, max(text) AS text FROM passages WHERE passage_id IS NOT NULL GROUP BY passage_id)"


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per passage; repeated rows fold before they are indexed."""
    return table(spark, sf_dir, "passages").where("passage_id is not null").groupBy("passage_id").agg(F.max("text").alias("text"))


@query(f"""SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM {_CORPUS}) GROUP BY doc_id, term) GROUP BY term""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build_index(_corpus(spark, sf_dir), "passage_id", "text").terms


@query(f"""SELECT count(*) AS docs, avg(len(t)) AS avg_length FROM (SELECT {_tokens('text')} AS t FROM {_CORPUS} WHERE text IS NOT NULL) WHERE len(t) > 0""")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build_index(_corpus(spark, sf_dir), "passage_id", "text").stats.select("docs", "avg_length")


def _bm25_sql(corpus: str, queries: str) -> str:
    return f"""WITH post AS (SELECT doc_id, term, len(any_value(t)) AS length, count(*) AS tf FROM (SELECT doc_id, {_tokens('text')} AS t, unnest({_tokens('text')}) AS term FROM {corpus} WHERE text IS NOT NULL) GROUP BY doc_id, term),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM (SELECT {_tokens('text')} AS t FROM {corpus} WHERE text IS NOT NULL) WHERE len(t) > 0),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT DISTINCT query_id, unnest({_tokens('text')}) AS term FROM {queries}),
s AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 1.9::DOUBLE / (tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * length / avgdl))), 6) AS score
  FROM q JOIN post USING (term) JOIN terms USING (term), stats GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 50"""


_BM25 = _bm25_sql(_CORPUS, "(SELECT item_id AS query_id, text FROM eval_items WHERE item_id % 20 = 0)")


@query(_BM25)
def bm25_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the 50 best passages for each query. Queries are the evaluation items whose id is divisible by 20."""
    index = retrieval.build_index(_corpus(spark, sf_dir), "passage_id", "text")
    return retrieval.search(index, table(spark, sf_dir, "eval_items").where("item_id % 20 = 0"), "item_id", "text")


_DOCS = """(SELECT doc_id, p.title AS title, p.text AS text FROM (SELECT doc_id, arg_max({'title': title, 'text': text}, coalesce(text, '') || chr(1) || coalesce(title, '')) AS p FROM candidate_docs WHERE doc_id IS NOT NULL GROUP BY doc_id))"""
_CLAIMS = "(SELECT claim_id, arg_max(claim_text, ord) AS claim_text FROM mixed_contexts WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL GROUP BY claim_id)"
_CANDS = """(SELECT claim_id, c.doc_id, min(rank) AS rank, coalesce(any_value(d.text), '') AS text FROM candidate_docs c
  LEFT JOIN (SELECT doc_id, max(text) AS text FROM candidate_docs GROUP BY doc_id) d ON c.doc_id = d.doc_id WHERE claim_id IS NOT NULL AND c.doc_id IS NOT NULL GROUP BY claim_id, c.doc_id)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = table(spark, sf_dir, "mixed_contexts").where("claim_id is not null and claim_text is not null")
    return mixed.groupBy("claim_id").agg(F.max_by("claim_text", "ord").alias("claim_text"))


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title and text of one row per candidate document, folded before the join: a document in a tenth of the rows is one row."""
    order = F.concat(F.coalesce("text", F.lit("")), F.lit("\x01"), F.coalesce("title", F.lit("")))
    pairs = table(spark, sf_dir, "candidate_docs").where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("title", "text"), order).alias("pair"))
    return pairs.select("doc_id", "pair.title", "pair.text")


def _label_sql(claim: str, text: str) -> str:
    bears = f"(ov >= 2 AND (len(list_intersect({_entities(claim)}, {_entities(text)})) > 0 OR shared_numbers > 0))"
    strange = f"(len({_numbers(claim)}) > 0 AND len({_numbers(text)}) > 0 AND shared_numbers = 0)"
    return f"CASE WHEN {bears} AND ({_negated(text)} OR {strange}) THEN 'conflict' WHEN {bears} THEN 'support' WHEN ov >= 2 THEN 'decoy' ELSE 'irrelevant' END"


def _labelled_sql(candidates: str, claims_: str) -> str:
    return f"""SELECT claim_id, doc_id, rank, {_label_sql('claim_text', 'text')} AS label FROM (
  SELECT k.claim_id, c.doc_id, c.rank, k.claim_text, c.text, len(list_intersect({_keywords('k.claim_text')}, list_distinct({_tokens('c.text')}))) AS ov,
    len(list_intersect({_numbers('k.claim_text')}, {_numbers('c.text')})) AS shared_numbers FROM {candidates} c JOIN {claims_} k USING (claim_id))"""


_LABELLED = _labelled_sql(_CANDS, _CLAIMS)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "candidate_docs").where("claim_id is not null and doc_id is not null").groupBy("claim_id", "doc_id").agg(F.min("rank").alias("rank"))
    once = written(once, "candidates")
    texts = written(_lookup(spark, sf_dir).select("doc_id", contexts.text_features(F.coalesce("text", F.lit(""))).alias("t")), "texts")
    asked = _claims(spark, sf_dir).select("claim_id", contexts.claim_features(F.col("claim_text")).alias("c"))
    counts = once.groupBy("doc_id").agg(F.count("*").alias("n"))
    pairs = join_hot(once, texts.join(counts, "doc_id"), "doc_id", "n", once.count()).join(asked, "claim_id")
    return pairs.select("claim_id", "doc_id", "rank", contexts.label_of(F.col("c"), F.col("t")).alias("label"))


@query(_LABELLED)
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


@query(f"SELECT label, count(*) AS n, count(DISTINCT claim_id) AS claims FROM ({_LABELLED}) GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("claim_id").alias("claims"))


def _profile(key):
    return contexts.choose_profile(contexts.parse_schedule(SCHEDULE), SEED, key)


def _profile_sql(key: str) -> str:
    draw = _uniform(repr(str(SEED)), key)
    return f"CASE WHEN {draw} <= 0.34::DOUBLE THEN 'clean' WHEN {draw} <= 0.67::DOUBLE THEN 'mixed' ELSE 'toxic' END"


@query(f"SELECT example_id, {_profile_sql('example_id')} AS mix_profile FROM (SELECT DISTINCT example_id FROM examples WHERE example_id IS NOT NULL)")
def profile_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "examples").where("example_id is not null").select("example_id").distinct().select("example_id", _profile(F.col("example_id")).alias("mix_profile"))


# The quotas of support, decoy, conflict and irrelevant contexts, worked out by hand.
_QUOTAS = {12: {"clean": (8, 3, 0, 1), "mixed": (5, 4, 2, 1), "toxic": (3, 4, 4, 1)}, 6: {"clean": (4, 2, 0, 0), "mixed": (3, 2, 1, 0), "toxic": (2, 2, 2, 0)}}


def _selection_sql(k: int, labelled: str = _LABELLED) -> str:
    quota = " ".join(f"WHEN mix_profile = '{p}' AND label = '{name}' THEN {n}" for p, quotas in _QUOTAS[k].items() for name, n in zip(("support", "decoy", "conflict", "irrelevant"), quotas))
    return f"""WITH c AS (SELECT *, {_profile_sql("split_part(claim_id, '::', 1)")} AS mix_profile FROM ({labelled})),
a AS (SELECT *, count(*) OVER (PARTITION BY claim_id) AS n, row_number() OVER (PARTITION BY claim_id ORDER BY rank, doc_id) AS place FROM c),
b AS (SELECT *, label = 'irrelevant' AND place > floor(n * 0.6::DOUBLE) AS tail FROM a),
d AS (SELECT *, label <> 'irrelevant' OR tail OR NOT bool_or(tail) OVER (PARTITION BY claim_id) AS eligible FROM b),
e AS (SELECT *, eligible AND row_number() OVER (PARTITION BY claim_id, label, eligible ORDER BY md5(concat_ws('|', '{SEED}', claim_id, doc_id, rank))) <= CASE {quota} ELSE 0 END AS picked FROM d),
f AS (SELECT *, count(*) FILTER (WHERE picked) OVER (PARTITION BY claim_id) AS n_picked, row_number() OVER (PARTITION BY claim_id, picked ORDER BY md5(concat_ws('|', '{SEED + 1}', claim_id, doc_id, rank))) AS later FROM e),
g AS (SELECT *, CASE WHEN picked THEN 'quota' WHEN later <= {k} - n_picked THEN 'fill' END AS drawn FROM f),
short AS (SELECT claim_id, any_value(n) AS n, count(drawn) AS have FROM g GROUP BY claim_id HAVING count(drawn) < {k}),
again AS (SELECT claim_id, turn, CAST(floor({_uniform(repr(str(SEED + 2)), 'claim_id', 'turn')} * n) AS BIGINT) + 1 AS place FROM (SELECT claim_id, n, unnest(range(1, {k} - have + 1)) AS turn FROM short)),
u AS (SELECT claim_id, doc_id, rank, label, drawn, 0 AS turn FROM g WHERE drawn IS NOT NULL UNION ALL SELECT claim_id, doc_id, rank, label, 'repeat', turn FROM again JOIN g USING (claim_id, place))
SELECT * FROM (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY rank, doc_id, turn) AS position, doc_id, rank, label, drawn FROM u) WHERE position <= {k}"""


def _selected(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    candidates = _labelled(spark, sf_dir).withColumn("mix_profile", _profile(F.split("claim_id", "::")[0]))
    return contexts.select_contexts(candidates, k, SEED)


@query(_selection_sql(12))
def select_contexts_k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, 12)


@query(_selection_sql(6))
def select_contexts_k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, 6)


@query(f"""WITH pool AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', doc_id)), doc_id) - 1 AS ordinal FROM {_CORPUS} ORDER BY ordinal LIMIT {POOL}),
bare AS (SELECT DISTINCT example_id AS claim_id FROM examples WHERE example_id IS NOT NULL AND example_id NOT IN (SELECT split_part(claim_id, '::', 1) FROM candidate_docs WHERE claim_id IS NOT NULL))
SELECT b.claim_id, b.position, p.doc_id FROM (SELECT claim_id, unnest(range(1, 7)) AS position FROM bare) b
JOIN pool p ON p.ordinal = (SELECT CAST(floor((b.position - 1) * (count(*) / 6.0::DOUBLE)) + floor({_uniform(repr(str(SEED)), 'claim_id', 'b.position')} * greatest(floor(b.position * (count(*) / 6.0::DOUBLE)) - floor((b.position - 1) * (count(*) / 6.0::DOUBLE)), 1)) AS BIGINT) % count(*) FROM pool)""")
def backfill_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six contexts from a sample of the corpus for each example that has no candidates at all."""
    pool = contexts.sample_pool(_corpus(spark, sf_dir), "passage_id", SEED, POOL)
    have = table(spark, sf_dir, "candidate_docs").where("claim_id is not null").select(F.split("claim_id", "::")[0].alias("claim_id"))
    bare = table(spark, sf_dir, "examples").where("example_id is not null").select(F.col("example_id").alias("claim_id")).distinct()
    return contexts.backfill(bare, have, pool, pool.count(), 6, SEED)


_EXPLODED = "(SELECT ord, qid, i - 1 AS pos, contexts[i] AS c FROM (SELECT ord, qid, contexts, unnest(range(1, len(contexts) + 1)) AS i FROM mixed_contexts) WHERE contexts[i] IS NOT NULL)"


@query(f"""SELECT ord, CAST(pos AS INTEGER) AS pos, c.doc_id AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(d.title, '') ELSE c.title END AS title,
       md5(CASE WHEN d.doc_id IS NOT NULL THEN coalesce(d.text, '') ELSE c.text END) AS text_md5, d.doc_id IS NULL AS missing_doc
FROM {_EXPLODED} LEFT JOIN {_DOCS} d ON c.doc_id = d.doc_id""")
def hydrate_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = table(spark, sf_dir, "mixed_contexts").select("ord", F.posexplode("contexts").alias("pos", "c")).where("c is not null").select("ord", "pos", "c.doc_id", "c.title", "c.text")
    return contexts.hydrate(mixed, _lookup(spark, sf_dir)).select("ord", "pos", "doc_id", "title", F.md5("text").alias("text_md5"), "missing_doc")


@query("""SELECT qid, arg_max_null(claim_id, ord) AS claim_id, arg_max_null(mix_profile, ord) AS mix_profile, max(ord) AS ord FROM mixed_contexts WHERE qid IS NOT NULL GROUP BY qid""")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = table(spark, sf_dir, "mixed_contexts").where("qid is not null")
    return claims.last_wins(mixed.select("qid", "claim_id", "mix_profile", "ord"), ["qid"], "ord")


@query(f"""WITH once AS (SELECT example_id, max(gold_answer) AS a FROM examples WHERE example_id IS NOT NULL GROUP BY example_id),
parts AS (SELECT example_id, list_filter(list_transform(string_split(a, '.'), lambda x: {_strip('x')}), lambda x: length(x) >= 10) AS l FROM once WHERE a IS NOT NULL)
SELECT example_id, 'c' || (generate_subscripts(l, 1) - 1) AS claim_id, unnest(l) AS text FROM parts""")
def gold_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "examples").where("example_id is not null").groupBy("example_id").agg(F.max("gold_answer").alias("a")).where("a is not null")
    return claims.clause_claims(once, ["example_id"], F.array("a"))


def _sentences_sql(source: str, keys: str) -> str:
    cut = f"string_split(regexp_replace(answer, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""(SELECT {keys}, generate_subscripts(l, 1) - 1 AS claim_id, unnest(l) AS claim FROM
  (SELECT {keys}, list_filter(list_transform({cut}, lambda x: {_strip('x')}), lambda x: length(x) >= 15) AS l FROM {source} WHERE answer IS NOT NULL))"""


def _answers(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select("ord", strip(F.col("id")).alias("id"), "answer", "mode")


_ONE = f"(SELECT ord, {_strip('id')} AS id, answer, mode FROM phase1_gen_sample100)"
_FIVE = f"(SELECT ord, {_strip('id')} AS id, answer, mode FROM phase5_grounded_answers_sample100)"


@query(f"SELECT ord, CAST(claim_id AS INTEGER) AS claim_id, md5(claim) AS claim_md5 FROM {_sentences_sql(_ONE, 'ord')}")
def sentence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.answer_claims(_answers(spark, sf_dir, "phase1_gen_sample100"), ["ord"], "answer").select("ord", "claim_id", F.md5("claim").alias("claim_md5"))


_PREMISES = f"""(SELECT id, list_distinct({_tokens('t')}) AS premise, {_numbers('t')} AS premise_numbers, {_negated('t')} AS premise_negated FROM
  (SELECT qid AS id, array_to_string(list_transform(list_filter(c, lambda x: x.text IS NOT NULL), lambda x: x.text), chr(10) || chr(10)) AS t FROM
    (SELECT qid, arg_max_null(contexts, ord) AS c FROM mixed_contexts WHERE qid IS NOT NULL GROUP BY qid) WHERE c IS NOT NULL))"""


def _scores_sql(source: str) -> str:
    own, figures = _keywords("claim"), _numbers("claim")
    share = f"coalesce(len(list_intersect({own}, premise))::DOUBLE / nullif(len({own}), 0), 0.0::DOUBLE)"
    against = f"((len({figures}) > 0 AND len(list_intersect({figures}, premise_numbers)) < len({figures})) OR ({_negated('claim')} AND NOT premise_negated))"
    return f"""(SELECT id, ord, claim_id, claim, CASE WHEN e >= c AND e >= n THEN 'support' WHEN c >= n THEN 'conflict' ELSE 'irrelevant' END AS label,
  round(exp(e) / (exp(e) + exp(c) + exp(n)), 6) AS support, round(exp(c) / (exp(e) + exp(c) + exp(n)), 6) AS conflict, round(exp(n) / (exp(e) + exp(c) + exp(n)), 6) AS irrelevant
  FROM (SELECT id, ord, claim_id, claim, s * 4.0::DOUBLE - 2.0::DOUBLE AS e, CASE WHEN x THEN s * 3.0::DOUBLE ELSE 0.0::DOUBLE END - 1.0::DOUBLE AS c, 1.0::DOUBLE - s * 2.0::DOUBLE AS n
    FROM (SELECT *, {share} AS s, {against} AS x FROM {_sentences_sql(source, 'ord, id')} JOIN {_PREMISES} USING (id))))"""


def _scores(spark: SparkSession, sf_dir: str, answers: DataFrame) -> DataFrame:
    rows = claims.answer_claims(answers.where("id is not null"), ["ord", "id"], "answer")
    premises = claims.context_tokens(table(spark, sf_dir, "mixed_contexts"), "qid", "ord", "contexts")
    return claims.rule_scores(rows.join(premises, "id"))


@query(f"SELECT id, ord, CAST(claim_id AS INTEGER) AS claim_id, label, support, conflict, irrelevant FROM {_scores_sql(_ONE)}")
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, _answers(spark, sf_dir, "phase1_gen_sample100")).select("id", "ord", "claim_id", "label", "support", "conflict", "irrelevant")


def _metrics_sql(source: str) -> str:
    fracs = ", ".join(f"count(*) FILTER (WHERE label = '{x}') / count(*)::DOUBLE AS {x}_frac" for x in claims.NLI_LABELS)
    return f"(SELECT id, count(*) AS total_claims, {fracs}, count(*) FILTER (WHERE label = 'conflict') > 0 AS partial_hallucination FROM {_scores_sql(source)} GROUP BY id)"


@query(f"SELECT * FROM {_metrics_sql(_ONE)}")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.answer_metrics(_scores(spark, sf_dir, _answers(spark, sf_dir, "phase1_gen_sample100")))


@query(f"""SELECT i.id, coalesce(a.answer, 'I don''t know.') AS answer, 'claim_level_grounded' AS mode FROM (SELECT DISTINCT id FROM {_ONE} WHERE id IS NOT NULL) i
LEFT JOIN (SELECT id, string_agg(claim, ' ' ORDER BY ord, claim_id) AS answer FROM {_scores_sql(_ONE)} WHERE label = 'support' GROUP BY id) a ON i.id = a.id""")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir, "phase1_gen_sample100")
    return claims.grounded_answers(answers.where("id is not null").select("id").distinct(), _scores(spark, sf_dir, answers))


_PHASES = {"phase3": f"(SELECT * FROM {_ONE} WHERE mode = 'base')", "phase4": f"(SELECT * FROM {_ONE} WHERE mode = 'selective_refusal')", "phase5": _FIVE}


def _phases(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The scores of the three phases. What the contexts support is read once for all."""
    one, five = (_answers(spark, sf_dir, t) for t in ("phase1_gen_sample100", "phase5_grounded_answers_sample100"))
    phase = F.when(F.col("mode") == "base", "phase3").when(F.col("mode") == "selective_refusal", "phase4")
    every = one.withColumn("phase", phase).where("phase is not null").unionByName(five.withColumn("phase", F.lit("phase5")))
    rows = claims.answer_claims(every.where("id is not null"), ["ord", "id", "phase"], "answer")
    premises = claims.context_tokens(table(spark, sf_dir, "mixed_contexts"), "qid", "ord", "contexts")
    scored = written(claims.rule_scores(rows.join(premises, "id")).select("id", "phase", "label"), "scores")
    return {p: scored.where(F.col("phase") == p) for p in ("phase3", "phase4", "phase5")}


@query(" UNION ALL ".join(f"""SELECT '{p}' AS phase, count(*) AS ids, {', '.join(f"coalesce(sum(round({x}_frac * total_claims)), 0)::BIGINT AS {x}_claims" for x in claims.NLI_LABELS)},
 {', '.join(f'round(coalesce(avg({x}_frac), 0.0), 6) AS {x}_macro' for x in claims.NLI_LABELS)}, count(*) FILTER (WHERE partial_hallucination) AS with_conflict FROM {_metrics_sql(s)}""" for p, s in _PHASES.items()))
def phase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.phase_rows(_phases(spark, sf_dir))


_SHARED = "(" + " INTERSECT ".join(f"SELECT id FROM {_metrics_sql(x)}" for x in _PHASES.values()) + ")"


@query(" UNION ALL ".join(f"""SELECT '{p}' AS phase, count(*) AS ids, {', '.join(f"coalesce(sum(round({x}_frac * total_claims)), 0)::BIGINT AS {x}_claims" for x in claims.NLI_LABELS)},
 {', '.join(f'round(coalesce(avg({x}_frac), 0.0), 6) AS {x}_macro' for x in claims.NLI_LABELS)}, count(*) FILTER (WHERE partial_hallucination) AS with_conflict FROM {_metrics_sql(s)} WHERE id IN {_SHARED}""" for p, s in _PHASES.items()))
def shared_phase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over the ids that all three phases have."""
    return reports.shared_phase_rows(_phases(spark, sf_dir))


@query(" INTERSECT ".join(f"SELECT id FROM {_metrics_sql(s)}" for s in _PHASES.values()))
def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shared_ids(list(_phases(spark, sf_dir).values()))


_DELTAS = f"""SELECT b.id, {', '.join(f'round(o.{x}_frac - b.{x}_frac, 6) AS delta_{x}' for x in claims.NLI_LABELS)}, o.total_claims - b.total_claims AS delta_total_claims
FROM {_metrics_sql(_PHASES['phase3'])} b JOIN {_metrics_sql(_PHASES['phase4'])} o ON b.id = o.id"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = _phases(spark, sf_dir)
    return reports.metric_deltas(claims.answer_metrics(phases["phase3"]), claims.answer_metrics(phases["phase4"]))


@query(_DELTAS)
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


@query(f"SELECT * FROM ({_DELTAS}) WHERE delta_conflict > 0")
def worse_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).where("delta_conflict > 0")


_CLEAN = f"coalesce(lower({_strip('c.label')}), '')"
_JUDGED = f"""(SELECT truth AS label, CASE WHEN guess = 'irrelevant' THEN 'decoy' ELSE guess END AS prediction FROM (SELECT truth, {_label_sql('claim_text', 'text')} AS guess FROM
  (SELECT {_CLEAN} AS truth, m.claim_text, c.text AS text, len(list_intersect({_keywords('m.claim_text')}, list_distinct({_tokens('c.text')}))) AS ov, len(list_intersect({_numbers('m.claim_text')}, {_numbers('c.text')})) AS shared_numbers
   FROM {_EXPLODED} e JOIN (SELECT ord, claim_text FROM mixed_contexts) m USING (ord) WHERE m.claim_text IS NOT NULL AND c.text IS NOT NULL AND {_CLEAN} IN ('support', 'decoy', 'conflict'))))"""


@query(f"""SELECT count(*) AS n, round(coalesce(count(*) FILTER (WHERE label = 'support' AND prediction = 'support')::DOUBLE / nullif(count(*) FILTER (WHERE label = 'support'), 0), 0), 6) AS csp,
round(coalesce(count(*) FILTER (WHERE label = 'decoy' AND prediction = 'decoy')::DOUBLE / nullif(count(*) FILTER (WHERE label = 'decoy'), 0), 0), 6) AS ucr,
round(coalesce(count(*) FILTER (WHERE label = 'conflict' AND prediction = 'conflict')::DOUBLE / nullif(count(*) FILTER (WHERE label = 'conflict'), 0), 0), 6) AS fcr,
round(coalesce(count(*) FILTER (WHERE prediction = 'support')::DOUBLE / nullif(count(*), 0), 0), 6) AS scc,
round(coalesce(count(*) FILTER (WHERE label = 'support' AND prediction <> 'support')::DOUBLE / nullif(count(*) FILTER (WHERE label = 'support'), 0), 0), 6) AS frr,
round(coalesce(count(*) FILTER (WHERE prediction = 'conflict')::DOUBLE / nullif(count(*), 0), 0), 6) AS cdr FROM {_JUDGED}""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's labels of all mixed contexts against the labels they carry."""
    rows = table(spark, sf_dir, "mixed_contexts").where("claim_text is not null").select("claim_text", F.explode("contexts").alias("c")).where("c.text is not null")
    rows = rows.select(F.coalesce(F.lower(strip(F.col("c.label"))), F.lit("")).alias("label"), contexts.label(F.col("claim_text"), F.col("c.text")).alias("guess")).where(F.col("label").isin(*reports.CLASSES))
    return reports.classification_metrics(rows.select("label", F.when(F.col("guess") == "irrelevant", "decoy").otherwise(F.col("guess")).alias("prediction")))


_SHARES = ", ".join(f"('{name}', {r!r}::DOUBLE / {sum(RATIOS.values())!r}::DOUBLE)" for name, r in RATIOS.items())


@query(f"""WITH t AS (SELECT coalesce(mix_profile, 'none') AS mix_profile, sum(coalesce(len(contexts), 0)) AS total FROM mixed_contexts GROUP BY 1),
x AS (SELECT mix_profile, total, label, total * share AS exact FROM t, (VALUES {_SHARES}) v(label, share)),
y AS (SELECT *, row_number() OVER (PARTITION BY mix_profile ORDER BY round(exact - floor(exact), 9) DESC, label DESC) AS turn, total - sum(floor(exact)) OVER (PARTITION BY mix_profile) AS rest FROM x)
SELECT mix_profile, label, CAST(floor(exact) + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM y""")
def mixture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of each profile shared out by the target ratios."""
    totals = table(spark, sf_dir, "mixed_contexts").groupBy(F.coalesce("mix_profile", F.lit("none")).alias("mix_profile")).agg(F.sum(F.coalesce(F.size("contexts"), F.lit(0))).alias("total"))
    return reports.apportion(totals, "mix_profile", "total", RATIOS)


_V = """(SELECT rec_id, CASE WHEN json_type(v, '$.row') = 'OBJECT' THEN json_extract(v, '$.row') WHEN json_type(v, '$.data') = 'OBJECT' THEN json_extract(v, '$.data') WHEN json_type(v, '$.example') = 'OBJECT' THEN json_extract(v, '$.example') ELSE v END AS v, dataset_id, split FROM
  (SELECT rec_id, dataset_id, split, CASE WHEN json_type(p) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(p, '$')) THEN json_extract_string(p, '$')::JSON END ELSE p END AS v FROM
    (SELECT rec_id, dataset_id, split, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM raw_examples)) WHERE json_type(v) = 'OBJECT')"""


def _present_sql(keys: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN json_exists(v, '$.{k}') THEN json_extract_string(v, '$.{k}')" for k in keys) + " END"


def _truthy_sql(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_extract_string(v, '$.{k}') NOT IN ('', 'false', '0', '0.0', '[]', '{{}}') THEN json_extract_string(v, '$.{k}') END" for k in keys) + ")"


def _worded_sql(keys: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(v, '$.{k}') = 'VARCHAR' THEN {_filled(f'''json_extract_string(v, '$.{k}')''')} END" for k in keys) + ")"


@query(f"""SELECT rec_id, {_present_sql(['label', 'answer', 'long_answer', 'output'])} AS by_presence, {_truthy_sql(['id', 'example_id'])} AS by_truth, {_worded_sql(['question', 'query', 'prompt', 'claim', 'instruction'])} AS by_words FROM {_V}""")
def json_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rules for the first of several keys, over the raw payloads."""
    v = F.col("v")
    rows = table(spark, sf_dir, "raw_examples").select("rec_id", ingest.parsed(F.col("payload")).alias("v")).where("v is not null")
    return rows.select("rec_id", present(v, ["label", "answer", "long_answer", "output"]).alias("by_presence"), truthy(v, ["id", "example_id"]).alias("by_truth"), worded(v, ["question", "query", "prompt", "claim", "instruction"]).alias("by_words"))


def _by_dataset_sql(keys: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN dataset_id = '{d}' THEN {_present_sql(k)}" for d, k in keys.items()) + " END"


_KNOWN = f"dataset_id IN ({', '.join(f"'{d}'" for d in ingest.QUERY_KEYS)})"
_LISTED = "CASE " + " ".join(f"WHEN dataset_id = '{d}' THEN " + "CASE " + " ".join(f"WHEN json_exists(v, '$.{k}') THEN json_extract(v, '$.{k}') END".removesuffix(" END") for k in keys) + " END" for d, keys in ingest.DOC_LIST_KEYS.items()) + " END"


def _unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.examples_of(table(spark, sf_dir, "raw_examples"), "rec_id", "dataset_id", "split", "payload", unknown="skip")


@query(f"""SELECT rec_id AS id, dataset_id, split, coalesce({_by_dataset_sql(ingest.QUERY_KEYS)}, '') AS query, {_by_dataset_sql(ingest.ANSWER_KEYS)} AS gold_answer,
 CASE WHEN dataset_id = 'mirror/fever' THEN {_present_sql(ingest.LABEL_KEYS)} END AS label, {_present_sql(ingest.RECORD_KEYS)} AS record_id, CASE WHEN dataset_id = 'mirror/alce-data' THEN {_present_sql(ingest.CITATION_KEYS)} END AS citations,
 CASE WHEN dataset_id = 'mirror/fever' AND ({' OR '.join(f"json_exists(v, '$.{k}')" for k in ingest.EVIDENCE_KEYS)}) THEN json_array_length(coalesce({', '.join(f"json_extract(v, '$.{k}')" for k in ingest.EVIDENCE_KEYS)})) END AS evidence_sets FROM {_V} WHERE {_KNOWN}""")
def unified_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four datasets' records by one schema."""
    sets = F.when(F.col("evidence").isNotNull(), F.json_array_length("evidence").cast("bigint")).alias("evidence_sets")
    return _unified(spark, sf_dir).select("id", "dataset_id", "split", "query", "gold_answer", "label", "record_id", "citations", sets)


@query(f"""SELECT id, CAST(pos AS INTEGER) AS pos, {_first_sql([*(_filled_sql(f"json_extract_string(d, '$.{k}')") for k in ingest.DOC_ID_KEYS)])} AS doc_id, md5(text) AS text_md5 FROM (
  SELECT id, d, text, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM (SELECT id, i, d, {_document_text_sql('d')} AS text FROM {_items_sql(f'(SELECT rec_id AS id, {_LISTED} AS l FROM {_V} WHERE {_KNOWN})', 'id', 'l', 'i', 'd')} WHERE json_type(d) = 'OBJECT') WHERE text IS NOT NULL)""")
def unified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with text of the records of two datasets, by their keys, in order."""
    rows = _unified(spark, sf_dir).select("id", F.posexplode("docs").alias("pos", "d"))
    return rows.select("id", "pos", filled(F.col("d.doc_id")).alias("doc_id"), F.md5("d.text").alias("text_md5"))


_ANSWERS = "CASE " + " ".join(f"WHEN json_exists(v, '$.{k}') THEN json_extract(v, '$.{k}')" for k in ingest.CLAIM_KEYS) + " END"


@query(f"""SELECT id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n, unnest(l) AS claim FROM (SELECT rec_id AS id, CASE json_type(a) WHEN 'ARRAY' THEN list_filter(json_extract_string(a, '$[*]'), lambda x: x IS NOT NULL) WHEN 'NULL' THEN [] ELSE [json_extract_string(a, '$')] END AS l
  FROM (SELECT rec_id, {_ANSWERS} AS a FROM {_V} WHERE dataset_id = 'mirror/qampari') WHERE a IS NOT NULL)""")
def unified_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold claims of the records that list several answers."""
    return _unified(spark, sf_dir).where("gold_claims is not null").select("id", F.posexplode("gold_claims").alias("n", "claim"))


def _no_junk(x: str) -> str:
    junk = ", ".join(f"'{j}'" for j in JUNK)
    return f"CASE WHEN lower({_strip(x)}) NOT IN ({junk}) THEN {_filled(x)} END"


_STRING = "json_extract_string(v, '{}')"


def _question_sql(keys: list[str]) -> str:
    at = lambda path: f"CASE WHEN json_type(v, '{path}') = 'VARCHAR' THEN {_no_junk(_STRING.format(path))} END"
    paths = [f"$.{k}" for k in keys] + [f"$.metadata.{k}" for k in ingest.METADATA_QUESTION_KEYS] + [f"$.metadata.{h}.{k}" for h in ingest.METADATA_QUESTION_HOMES for k in ingest.INNER_QUESTION_KEYS]
    return f"coalesce({', '.join(at(p) for p in paths)})"


def _clean_list(x: str) -> str:
    kept = f"list_filter(list_transform({x}, lambda x: {_no_junk('x')}), lambda x: x IS NOT NULL)"
    return f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"


@query(f"""SELECT * FROM (SELECT id, qid, question, array_to_string(CASE WHEN len(long) > 0 THEN long ELSE short END, ' | ') AS answers, CAST(n_annotations AS INTEGER) AS n_annotations, CAST(n_pairs AS INTEGER) AS n_pairs FROM (
  SELECT rec_id AS id, 'asqa_' || coalesce(split, 'null') || '_' || lpad(CAST(rec_id AS VARCHAR), 6, '0') AS qid, {_question_sql(ingest.QUESTION_KEYS)} AS question, coalesce({_clean_list("json_extract_string(a, '$[*].long_answer')")}, []) AS long,
    coalesce({_clean_list("json_extract_string(a, '$[*].qa_pairs[*].short_answers[*]')")}, []) AS short, coalesce(json_array_length(a), 0) AS n_annotations, coalesce(len(json_extract(a, '$[*].qa_pairs[*]')), 0) AS n_pairs
  FROM (SELECT *, coalesce(json_extract(v, '$.annotations'), json_extract(v, '$.metadata.annotations')) AS a FROM {_V} WHERE dataset_id = 'mirror/asqa')) WHERE question IS NOT NULL) WHERE answers <> ''""")
def asqa_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the records with annotations."""
    out = ingest.asqa_samples(table(spark, sf_dir, "raw_examples").where("dataset_id = 'mirror/asqa'"), "rec_id", "split", "payload")
    return out.withColumn("answers", F.array_join("answers", " | "))


@query(f"""SELECT * FROM (SELECT rec_id AS id, 'alce_' || coalesce(split, 'null') || '_' || lpad(CAST(rec_id AS VARCHAR), 6, '0') AS qid, {_question_sql(['question', 'query', 'instruction', 'input'])} AS question, {_no_junk(_truthy_sql(['answer', 'output', 'response', 'gold', 'reference']))} AS answer
  FROM {_V} WHERE dataset_id = 'mirror/alce-data') WHERE question IS NOT NULL AND answer IS NOT NULL""")
def alce_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the records with one answer."""
    return ingest.alce_samples(table(spark, sf_dir, "raw_examples").where("dataset_id = 'mirror/alce-data'"), "rec_id", "split", "payload")


@query("""SELECT coalesce(replace(dataset_id, '/', '__'), 'none') AS dataset, coalesce(split, 'none') AS split, count(*) AS read, count(*) FILTER (WHERE CASE WHEN json_valid(payload) THEN json_type(payload::JSON) <> 'NULL' ELSE FALSE END) AS readable FROM raw_examples GROUP BY ALL""")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read and readable, by dataset and split."""
    raw = table(spark, sf_dir, "raw_examples")
    v = F.try_parse_json("payload")
    return raw.groupBy(F.coalesce(F.replace("dataset_id", F.lit("/"), F.lit("__")), F.lit("none")).alias("dataset"), F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("read"), F.count_if(v.isNotNull() & ~F.is_variant_null(v)).alias("readable"))


@query(f"""SELECT example_id, coalesce({_filled('a')}, {_filled('q')}, to_json({{'gold_answer': a, 'query': q}})::VARCHAR) AS text FROM (SELECT example_id, max(gold_answer) AS a, max(query) AS q FROM examples WHERE example_id IS NOT NULL GROUP BY example_id)""")
def pseudo_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document in place of missing ones, of each example's answer or query, or of its row."""
    once = table(spark, sf_dir, "examples").where("example_id is not null").groupBy("example_id").agg(F.max("gold_answer").alias("gold_answer"), F.max("query").alias("query"))
    return ingest.pseudo_documents(once, "example_id")


_FLAT = "coalesce(array_to_string(list_transform(list_filter(contexts, lambda c: c.text IS NOT NULL), lambda c: c.text), chr(10) || chr(10)), '')"


def _prompt_sql(mode: str) -> str:
    instruction = prompts.MODES[mode].replace("'", "''")
    return f"""'{instruction}' || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || 'Context:' || chr(10) || {_FLAT} || chr(10) || chr(10) || 'Answer:'"""


@query(f"SELECT ord, md5({_prompt_sql('base')}) AS base_md5, md5({_prompt_sql('selective_refusal')}) AS refusal_md5, length({_prompt_sql('base')}) AS n_chars FROM mixed_contexts")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of both modes for each mixed row."""
    base, refusal = (prompts.prompt(F.col("question"), F.col("contexts"), mode) for mode in prompts.MODES)
    return table(spark, sf_dir, "mixed_contexts").select("ord", F.md5(base).alias("base_md5"), F.md5(refusal).alias("refusal_md5"), F.length(base).alias("n_chars"))


@query(f"""SELECT ord, {_strip("CASE WHEN strpos(answer, 'Answer:') > 0 THEN substr(answer, strpos(answer, 'Answer:') + 7) ELSE answer END")} AS answer FROM phase1_gen_sample100""")
def answers_after_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each completion has after the first mark."""
    return table(spark, sf_dir, "phase1_gen_sample100").select("ord", prompts.after_mark(F.col("answer")).alias("answer"))


@query(f"""SELECT ord, claim_id FROM mixed_contexts WHERE contexts IS NULL OR len(contexts) <> 6 OR len(list_filter(contexts, lambda c: c IS NULL OR coalesce({_strip('c.text')}, '') = '')) > 0""")
def invalid_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed rows that do not have six contexts with text."""
    return prompts.invalid_contexts(table(spark, sf_dir, "mixed_contexts"), "contexts", 6).select("ord", "claim_id")


@query("""SELECT CAST(created_at AS DATE) AS day, coalesce(dataset_id, 'none') AS dataset_id, count(*) AS records,
count(*) FILTER (WHERE fetched_at > created_at + INTERVAL 1 DAY) AS late FROM raw_examples WHERE created_at IS NOT NULL GROUP BY ALL""")
def arrivals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records by the day they were made, and how many came late."""
    return arrivals.arrivals_by_day(table(spark, sf_dir, "raw_examples"), "dataset_id", "created_at", "fetched_at")


_SOME = "(SELECT claim_id, arg_max(claim_text, ord) AS claim_text FROM mixed_contexts WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL AND ord % 20 = 0 GROUP BY claim_id)"
_HITS = f"(SELECT query_id AS claim_id, doc_id, rank, coalesce(text, '') AS text FROM ({_bm25_sql(_DOCS, f'(SELECT claim_id AS query_id, claim_text AS text FROM {_SOME})')}) JOIN {_DOCS} d USING (doc_id))"


@query(f"""SELECT claim_id, position, doc_id, coalesce(title, '') AS title, md5(coalesce(text, '')) AS text_md5, label, rank, {_profile_sql("split_part(claim_id, '::', 1)")} AS mix_profile, drawn
FROM ({_selection_sql(12, _labelled_sql(_HITS, _SOME))}) JOIN {_DOCS} d USING (doc_id)""")
def mix_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve contexts for claims, from retrieval to texts. Queries are the claims of rows whose ord is divisible by 20."""
    some = table(spark, sf_dir, "mixed_contexts").where("claim_id is not null and claim_text is not null and ord % 20 = 0").groupBy("claim_id").agg(F.max_by("claim_text", "ord").alias("claim_text"))
    out = mixing.mix_contexts(some, _lookup(spark, sf_dir), seed=SEED, schedule=SCHEDULE)
    return out.withColumn("text_md5", F.md5("text")).drop("text")


_ONCE = "(SELECT example_id, any_value(docs) AS docs, max(gold_answer) AS gold_answer, max(query) AS query FROM examples WHERE example_id IS NOT NULL GROUP BY example_id)"
_ALL_DOCS = f"""(SELECT example_id, split_part(example_id, '_', 1) AS dataset, coalesce({_filled('d.doc_id')}, CAST(i - 1 AS VARCHAR)) AS doc_id, d.text AS text FROM
  (SELECT example_id, i, docs[i] AS d FROM (SELECT example_id, docs, unnest(range(1, len(docs) + 1)) AS i FROM {_ONCE})) WHERE {_filled('d.text')} IS NOT NULL
 UNION ALL SELECT example_id, split_part(example_id, '_', 1), example_id, coalesce({_filled('gold_answer')}, {_filled('query')}) FROM {_ONCE}
  WHERE docs IS NULL OR len(list_filter(docs, lambda d: d IS NOT NULL AND {_filled('d.text')} IS NOT NULL)) = 0)"""


@query(f"""SELECT example_id, dataset || '::' || doc_id || '::chunk' || i AS passage_id, doc_id, md5(array_to_string(part, ' ')) AS text_md5, len(part) AS n_tokens FROM ({_windows_sql(_ALL_DOCS, 64, 16)})""")
def corpus_of_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 64 tokens of the examples' documents, or of their answer or query where they have none."""
    once = table(spark, sf_dir, "examples").where("example_id is not null").groupBy("example_id").agg(F.first("docs", ignorenulls=True).alias("docs"), F.max("gold_answer").alias("gold_answer"), F.max("query").alias("query"))
    out = chunking.corpus_of(once, "example_id", "docs", ["gold_answer", "query"], F.split("example_id", "_")[0], 64, 16)
    return out.select("example_id", "passage_id", "doc_id", F.md5("text").alias("text_md5"), "n_tokens")


@query("""SELECT example_id, CASE WHEN len(c) > 0 THEN 'claims' WHEN a IS NOT NULL THEN 'answer' ELSE 'question' END AS source, CASE WHEN len(c) > 0 THEN len(c) ELSE 1 END AS n FROM (
  SELECT example_id, list_filter(any_value(gold_claims), lambda x: x IS NOT NULL) AS c, max(gold_answer) AS a, max(query) AS q FROM examples WHERE example_id IS NOT NULL GROUP BY example_id)
WHERE len(c) > 0 OR a IS NOT NULL OR trim(coalesce(q, '')) <> ''""")
def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the claims of each example come from, and how many there are."""
    once = table(spark, sf_dir, "examples").where("example_id is not null").groupBy("example_id").agg(F.first("gold_claims", ignorenulls=True).alias("c"), F.max("gold_answer").alias("a"), F.max("query").alias("q"))
    picked = once.withColumn("picked", ingest.claims_of(F.col("c"), F.when(F.col("a").isNotNull(), F.array("a")), F.col("q"))).where("picked is not null")
    has = F.size(F.filter(F.coalesce("c", F.array().cast("array<string>")), lambda x: x.isNotNull())) > 0
    return picked.select("example_id", F.when(has, "claims").when(F.col("a").isNotNull(), "answer").otherwise("question").alias("source"), F.size("picked").alias("n"))


@query("""WITH once AS (SELECT example_id, list_filter(any_value(gold_claims), lambda x: x IS NOT NULL) AS c, max(gold_answer) AS a, max(query) AS q FROM examples WHERE example_id IS NOT NULL GROUP BY example_id)
SELECT example_id AS qid, q AS question, example_id || '::c' || (generate_subscripts(l, 1) - 1) AS claim_id, unnest(l) AS claim_text FROM (SELECT *, CASE WHEN len(c) > 0 THEN c WHEN a IS NOT NULL THEN [a] WHEN trim(coalesce(q, '')) <> '' THEN [q] ELSE [] END AS l FROM once)""")
def claims_for_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim of each example, as mixing takes them."""
    once = table(spark, sf_dir, "examples").where("example_id is not null").groupBy("example_id").agg(F.first("gold_claims", ignorenulls=True).alias("c"), F.max("gold_answer").alias("a"), F.max("query").alias("q"))
    return mixing.claims_for_mixing(once.withColumn("answers", F.when(F.col("a").isNotNull(), F.array("a"))), "example_id", "q", "c", "answers")


@query(_BM25)
def saved_index_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index that is saved, and found again as that of this corpus."""
    path, corpus = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", _corpus(spark, sf_dir)
    retrieval.ensure_index(corpus, "passage_id", "text", path)
    return retrieval.search(retrieval.ensure_index(corpus, "passage_id", "text", path), table(spark, sf_dir, "eval_items").where("item_id % 20 = 0"), "item_id", "text")


def _as_lines(spark: SparkSession, df: DataFrame) -> str:
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    jsonl.write_jsonl(df, path, overwrite=False)
    return path


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(title, '') AS title, md5(text) AS text_md5 FROM documents WHERE {_filled('text')} IS NOT NULL""")
def json_lines_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as JSON lines, written and scanned again with counts of what is kept."""
    path = _as_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "title", "text"))
    return jsonl.scan_counted(spark, path)[0].select("doc_id", "title", F.md5("text").alias("text_md5"))


@query(f"""SELECT doc_id, coalesce({_filled('article_id')}, '-') AS id, {_filled('title')} AS title, md5({_filled('text')}) AS text_md5 FROM documents""")
def article_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of article records under any of their keys, from JSON lines scanned strictly; texts lie one object deeper."""
    docs = table(spark, sf_dir, "documents")
    path = _as_lines(spark, docs.select(F.col("doc_id").alias("n"), strip(F.col("article_id")).alias("pageid"), F.col("title").alias("article_title"), F.struct(F.col("text").alias("body")).alias("page")))
    v = F.col("v")
    picked = ingest.article_of(v)
    return jsonl.scan_strict(spark, path).select(F.try_variant_get(v, "$.n", "bigint").alias("doc_id"), F.coalesce(picked["id"], F.lit("-")).alias("id"), picked["title"].alias("title"), F.md5(picked["text"]).alias("text_md5"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5 FROM documents WHERE {_filled('text')} IS NOT NULL""")
def json_lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a corpus file, by id, or by line where there is none (here, all have one)."""
    path = _as_lines(spark, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text"))
    return jsonl.scan_documents(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query("""SELECT count(*) AS strict, count(*) AS tolerant, count(*) AS objects FROM raw_examples""")
def json_lines_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records as JSON lines, by each of the scans."""
    path = _as_lines(spark, table(spark, sf_dir, "raw_examples").select("rec_id", "dataset_id", "payload"))
    scans = {"strict": jsonl.scan_strict, "tolerant": jsonl.scan_tolerant, "objects": jsonl.scan_objects}
    rows = reduce(DataFrame.unionByName, [scan(spark, path).select(F.lit(name).alias("scan")) for name, scan in scans.items()])
    return rows.agg(*(F.count_if(F.col("scan") == name).alias(name) for name in scans))


_MERGED = "CASE WHEN json_type(v, '$.metadata') = 'OBJECT' THEN json_extract_string(v, '$.metadata.rev') END"


@query(f"""SELECT rec_id, coalesce(dataset_id, 'none') AS kept, 'all' AS overridden, coalesce({_MERGED}, '') AS rev FROM {_V}""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's metadata with the run's: what the record has counts, or what the run has, as asked."""
    rows = table(spark, sf_dir, "raw_examples").select("rec_id", "dataset_id", ingest.parsed(F.col("payload")).alias("v")).where("v is not null")
    own = F.map_from_arrays(F.array(F.lit("dataset_id"), F.lit("rev")), F.array(F.coalesce("dataset_id", F.lit("none")), F.coalesce(F.try_variant_get("v", "$.metadata.rev", "string"), F.lit(""))))
    run = F.create_map(F.lit("dataset_id"), F.lit("all"))
    kept, overridden = (ingest.merged_metadata(own, run, extra_wins) for extra_wins in (False, True))
    return rows.select("rec_id", kept["dataset_id"].alias("kept"), overridden["dataset_id"].alias("overridden"), kept["rev"].alias("rev"))


def _answers_sql() -> str:
    raw = "coalesce(" + ", ".join(f"CASE WHEN json_type(v, '$.{k}') <> 'NULL' THEN json_extract(v, '$.{k}') END" for k in ("gold_answer", "gold_answers", "answers")) + ")"
    each = f"CASE json_type(e) WHEN 'VARCHAR' THEN {_filled(_STRING.format('$').replace('(v', '(e'))} WHEN 'OBJECT' THEN {_no_junk(_STRING.format('$.text').replace('(v', '(e'))} END"
    listed = f"CASE json_type(x) WHEN 'ARRAY' THEN list_filter(list_transform(json_extract(x, '$[*]'), lambda e: {each}), lambda e: e IS NOT NULL) WHEN 'VARCHAR' THEN list_filter([{_filled(_STRING.format('$').replace('(v', '(x'))}], lambda e: e IS NOT NULL) ELSE [] END"
    other = "coalesce(" + ", ".join(f"CASE WHEN json_type(v, '$.{k}') = 'VARCHAR' THEN {_no_junk(_STRING.format('$.' + k))} END" for k in ingest.SAMPLE_ANSWER_KEYS) + ")"
    return f"SELECT rec_id, array_to_string(CASE WHEN len(l) > 0 THEN list_filter(l, lambda e, i: list_position(l, e) = i) WHEN o IS NOT NULL THEN [o] ELSE [] END, ' | ') AS answers FROM (SELECT rec_id, {listed} AS l, o FROM (SELECT rec_id, {raw} AS x, {other} AS o FROM {_V}))"


@query(_answers_sql())
def sample_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of every raw record, whatever form they have."""
    rows = table(spark, sf_dir, "raw_examples").select("rec_id", ingest.parsed(F.col("payload")).alias("v")).where("v is not null")
    return rows.select("rec_id", F.array_join(ingest.answers_of(F.col("v")), " | ").alias("answers"))
