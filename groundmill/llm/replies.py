"""Problem 2: defective pairs of a prompt and its response.

Refusals are found by recurrence alone. A response whose clauses have no figures of their own may be one; the opening of
each of its clauses is taken with the prompt's own words masked. Openings are clustered by verified MinHash over runs of
characters. A cluster that recurs across unrelated prompts (of several kinds, told apart by their first word, none of
which has nearly all of its prompts) is a template. A response is a refusal if its first clause is a template without a
name that is neither the prompt's nor the template's, and no later clause says more than that: what follows a template
such as "sources disagree, still" is a reply. A refusal whose wording no other prompt has gets none, so that a table of a
few hundred rows shows fewer of its refusals than a large one.
The other defects need no other row: a response that is the prompt given back, one that has no content, one whose
function words are another language's than the prompt's (of the languages listed below, or of another script), and one
that the truncation model of problem 4 finds cut off.

Scale: clustering sees distinct masked openings, after folding; prompts are counted per opening and kind before clusters
are known, so that neither a refusal nor a prompt in a third of the rows is a group in one task. Rows meet templates by
a join that broadcasts the openings that much of the rows have, and shuffles the others. Nothing of the size of the data
comes to the driver.

Defined results: a null or blank response is ``empty``; rows without a prompt (null, blank or unknown id, or a null
query) have no defect; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmill.functions.text import WS, strip
from groundmill.llm.near import components, near_links
from groundmill.llm.truncation import core, is_cut, scored_answers
from groundmill.llm.words import WORD
from groundmill.session import join_hot, spread, table, written

#: A template recurs with prompts of so many kinds; the share of its prompts that one kind may have at most. The wording
#: of a reply belongs to one kind of prompts, and only by chance to a stray one of another.
LEAST_KINDS = 2
MOST_OF_A_KIND = 0.75
OPENING_WORDS = 8
#: The share of a template's prompts in which a capitalised word must stand to be the template's own.
OWN_WORD = 0.4
#: The share of a template's prompts in which it has no name but the prompt's, to be one that speaks of the prompt.
ABOUT_PROMPT = 0.5
#: Stands for a quotation of the prompt's (a letter that texts hardly have).
TITLE = "\ua66e"

# What stands in for content that is missing.
PLACEHOLDERS = frozenset({"null", "none", "nil", "nan", "na", "n a", "blank", "empty", "answer", "response", "output", "placeholder", "undefined", "missing", "tbd", "todo"})
LABELS = frozenset({"a", "answer", "response", "reply", "antwort", "réponse", "respuesta"})

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and was were by is are not that with from which for on to it in a an who what when where how did many i",
    "de": "der die das und wurde ist nicht von dem den ein eine im für sich liegt es ich in wer wann hat zu keine",
    "fr": "le la les des est une et du dans qui pas sur au par pour été ne de en se quand je ce",
    "es": "el la los las fue es una del en que por con no está se y lo un de quién cuándo qué sé esto esa",
    "nl": "de het een en van werd is niet aan in met voor op door naar dat ligt na",
    "it": "il lo la gli è una di che non del della per con stato fu al nel si dopo",
    "pt": "o a os as é uma do da que não em no na foi por com ao fica depois",
    "pl": "i w z na nie jest do przez się że od nad po roku został leży",
}
_FUNCTION = {w: tuple(k for k, ws in FUNCTION_WORDS.items() if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")

# Verbs that a prompt has by grammar alone.
AUXILIARIES = frozenset({"do", "does", "did"})
# Contractions, which are read as the words they stand for.
CONTRACTIONS = (("dont", "do not"), ("can't", "can not"), ("cannot", "can not"), ("won't", "will not"), ("n't", " not"), ("'m", " am"), ("'d", " would"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"))
_CONTRACTED = re.compile("|".join(rf"{c}\b" for c, _ in CONTRACTIONS), re.I)
_EXPANDED = dict(CONTRACTIONS)
_QUOTED = re.compile(r"[\"“„«][^\"”“»]*[\"”“»]")
_ITEM = re.compile(r"\s*[-*•–]\s+\S")
_CLAUSE = re.compile(r"(?<=[.!?;:])[\"”»')\]]*\s+|\n+")
_LABELLED = re.compile(r"(?:^|\n)\s*(?:context|passages?|documents?|kontext|contexte|contexto)\s*:", re.I)
_ASKED = re.compile(r"(?:^|\n)\s*(?:question|query|prompt|frage|pregunta)\s*:", re.I)
_REPLY = re.compile(r"(?:^|\n)\s*(?:answer|response|antwort|réponse|respuesta)\s*:", re.I)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _find(part: list[str], whole: list[str]) -> list[int]:
    n = len(part)
    return [i for i in range(len(whole) - n + 1) if whole[i] == part[0] and whole[i : i + n] == part] if n else []


def is_empty(answer: str | None) -> bool:
    own = words(answer or "")
    return not own or " ".join(own) in PLACEHOLDERS


def copies(answer: str, query: str) -> bool:
    """Gives back the query, or a prompt with context, and nothing in reply."""
    reply = list(_REPLY.finditer(answer))
    if reply and words(answer[reply[-1].end() :]):
        return False
    a, q = words(answer), words(query)
    if not a or not q:
        return False
    at = _find(q, a)
    if at:
        rest = [w for w in a[at[-1] + len(q) :] if w not in LABELS]
        lead = a[: at[0]]
        if not rest and len(lead) <= 10 and not any(w.isdigit() for w in lead):
            return True
    if len(a) >= 4 and 2 * len(a) >= len(q) and q[: len(a)] == a:
        return True
    # The query with words left out, perhaps after a lead-in.
    for i in [i for i, w in enumerate(a[:10]) if w == q[0]]:
        rest = iter(q)
        if 10 * (len(a) - i) >= 6 * len(q) and len(a) - i >= 4 and all(w in rest for w in a[i:]):
            return True
    if _LABELLED.search(answer):
        head = answer[: _LABELLED.search(answer).start()]
        return len(words(head)) <= 40 + len(q)
    asked = _ASKED.search(answer)
    return bool(asked and asked.start() == 0 and q[: len(words(answer[asked.end() :]))] == words(answer[asked.end() :]))


def languages(tokens: list[str]) -> dict[str, float]:
    """How much of each language's function words there are; a word that several languages have counts in parts.
    Capitalised words count only if they are function words of one language. Foreign scripts count by letter."""
    counts = dict.fromkeys((*FUNCTION_WORDS, "script"), 0.0)
    for w in tokens:
        of = _FUNCTION.get(w.lower(), ())
        for k in of:
            counts[k] += 1 / len(of)
    letters = [c for w in tokens for c in w if c.isalpha()]
    foreign = sum(not _LATIN.match(c) for c in letters)
    if foreign >= 5 and foreign * 4 >= len(letters):
        counts["script"] = 10.0 + foreign
    return counts


def other_language(answer: str, query: str) -> bool:
    """Both languages are clear, and they differ. Quotations, and names that the prompt has, do not count."""
    asked = languages(WORD.findall(_QUOTED.sub(" ", query)))
    of_query = max(asked, key=asked.__getitem__)
    if not asked[of_query] or sorted(asked.values())[-2] == asked[of_query]:
        return False
    own = {w for w in WORD.findall(query) if w[:1].isupper()}
    rest = [w for w in WORD.findall(_QUOTED.sub(" ", answer)) if w not in own or w.lower() in _FUNCTION]
    got = languages(rest)
    of_answer = max(got, key=got.__getitem__)
    most, mine = got[of_answer], got[of_query]
    if of_answer == of_query or len(rest) < 3:
        return False
    return most >= 1.5 and most >= 2 * mine or most >= 1 and not mine


def clauses(answer: str, query: str) -> list[tuple[str, list[str], bool, int]]:
    """By clause: its opening with the prompt's words (but function words) and with names masked, the names that are not
    the prompt's, whether it has figures that are not the prompt's or is an item of a list, and how many of the prompt's
    words it has."""
    own = set(words(query))
    telling = own - _FUNCTION.keys() - AUXILIARIES
    out = []
    # A quotation that the prompt has, such as a title, is masked as one.
    known = lambda m: TITLE if own.issuperset(words(m[0])) else m[0]
    text = _CONTRACTED.sub(lambda m: _EXPANDED[m[0].lower()], core(answer)[0].replace("’", "'"))
    for part in _CLAUSE.split(_QUOTED.sub(known, text)):
        tokens = WORD.findall(part)
        if not tokens:
            continue
        masked: list[str] = []
        names: list[str] = []
        for i, t in enumerate(tokens):
            mask = t.lower()
            if mask == TITLE or mask in telling or mask in own and i and t[0].isupper() and len(t) > 1:
                mask = "*"
            elif i and t[0].isupper() and len(t) > 1:
                names.append(t)
                mask = "*"
            if mask != "*" or not masked or masked[-1] != mask:
                masked.append(mask)
        figures = bool(_ITEM.match(part)) or any(t.lower() not in own and any(c.isdigit() for c in t) for t in tokens)
        out.append((" ".join(masked[:OPENING_WORDS]), names, figures, len(telling.intersection(t.lower() for t in tokens))))
    return out


def gives_back_whole(answer: str, query: str) -> bool:
    """Ends with the whole query, or with the label of a reply: a copy that is not cut off."""
    a, q = words(answer), words(query)
    return a[-len(q) :] == q or bool(_REPLY.search(answer)) and not words(answer[list(_REPLY.finditer(answer))[-1].end() :])


JUDGED = "ord bigint, kind string, query string, empty boolean, whole boolean, copies boolean, other boolean, clauses array<struct<opening: string, names: array<string>, figures: boolean, asked: int>>"


def _judged(pairs: DataFrame) -> DataFrame:
    """What can be said of a pair by itself, and its clauses."""
    clause_type = pa.list_(pa.struct([("opening", pa.string()), ("names", pa.list_(pa.string())), ("figures", pa.bool_()), ("asked", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for query, answer in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                empty = is_empty(answer)
                copy = not empty and copies(answer, query)
                rows[0].append(next(iter(words(query)), ""))
                rows[1].append(empty)
                rows[2].append(copy and gives_back_whole(answer, query))
                rows[3].append(copy)
                rows[4].append(not empty and not copy and other_language(answer, query))
                rows[5].append([dict(zip(("opening", "names", "figures", "asked"), c)) for c in clauses(answer, query)] if not empty and not copy else [])
            arrays = [batch.column(0), pa.array(rows[0], pa.string()), batch.column(1), *(pa.array(r, pa.bool_()) for r in rows[1:5]), pa.array(rows[5], clause_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=["ord", "kind", "query", "empty", "whole", "copies", "other", "clauses"])

    return spread(pairs.select("ord", "query", "answer")).mapInArrow(run, JUDGED)


def _templates(clause: DataFrame) -> DataFrame:
    """h, own, about: the openings (by hash) of the clusters that recur across unrelated prompts, the template's own
    names, and whether what it speaks of is mostly what the prompt has: where it then has another name, that is a variant
    of the prompt's, where it doesn't, a reply.

    ``clause`` has h, opening, kind, prompt, names. Clusters are joined by resemblance in runs of five characters.
    """
    bare = F.countDistinct(F.when(F.size("names") == 0, F.col("prompt")))
    counted = written(clause.groupBy("h", "opening", "kind").agg(F.countDistinct("prompt").alias("n"), bare.alias("bare")), "counted")
    distinct = counted.select("h", "opening").distinct()
    found = near_links(distinct, "h", "opening", words=5, similarity=0.8, units="chars")
    roots = found.members.select(F.col("id").alias("h"), "cls").join(components(found.links), "cls").select("h", "root")
    rooted = counted.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    kinds = rooted.groupBy("root", "kind").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"))
    kinds = kinds.groupBy("root").agg(F.sum("n").alias("prompts"), F.sum("bare").alias("bare"), F.max("n").alias("most"), F.count("*").alias("kinds"))
    recurring = kinds.where((F.col("kinds") >= LEAST_KINDS) & (F.col("most") <= MOST_OF_A_KIND * F.col("prompts"))).select("root", "prompts", (F.col("bare") >= ABOUT_PROMPT * F.col("prompts")).alias("about"))
    templates = written(rooted.select("h", "root").distinct().join(recurring, "root"), "templates")
    # A capitalised word is the template's own if much of its prompts have it there (nouns, in German).
    names = clause.select("h", "prompt", F.explode(F.array_distinct("names")).alias("name")).groupBy("h", "name").agg(F.countDistinct("prompt").alias("n"))
    names = names.join(templates, "h").groupBy("root", "name").agg(F.sum("n").alias("n"), F.first("prompts").alias("prompts"))
    own = names.where((F.col("n") >= 2) & (F.col("n") >= OWN_WORD * F.col("prompts"))).groupBy("root").agg(F.collect_list("name").alias("own"))
    return templates.join(own, "root", "left").select("h", F.coalesce("own", F.array().cast("array<string>")).alias("own"), "about")


def refusals(judged: DataFrame) -> DataFrame:
    """ord of the pairs whose response declines the question as a whole."""
    maybe = judged.where((F.size("clauses") > 0) & ~F.exists("clauses", lambda c: c["figures"]))
    clause = maybe.select("ord", "kind", F.xxhash64("query").alias("prompt"), F.posexplode("clauses").alias("i", "c")).select("ord", "kind", "prompt", "i", "c.opening", "c.names", "c.asked")
    parts = F.split("opening", " ")
    clause = written(clause.select("*", F.xxhash64("opening").alias("h"), F.size(parts).alias("n_words"), F.size(F.filter(parts, lambda w: w != "*")).alias("told")), "clauses")
    # The first clause decides whether a response may decline at all, so only the openings of such responses matter.
    templates = written(_templates(clause.where("told >= 2")), "recurring")
    weights = clause.groupBy("h").agg(F.count("*").alias("n"))
    met = join_hot(clause.drop("opening", "kind", "prompt"), weights.join(templates, "h"), "h", "n", clause.count())
    fits = F.coalesce(F.col("about") | (F.size(F.array_except("names", "own")) == 0), F.lit(False))
    more = (F.size("names") > 0) | (F.col("asked") >= 3) | (F.col("n_words") >= OPENING_WORDS)
    told = met.groupBy("ord").agg(F.max((F.col("i") == 0) & fits).alias("declines"), F.max((F.col("i") > 0) & ~fits & more).alias("replies"))
    return told.where("declines and not replies").select("ord")


def find_defects(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """ord, defect. ``pairs``: ord, query (not null), answer; ``cut``: ord of the responses that were cut off."""
    judged = written(_judged(pairs.where("query is not null")), "judged")
    own = judged.select("ord", F.explode(F.array_compact(F.array(F.when(F.col("empty"), F.lit("empty")), F.when(F.col("copies"), F.lit("copies_question")), F.when(F.col("other"), F.lit("other_language"))))).alias("defect"))
    refused = refusals(judged).select("ord", F.lit("refusal").alias("defect"))
    truncated = judged.where("not empty and not whole").join(cut.select("ord"), "ord", "left_semi").select("ord", F.lit("truncated").alias("defect"))
    return own.unionByName(refused).unionByName(truncated).distinct()


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, query, answer of the answers whose trimmed id has an example with a query. An id may have much of the answers."""
    queries = table(spark, sf_dir, "examples").where("example_id is not null and query is not null").groupBy(F.col("example_id").alias("key")).agg(F.max("query").alias("query"))
    generated = table(spark, sf_dir, "phase1_gen_sample100").select("ord", strip(F.col("id")).alias("key"), "answer")
    weights = generated.groupBy("key").agg(F.count("*").alias("n"))
    met = join_hot(generated, queries.join(weights, "key"), "key", "n", generated.count())
    return met.where("query is not null").select("ord", "query", "answer")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = written(pairs_of(spark, sf_dir), "pairs")
    scored = scored_answers(spark, sf_dir, ["ord"], ("phase1_gen_sample100",)).where(is_cut(F.col("score")))
    return find_defects(pairs, scored)


def p2_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs whose answer has no content: those of ``p2_found`` that SQL can tell."""
    return _judged(pairs_of(spark, sf_dir)).where("empty").select("ord")


QUERIES = {"p2_found": p2_found, "p2_empty": p2_empty}
_WORDS = "regexp_extract_all(lower(coalesce(answer, '')), '[\\p{L}\\p{N}]+')"
ORACLES = {
    "p2_empty": f"""SELECT ord FROM phase1_gen_sample100 JOIN (SELECT DISTINCT example_id FROM examples WHERE query IS NOT NULL) ON example_id = regexp_replace(id, '^[{WS}]+|[{WS}]+$', '', 'g')
WHERE array_to_string({_WORDS}, ' ') IN ('', {', '.join(f"'{p}'" for p in sorted(PLACEHOLDERS))})""",
}
