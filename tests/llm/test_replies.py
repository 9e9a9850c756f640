import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from groundmill import session
from groundmill.llm import replies
from groundmill.llm.replies import clauses, copies, find_defects, is_empty, other_language

PROMPTS = ["Who founded the {} Press?", "When was the bridge of {} opened?", "Where did {} go to school?", "how long is the tunnel under the {}", "What was {} known for?", "Wer hat die Gesellschaft in {} gegründet?"]
NAMES = ["Varno", "Ostelin", "Brekka", "Tollund", "Mirave", "Quenby", "Harrow", "Selkirk", "Lindow", "Arden", "Pemberley", "Rosta"]


def found(spark, rows, cut=()):
    pairs = spark.createDataFrame(rows, "ord bigint, query string, answer string").selectExpr("*", "'x' AS kind", "'y' AS opening", "1 AS root")
    cuts = spark.createDataFrame([(c,) for c in cut], "ord bigint")
    out = {}
    for r in find_defects(pairs, cuts).collect():
        out.setdefault(r.ord, set()).add(r.defect)
    return out


def test_templates_that_recur_across_unrelated_prompts_are_refusals(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(120):
        name = rng.choice(NAMES)
        query = rng.choice(PROMPTS).format(name)
        kind = i % 5
        if kind == 0:
            answer = rng.choice(["This lies outside of the material I was shown.", "This lies outside of the material I was shown. Perhaps another source helps."])
            want[i] = {"refusal"} | ({"other_language"} if query.startswith("Wer") else set())
        elif kind == 1:  # a template, then a reply
            answer = f"Sources disagree on details. Still, {rng.choice(NAMES)} of {rng.choice(NAMES)} did so in {rng.randint(1700, 1999)}."
        elif kind == 2:
            answer = f"The passages list these:\n- {rng.choice(NAMES)}\n- {rng.choice(NAMES)} (ferry)"
        elif kind == 3:
            answer = f"{rng.choice(NAMES)} {rng.choice(NAMES)}"
        else:
            answer = f"It was {rng.choice(NAMES)} of {rng.choice(NAMES)}, in {rng.randint(1700, 1999)}. As for later years, I don't know."
        if query.startswith("Wer") and kind != 0:
            query = PROMPTS[0].format(name)
        rows.append((i, query, answer))
    assert found(spark, rows) == want


def test_other_defects(spark):
    q = "Who founded the Varno Press?"
    rows = [
        (1, q, None), (2, q, " \n"), (3, q, "N/A"), (4, q, "[]"), (5, q, "Answer:"), (6, q, q), (7, q, f'"{q}"'), (8, q, f"So, {q.lower()[:-1]}."), (9, q, f"{q} It was Ostelin Brekka."),
        (10, q, f"Reply from the passages alone.\n\nQuestion: {q}\n\nContext:\nIn 1800, the bridge was ope"), (11, q, f"Question: {q}\nContext: In 1800.\nAnswer: Ostelin Brekka"),
        (12, q, "Die Gesellschaft wurde von Ostelin im Jahr 1800 gegründet."), (13, q, "Его основал Ostelin в 1800 году."), (14, q, 'It was Ostelin. Its motto is "La mer nous garde et les îles".'), (15, q, "1800"), (16, q, "Ostelin Brekka"),
        (17, None, "I don't know."), (18, q, "I don't know."), (19, q, "Je ne sais pas."), (22, "When was it?", "I do not know."), (23, "Wer war es?", "I don’t know."), (24, "Where is it?", "Je ne sais pas."), (25, "Wann war es?", "Das ist mir nicht bekannt."), (20, q, "It was founded by Ost"), (20, q, "It was founded by Ost"), (21, q, "word " * 200_000),
    ]
    got = found(spark, rows, cut=[10, 20, 1])
    want = {i: {"empty"} for i in (1, 2, 3, 4, 5)} | {i: {"copies_question"} for i in (6, 7, 8)} | {10: {"copies_question", "truncated"}, 12: {"other_language"}, 13: {"other_language"}, 18: {"refusal"}, 19: {"refusal", "other_language"}, 22: {"refusal"}, 23: {"refusal"}, 24: {"refusal", "other_language"}, 20: {"truncated"}}
    assert got == want


def test_empty_table(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize(("answer", "query", "is_copy"), [("When was the mill completed?", "When was the mill first completed?", True), ("The mill was completed in 1800", "When was the mill first completed?", False), ("You would like to know the following: who wrote it all down", "Who wrote it all down?", True), ("", "Who?", False), ("Who wrote it all down? Ann.", "Who wrote it all down?", False)])
def test_copies(answer, query, is_copy):
    assert copies(answer, query) == is_copy


def test_languages_need_to_be_clear():
    assert not other_language("Varno", "Wer hat das gegründet?") and not other_language("1800", "Who was it?")
    assert other_language("The bridge was opened in the year 1800.", "Wann wurde das Museum in Varno eröffnet?")
    assert not other_language("A long loom.", "What was the Varno Society known for in Ostelin?")
    assert is_empty("​") and not is_empty("0")


def test_clauses_mask_the_prompt():
    got = clauses('None of the passages mention "The Old Bridge". Try again.', 'Who wrote "The Old Bridge"?')
    assert got[0][:3] == ("none of the passages mention *", [], False) and got[1][0] == "try again"
    assert clauses("I can't say, it doesn't.", "Who?")[0][0] == "i can not say it does not"


def test_found_has_only_rows_with_a_prompt(spark, sf):
    out = replies.p2_found(spark, sf)
    assert out.columns == ["ord", "defect"]
    rows = out.collect()
    assert len(rows) == len(set(rows)) > 0
    assert {r.ord for r in rows} <= {r.ord for r in replies.pairs_of(spark, sf).collect()}


def test_no_wording_is_a_refusal_by_itself(spark):
    assert found(spark, [(1, "Who founded it?", "I don't know."), (2, "When was it?", "Unanswerable given these passages."), (3, "Where is it?", "I cannot answer that.")]) == {}


def test_a_wording_of_one_kind_of_prompts_is_a_reply(spark):
    rows = [(i, f"Who founded the {n} Press?", "A very long story indeed.") for i, n in enumerate(NAMES)] + [(50, "When was it?", "A very long story indeed.")]
    assert found(spark, rows) == {}


def test_templates_about_the_prompt_may_name_a_variant_of_it(spark):
    rows = [(i, f"{'Who founded' if i % 2 else 'Where is'} {n}?", f"The passages say nothing at all about {n}.") for i, n in enumerate(NAMES)]
    rows += [(20, "When was Varno founded?", "The passages say nothing at all about Varnofield."), (21, "Who led Varno?", "It was founded by Ostelin."), (22, "When was Varno led?", "It was founded by Brekka.")]
    assert found(spark, rows) == {i: {"refusal"} for i in [*range(len(NAMES)), 20]}


def test_a_refusal_in_a_third_of_the_rows_and_an_id_with_most(spark):
    rows = [(i, "Who founded it?" if i % 4 else "When was it?", "I don't know." if i % 3 == 0 else f"It was {NAMES[i % 12]} of {NAMES[i % 11]}, in {1700 + i}.") for i in range(600)]
    assert found(spark, rows) == {i: {"refusal"} for i in range(0, 600, 3)}


def test_found_in_a_session_that_has_observed_something(spark, sf):
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    session.discard_written(spark)  # so that the model is fitted anew
    assert replies.p2_found(spark, sf).where("defect = 'truncated'").count() > 0
