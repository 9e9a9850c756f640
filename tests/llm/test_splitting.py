import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundmill.llm.splitting import cut, split, valley_depths, _boundaries
from groundmill.llm.tokens import RANKS, tokenizer

TOPICS = [["river", "water", "bridge", "flood", "harbour"], ["music", "violin", "orchestra", "concert", "tempo"], ["bread", "flour", "oven", "baker", "yeast"]]


def topic(k, sentences):
    random.seed(k * 100 + sentences)
    return " ".join(" ".join(random.choice(TOPICS[k]) for _ in range(8)).capitalize() + "." for _ in range(sentences))


def check(text, limit, overlap):
    """The pieces cover the text in order, overlap as told, and are within the limit when sized by themselves."""
    encoder = tokenizer(RANKS)
    pieces = list(cut(text, encoder, limit, overlap))
    at = 0
    for k, (piece, a, b, n) in enumerate(pieces):
        assert encoder.size(text[a:b]) <= limit and n <= limit and a <= at and b > at
        assert k == 0 and a == 0 or k and pieces[k - 1][1] < a
        if k:
            assert piece.overlap >= min(overlap, pieces[k - 1][0].end - pieces[k - 1][0].start)
        at = b
    assert at == len(text)
    return pieces


@pytest.mark.parametrize(("limit", "overlap"), [(64, 0), (64, 16), (256, 32)])
def test_pieces_of_all_kinds_of_text(limit, overlap):
    check(topic(0, 80), limit, overlap)
    check("\r\n\r\n".join(topic(k % 3, 5) for k in range(12)), limit, overlap)
    check("x" * 5000, limit, overlap)
    check("ab1" * 3000 + " " + "é" * 3000, limit, overlap)
    check("日本語の文章。" * 300, limit, overlap)
    check("\n" * 4000 + "end", limit, overlap)
    check("a " * 4000, limit, overlap)
    check("one", limit, overlap)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é😀日.!?\n\r\t  -1"), min_size=1, max_size=600))
def test_any_text(text):
    if text.strip():
        check(text, 24, 6)


def test_cuts_at_the_change_of_topic():
    text = f"{topic(0, 14)} {topic(1, 14)}"
    change = len(topic(0, 14))
    encoder = tokenizer(RANKS)
    limit = int(encoder.size(text[:change]) * 1.3)
    pieces = list(cut(text, encoder, limit, 0))
    assert pieces[0][2] == change and pieces[0][0].boundary == "sentence"
    at, _ = _boundaries(text)
    depth = valley_depths(text, at)
    assert at[depth.argmax()] == change


def test_rows(spark):
    rows = [(1, topic(0, 60)), (2, None), (3, ""), (4, " \n "), (5, "short"), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS piece", "'x' AS boundary")
    got = split(df, "doc_id", "text", 128, 16).collect()
    assert {r.doc_id for r in got} == {1, 5} and [(r.piece, r.n_pieces, r.text) for r in got if r.doc_id == 5] == [(0, 1, "short")] * 2
    one = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in one] == list(range(len(one))) and all(r.n_pieces == len(one) for r in one) and all(rows[0][1][r.char_start : r.char_end] == r.text for r in one)
    assert all(a.text.endswith(b.text[: a.char_end - b.char_start]) and a.char_end > b.char_start for a, b in zip(one, one[1:]))
    assert split(df.where("false"), "doc_id", "text", 128, 16).count() == 0
    with pytest.raises(ValueError):
        split(df, "doc_id", "text", 32, 32)


def test_work_is_linear_in_length():
    encoder = tokenizer(RANKS)
    assert len(list(cut(topic(0, 40) * 200, encoder, 256, 32))) > 300
