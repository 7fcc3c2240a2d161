"""Texts that collide under polynomials modulo 2**64 stay apart, and very short texts are no trouble."""

import time

import numpy as np
import pytest

from ledgerweave.llm import langid, ngram_join, sentence_spans, suffix_dedup
from ledgerweave.llm.wordhash import running, second_hash, second_running, span_hash


def thue_morse(one, other, doublings):
    a, b = one, other
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_second_hash_parts_what_the_first_joins():
    a, b = thue_morse(b"a", b"b", 12)
    whole = [np.frombuffer(b"x" + t, np.uint8) for t in (a, b)]
    at = np.array([1]), np.array([len(a) + 1])
    assert span_hash(running(whole[0]), *at) == span_hash(running(whole[1]), *at)
    assert second_hash(second_running(whole[0]), *at) != second_hash(second_running(whole[1]), *at)
    # The same span has the same hash wherever it stands
    far = np.frombuffer(b"something before" + a, np.uint8)
    assert second_hash(second_running(far), np.array([16]), np.array([len(far)])) == second_hash(second_running(whole[0]), *at)


def test_jaccard_join_keeps_colliding_words_apart(spark):
    a, b = thue_morse("p", "q", 12)
    rows = [(1, f"one two {a} three four"), (2, f"one two {b} three four"), (3, f"ONE two {a} three four")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {1: (1, 1), 2: (2, 0), 3: (1, 1)}


@pytest.mark.parametrize("one,other,doublings", [("p", "q", 12), ("p ", "q ", 12)])
def test_spans_and_suffixes_keep_colliding_passages_apart(spark, one, other, doublings):
    """One word of 4,096 bytes, and one sentence of 4,096 words."""
    a, b = thue_morse(one, other, doublings)
    words = "some words around it so that a run is long enough to be looked at in this test. "
    rows = spark.createDataFrame([(1, words + a), (2, "other" + words + b)], "doc_id long, text string")
    got = sentence_spans.remove_repeated_spans(rows).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}


def test_suffix_names_keep_colliding_segments_apart():
    a, b = thue_morse(b"p", b"q", 12)
    found = [suffix_dedup.segments(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (a, b)]
    names = [set(f[4].tolist()) for f in found]
    spans = [{t[s : s + n + 99] for s, n in zip(f[1].tolist(), f[2].tolist(), strict=True)} for t, f in zip((a, b), found, strict=True)]
    assert len(names[0] | names[1]) >= len(spans[0] | spans[1])


def test_null_ids_cost_no_more_than_other_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base.replace("w7 ", f"x{k} ").replace("w50", f"y{k}") for k in range(1500)]
    took = []
    for ids in (range(1500), [None] * 1500):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        began = time.time()
        got = ngram_join.jaccard_components(df, width=4, percent=60).collect()
        took.append(time.time() - began)
        assert {r.n_links for r in got} == {1499} and len({r.component_id for r in got}) == 1
    assert took[1] < 2 * took[0] + 5


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "abcd", "abcde", "é", "€"])
def test_language_of_short_texts(spark, text):
    """Alone, as the whole table, and among the rows that are learned from."""
    pair = langid.grams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert [int((g < langid.SIZE).sum()) for g in pair] == [max(0, len(text.encode()) - 2), max(0, len(text.encode()) - 3)]
    alone = spark.createDataFrame([(1, text, "xx")], "doc_id long, text string, lang string")
    assert [(r.lang_pred) for r in langid.identify_language(alone).collect()] == ["xx" if text.isalpha() and len(text.encode()) > 2 else "und"]


def test_language_learns_among_short_texts(spark):
    rows = [(k, "ab" if k % 7 == 0 else ("der hund und die katze " if k % 2 else "the dog and the cat ") * 3, "de" if k % 2 else "en") for k in range(300)]
    got = langid.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in got if r.doc_id % 7)


def test_every_language_is_learned(spark):
    """More languages than any fixed number that was once the limit."""
    rows = [(k, f"{chr(0x4E00 + k % 520)}{chr(0x5200 + k % 520)} {chr(0x4E00 + k % 520)} z", f"l{k % 520:03d}") for k in range(1040)]
    sample, every = langid.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(every) == 520 and sample.select("lang").distinct().count() == 520
