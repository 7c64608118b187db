import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tastegrid.llm import toxicity
from tastegrid.llm.fuzzy import Automaton, edits_allowed

LABELS = "doc_id long, quality int, toxic int"
BAD = ["blockhead", "nitwit", "scoundrel", "worthless"]


def distance(a, b):
    """Edits between words, a swap of neighbours counting as one."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


def nearest(word, terms):
    found = []
    for term in terms:
        stem = term.removesuffix("*")
        ends = range(len(word) + 1) if term.endswith("*") else [len(word)]
        found += [(e, term) for n in ends if (e := distance(word[:n], stem)) <= edits_allowed(term)]
    return min(found, default=None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=3, max_size=9), min_size=1, max_size=4),
       st.lists(st.booleans(), min_size=4, max_size=4),
       st.lists(st.text(alphabet="abcd", max_size=11), max_size=6))
def test_automaton_like_brute_force(terms, stems, words):
    terms = sorted({t + "*" * (s and len(t) > 3) for t, s in zip(terms, stems)})
    automaton = Automaton(terms)
    for word in [*words, *(t.removesuffix("*") for t in terms)]:
        assert automaton.match(word) == nearest(word, terms)


def test_automaton_starts_anew_when_it_has_grown():
    automaton = Automaton(BAD)
    automaton.MOST_STATES = 3
    for word in ("blockheda", "blockhead", "blokhead", "nitwits", "other", "scoundrl"):
        assert automaton.match(word) == nearest(word, BAD)


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfglm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randrange(60)}"
                 for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(40), rng.choice(BAD))
        elif i % 6 == 1:
            words[20:20] = ["they", "said", '"' + rng.choice(BAD) + '"', "is", "a", "word"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, LABELS))


def scores(model, *texts):
    find = model.matcher()
    return toxicity.probability(np.array([model.features(t, find) for t in texts]), model.weights)


def test_learns_the_lexicon_and_misspellings(model):
    assert set(BAD) <= {model.matcher()(word)[1] for word in BAD} | {
        word for word in BAD if model.matcher()(word)[1].endswith("*")}
    high = scores(model, "you blockhead and nitwit", "what a SCOUNDREL", "a worthless nitwit")
    assert (high > 0.5).all()
    assert (scores(model, "", "a plain text of words", "worth a block") < 0.5).all()


def test_quotations_score_lower_than_abuse(model):
    abuse, quoted = scores(model, "go on you nitwit", 'she said "nitwit" is a word')
    assert quoted < abuse
    assert toxicity.quotation('he said "nitwit" once', 9, 15) == 1.0
    assert toxicity.quotation("go you nitwit", 7, 13) == 0.0


def test_held_out_documents(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(rows) and 60 < len(held) < 180
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_nulls_repeats_and_clashing_columns(documents, spark):
    rows, labels = corpus(240)
    docs = documents([*rows, (None, "a blockhead"), (5, None), (5, ""), (9, "long " * 200_000)])
    docs = docs.withColumn("score", F.lit(1)).withColumn("label", F.lit(2)).withColumn("weight", F.lit(3))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (10**9, None, 1)], LABELS)
    out = toxicity.score_documents(docs, marks)
    assert out.count() == docs.count()
    assert out.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    left = toxicity.drop_toxic(docs, docs, marks)
    assert left.columns == docs.columns and left.count() < docs.count()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)]])
def test_without_both_labels_nothing_is_toxic(documents, spark, labels):
    docs = documents([(1, "some words"), (2, "more words"), (3, None)])
    out = toxicity.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 3
    assert toxicity.score_documents(documents([]), spark.createDataFrame(labels, LABELS)).count() == 0
