"""Toxicity: lexicon terms, also misspelled, weighed by what stands around them.

The lexicon, the words that only look like its terms, and the weights are learned from
a bounded sample of labelled documents. Terms are found by an automaton (``fuzzy``);
the words around a hit tell a quotation or a report from abuse.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .stages import staged
from .columns import remainder
from .fuzzy import Automaton

# Labelled documents of each label that the model is fitted on, those with the
# smallest hash; all of them where there are fewer.
SAMPLE = 10_000
# A term: so many letters at least (a stem: STEM); found in at least this part of the
# toxic documents, counted by the words before it, and so many times as often as in the
# others.
LETTERS, STEM, LONGEST_STEM = 3, 4, 8
PART, LEAST, TIMES = 0.01, 3, 6.0
# A term that more words of clean documents look like is taken only as it is.
CROWD = 2
# A longer term replaces its start if it covers this part of the start's places.
COVERS = 0.9
# Characters on either side of a hit that are its context.
WINDOW = 60
# Words of a worker's memory.
MEMORY = 500_000

WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»‹›‘’`]")
# Words that report speech, and words that address a person.
REPORTS = frozenset(
    "said says say called calls wrote writes quoted quote quotes quoting word words term terms "
    "insult insults slur slurs phrase report reported article study dit mot citation sagte wort "
    "zitat dijo palabra cita".split()
)
ADDRESSES = frozenset("you your yours youre u ur du dich dein tu vous toi te ti usted tú".split())


# Numbers that describe a document.
FEATURES = 6


@dataclass
class Model:
    """``terms`` and their weights, stems marked by *; ``known`` words that are never
    misspellings, ``strict`` terms that are never misspelled; weights of the features,
    the constant last."""

    terms: dict[str, float] = field(default_factory=dict)
    known: frozenset = frozenset()
    strict: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def matcher(self):
        """A function from a word to (edits, term) or None, with a bounded memory."""
        automaton, memory = Automaton(self.terms), {}

        def find(word):
            try:
                return memory[word]
            except KeyError:
                if len(memory) > MEMORY:
                    memory.clear()
                found = automaton.match(word)
                if found and found[0] and (word in self.known or found[1] in self.strict):
                    found = None
                memory[word] = found
                return found

        return find

    def features(self, text: str, find) -> list[float]:
        """The strongest abuse in plain words, all of it, and how much of the text it is;
        the strongest misspelled and all of that; what is quoted. A term counts by its
        weight, and a context's score says which part of it is abuse."""
        text = text.lower()
        words = set(WORD.findall(text))
        if not any(map(find, words)):
            return [0.0] * FEATURES
        # A word counts once, by its most abusive place.
        plain, misspelled, quoted = {}, {}, {}
        for word in WORD.finditer(text):
            hit = find(word[0])
            if hit:
                quote, weight = quotation(text, *word.span()), self.terms[hit[1]]
                kind = misspelled if hit[0] else plain
                kind[word[0]] = max(kind.get(word[0], 0.0), (1 - quote) * weight)
                quoted[word[0]] = max(quoted.get(word[0], 0.0), quote * weight)
        abuse = sum(plain.values())
        return [
            max(plain.values(), default=0.0), math.log1p(abuse), math.sqrt(abuse / len(words)),
            max(misspelled.values(), default=0.0), math.log1p(sum(misspelled.values())),
            math.log1p(sum(quoted.values())),
        ]


# --- one document

def quotation(text: str, start: int, end: int) -> float:
    """From the context of ``text[start:end]``: 0 abuse, 1 a quotation or report."""
    left, right = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    words = set(WORD.findall(left)) | set(WORD.findall(right))
    quoted = len(QUOTES.findall(left)) % 2 == 1 and QUOTES.search(right) is not None
    score = 0.6 * quoted + 0.4 * bool(words & REPORTS) - 0.3 * bool(words & ADDRESSES)
    return min(1.0, max(0.0, score))


def own_words(text: str) -> set[str]:
    """The words of ``text`` that aren't all quoted or reported: whoever quotes a term
    doesn't speak against its being one."""
    if not QUOTES.search(text):
        return set(WORD.findall(text))
    return {word[0] for word in WORD.finditer(text) if quotation(text, *word.span()) < 0.5}


def probability(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ weights[:-1] + weights[-1], -30, 30)))


# --- fitting

def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic",
                    sample: int = SAMPLE) -> DataFrame:
    """``(text, label, weight)`` of at most ``sample`` documents of each label; the
    weights restore how often the labels are."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)"
    )
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    chosen = []
    for value in (0, 1):
        weight = max(1.0, counts.get(value, 0) / sample)
        chosen.append(
            known.where(F.col("label") == value).withColumn("weight", F.lit(weight))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        )
    # The sample has a proven bound, so it may go to every executor.
    rows = staged(chosen[0].union(chosen[1]), "labelled-ids")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return staged(
        texts.join(F.broadcast(rows), "doc_id").select("text", "label", "weight"), "labelled-texts"
    )


def _starts(word: str):
    """The terms that a word can stand for: itself, and its beginnings as stems."""
    yield word
    for size in range(STEM, min(LONGEST_STEM, len(word) - 1) + 1):
        yield word[:size] + "*"


def toxic_terms(sample: DataFrame) -> dict[str, float]:
    """The lexicon, with the log-odds of each term. A term's places in toxic documents are counted by the distinct words
    before it, so that copies of one document don't make a term of each of its words."""
    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}

    def places(batches):
        for batch in batches:
            found = set()
            for text in batch.column(0):
                words = WORD.findall(text.as_py().lower())
                for before, word in zip(["", *words], words):
                    if len(word) >= LETTERS:
                        found.update((term, before) for term in _starts(word))
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in found], pa.string()),
                 pa.array([b for _, b in found], pa.string())], names=["term", "before"])

    least = max(LEAST, PART * sizes[1])
    often = (
        sample.where("label = 1").select("text").mapInArrow(places, "term string, before string")
        .distinct().groupBy("term").agg(F.count("*").alias("places"))
        .where(F.col("places") >= least)
    )
    places_of = {row["term"]: row["places"] for row in often.collect()}

    def documents(batches):
        for batch in batches:
            found = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(0), batch.column(1)):
                terms = {term for word in own_words(text.as_py().lower()) for term in _starts(word)}
                found[label.as_py()].update(terms & places_of.keys())
            rows = [(t, label, n) for label, counts in found.items() for t, n in counts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(
                    zip(*rows) if rows else ([], [], []), (pa.string(), pa.int32(), pa.int64()))],
                names=["term", "label", "n"])

    counted = (
        sample.select("text", "label").mapInArrow(documents, "term string, label int, n long")
        .groupBy("term", "label").agg(F.sum("n").alias("n")).collect()
    )
    docs_with = {(row["term"], row["label"]): row["n"] for row in counted}
    strength, odds = {}, {}
    for term in places_of:
        toxic = docs_with.get((term, 1), 0) / sizes[1]
        clean = (docs_with.get((term, 0), 0) + 0.5) / sizes[0]
        if toxic >= TIMES * clean:
            strength[term], odds[term] = places_of[term], math.log(toxic / clean)
    return {term: odds[term] for term in chosen_terms(strength)}


def chosen_terms(strength: dict[str, int]) -> list[str]:
    """Of terms that are starts of each other, those that cover the most, and of equal
    ones the longest: a stem that one longer term nearly covers gives way to it, and
    what a kept stem covers isn't needed."""
    longer: dict[str, int] = {}
    for term, places in strength.items():
        letters = term.removesuffix("*")
        for size in range(STEM, len(letters) + (not term.endswith("*"))):
            stem = letters[:size] + "*"
            longer[stem] = max(longer.get(stem, 0), places)
    kept: set[str] = set()
    for term in sorted(strength, key=lambda t: (len(t.removesuffix("*")), t)):
        letters = term.removesuffix("*")
        covered = any(letters[:size] + "*" in kept for size in range(STEM, len(letters) + 1))
        replaced = term.endswith("*") and longer.get(term, 0) >= COVERS * strength[term]
        if not covered and not replaced:
            kept.add(term)
    return sorted(kept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of ``labels (doc_id, <label>)`` from the texts of ``docs``.

    Without rows of both labels, or without a term that tells them apart, nothing is
    ever found and every score is the part of toxic documents (a half at most)."""
    rows = labelled_sample(docs, labels, label, sample)
    terms = toxic_terms(rows)
    model = Model(terms)

    def look_alikes(batches):
        find = model.matcher()
        for batch in batches:
            words = set()
            for text in batch.column(0):
                words.update(WORD.findall(text.as_py().lower()))
            near = [(word, hit[1]) for word in words if (hit := find(word)) and hit[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in near], pa.string()),
                 pa.array([t for _, t in near], pa.string())], names=["word", "term"])

    if terms:
        clean = rows.where("label = 0").select("text")
        near = clean.mapInArrow(look_alikes, "word string, term string").distinct().collect()
        crowd = Counter(row["term"] for row in near)
        model = Model(terms, frozenset(row["word"] for row in near),
                      frozenset(term for term, n in crowd.items() if n > CROWD))

    def measure(batches):
        find = model.matcher()
        for batch in batches:
            found = [model.features(text.as_py(), find) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                names=["x", "label", "weight"])

    measured = rows.mapInArrow(measure, "x array<double>, label int, weight double").collect()
    x = np.array([row["x"] for row in measured]).reshape(-1, FEATURES)
    y = np.array([row["label"] for row in measured], float)
    w = np.array([row["weight"] for row in measured])
    return Model(model.terms, model.known, model.strict, logistic(x, y, w))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, none of them below 0: a hit
    never speaks for a document. The constant is last, and never above 0."""
    used = list(range(x.shape[1]))
    while True:
        rows = np.column_stack([x[:, used], np.ones(len(x))])
        ridge = np.diag([penalty] * len(used) + [1e-3])
        at = np.zeros(len(used) + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ at, -30, 30)))
            slope = rows.T @ (weight * (y - p)) - ridge @ at
            curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge
            step = np.linalg.solve(curve, slope)
            at = at + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        if (at[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = at[:-1], min(0.0, at[-1])
            return out
        used = [i for i, value in zip(used, at) if value >= 0]


# --- the operator

def toxicity(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1; a null text is scored as an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        find = model.matcher()
        rows = np.array([model.features(t or "", find) for t in texts]).reshape(-1, FEATURES)
        return pd.Series(probability(rows, model.weights))

    return score(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, held_out_fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs (doc_id, text)``.

    The model learns from rows whose crc32(doc_id as text) modulo ``held_out_fold`` is
    not 0, the others are held out; a row without id is neither held out nor learned
    from. Repeated rows are scored each; other columns are not read.
    """
    learned = labels.where(remainder(F.col("doc_id"), held_out_fold) != 0)
    model = fit(docs, learned)
    held_out = F.coalesce(remainder(F.col("doc_id"), held_out_fold) == 0, F.lit(False))
    return (
        docs.select("doc_id", held_out.alias("held_out"), toxicity(docs["text"], model).alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def drop_toxic(docs: DataFrame, learn_from: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below a half, by a model of the labelled rows of
    ``learn_from``; all columns kept."""
    model = fit(learn_from, labels)
    return docs.where(toxicity(docs["text"], model) < 0.5)
