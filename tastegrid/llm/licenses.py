"""License texts by diagonal voting.

Every 2-word gram of every text is joined by its hash to the places where templates
have it, and votes for a diagonal: its place in the text less that in the template. Votes
are aggregated by diagonal. A diagonal on which all grams of a template vote is an exact
copy. Words put in move the rest of a template to a higher diagonal, words left out to a
lower one; so each diagonal is merged with those above it up to a distance that follows
the template's length, and where enough of the template's places have voted on them, the
span is verified: the votes must follow each other in the order of the template. Votes
count only where both words are equal.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .runs import slices
from .stages import staged
from .words import MARKS, Words, pairs, words_of

# Phrases that are looked for word by word, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Sentences of public licenses, which may be changed a little.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international "
    "license": "cc-by-sa",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# The part of a template's grams that must vote; of SHORT grams or more one may always be
# missing. Diagonals are merged up to a distance of NEAR times the template's grams: so many
# words may be put in.
COVERED, SHORT, NEAR = 0.8, 4, 2
# More than the words of a template.
_PLACES = 1 << 20


def template_grams(spark: SparkSession, phrases=None, templates=None) -> DataFrame:
    """One row per gram of each template: template, label, exact, grams (of the
    template), place, hash, word, next. Templates have two words at least."""
    rows = []
    for exact, texts in ((True, PHRASES if phrases is None else phrases),
                         (False, TEMPLATES if templates is None else templates)):
        for text, label in texts.items():
            words = words_of(pa.array([text]), MARKS)
            hashes, _ = pairs(words)
            if not len(hashes):
                raise ValueError(f"a template of one word: {text!r}")
            plain = [bytes(words.data[s:e]).decode() for s, e in zip(words.start, words.end)]
            rows += [
                (text, label, exact, len(hashes), place, value, plain[place], plain[place + 1])
                for place, value in enumerate(hashes.view(np.int64).tolist())
            ]
    return spark.createDataFrame(
        rows, "template string, label string, exact boolean, grams int, place long, hash long, "
        "t_word string, t_next string"
    )


def word_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All 2-word grams of every text: row, at, hash, word, next; and one line for each
    text, with at -1, its id and its number of words."""
    def grams(batches):
        for batch in slices(batches, 2, 2 << 20):
            words = words_of(batch.column(2), MARKS)
            hashes, first = pairs(words)
            owner = np.repeat(np.arange(len(batch)), np.diff(first))
            left = np.arange(len(hashes)) - first[owner] + words.first[owner]
            rows = np.asarray(batch.column(0))
            n, m = len(hashes), len(batch)
            plain = _strings(words)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rows[owner], rows])),
                pa.concat_arrays([pa.nulls(n, pa.int64()), batch.column(1)]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(words.counts(), pa.int64())]),
                pa.array(np.concatenate([left - words.first[owner], np.full(m, -1)]), pa.int64()),
                pa.concat_arrays([pa.array(hashes.view(np.int64)), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([plain.take(pa.array(left)), pa.nulls(m, pa.string())]),
                pa.concat_arrays([plain.take(pa.array(left + 1)), pa.nulls(m, pa.string())]),
            ], names=["row", "doc_id", "n_words", "at", "hash", "word", "next"])

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
    ).mapInArrow(
        grams, "row long, doc_id long, n_words long, at long, hash long, word string, next string"
    )


def _strings(words: Words) -> pa.Array:
    """The words as an Arrow array, without a Python object for each."""
    length = words.end - words.start
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    place = np.repeat(words.start - ends[:-1], length) + np.arange(ends[-1])
    data = np.ascontiguousarray(words.data[place])
    return pa.Array.from_buffers(
        pa.string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)]
    )


def license_votes(docs: DataFrame, templates: DataFrame, **columns) -> DataFrame:
    """The grams of ``docs`` that are grams of a template, word for word, and one line
    per text. The templates are a fixed list, small enough for every executor."""
    grams = word_grams(docs, **columns)
    same = (F.col("word") == F.col("t_word")) & (F.col("next") == F.col("t_next"))
    return (
        grams.join(F.broadcast(templates), "hash", "left")
        .where((F.col("at") < 0) | same)
        .select("row", "doc_id", "n_words", "at", "template", "label", "exact", "grams", "place")
    )


def diagonals(votes: DataFrame) -> DataFrame:
    """The votes by template and diagonal, with the ``places`` of the template that voted."""
    return (
        votes.where("at >= 0").withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy("row", "template", "label", "exact", "grams", "diagonal")
        .agg(F.collect_set("place").alias("places"))
    )


def merged_diagonals(lines: DataFrame) -> DataFrame:
    """Each of the ``lines`` from which on the diagonals within NEAR times the template's
    grams have votes of enough places; ``near`` are they, (diagonal, places)."""
    # The window counts distances in lengths of the template, in units of _PLACES, and half a
    # length more; what lies too far is then left out by the distance itself.
    far = Window.partitionBy("row", "template").orderBy("lengths").rangeBetween(
        0, _PLACES * NEAR + _PLACES // 2)
    near = F.filter(
        F.collect_list(F.struct("diagonal", "places")).over(far),
        lambda line: line["diagonal"] - F.col("diagonal") <= NEAR * F.col("grams"),
    )
    kinds = F.size(F.array_distinct(F.flatten(F.transform("near", lambda line: line["places"]))))
    return (
        lines.withColumn("lengths", F.floor(F.col("diagonal") * _PLACES / F.col("grams")))
        .withColumn("near", near).where(kinds >= least_votes("grams")).drop("lengths", "places")
    )


def license_spans(votes: DataFrame) -> DataFrame:
    """``(row, template, label, exact, start, end, covered)``: the places of phrases, and
    the places where a template is covered well enough. Words are counted from 0 and
    end is after the last; a place of an exact phrase is covered wholly. Of places of a
    template that overlap the one with the most votes counts."""
    lines = diagonals(votes)
    whole = lines.where(F.col("exact") & (F.size("places") == F.col("grams")))
    low = F.col("diagonal") + F.array_min("places")
    exact = whole.select(
        "row", "template", "label", "exact", low.alias("start"),
        (F.col("diagonal") + F.array_max("places") + 2).alias("end"), F.lit(1.0).alias("covered"))
    # A place of the text with several of the template has the last one first.
    codes = F.flatten(F.transform("near", lambda line: F.transform(
        line["places"], lambda p: (line["diagonal"] + p) * _PLACES + (_PLACES - 1 - p))))
    verified = merged_diagonals(lines.where(~F.col("exact"))).select(
        "row", "template", "label", "exact", "grams", codes.alias("codes"),
        least_votes("grams").alias("least"),
    ).mapInArrow(_in_order, _CHAINS)
    by_place = Window.partitionBy("row", "template").orderBy("low", "high", "votes")
    before = F.max("high").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("low") > before, F.lit(True)).cast("int")
    best = (
        verified.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "template", "label", "exact", "grams", "span")
        .agg(F.max_by(F.struct("low", "high", "votes"), F.struct("votes", -F.col("low"))).alias("best"))
    )
    return exact.union(best.select(
        "row", "template", "label", "exact", "best.low", (F.col("best.high") + 2),
        F.col("best.votes") / F.col("grams")))


def least_votes(grams: str) -> Column:
    """How many grams of a template must vote."""
    missing = F.floor((1 - COVERED) * F.col(grams) + 1e-9).cast("int")
    return F.col(grams) - F.when(F.col(grams) >= SHORT, F.greatest(missing, F.lit(1))).otherwise(missing)


_CHAINS = (
    "row long, template string, label string, exact boolean, grams int, low long, high long, "
    "votes int"
)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each merged span the most votes that follow each other in the order of the
    template: where they begin and end in the text, and how many they are. Spans with fewer
    than ``least`` are left out."""
    for batch in batches:
        chains = [longest_chain(codes.values.to_numpy()) for codes in batch.column(5)]
        chains = np.array(chains, np.int64).reshape(-1, 3)
        kept = pa.array(np.flatnonzero(chains[:, 2] >= batch.column(6).to_numpy()))
        low, high, votes = (pa.array(chains[:, i]).take(kept) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [*batch.select(range(5)).take(kept).columns, low, high, votes.cast(pa.int32())],
            names=[field.split()[0] for field in _CHAINS.split(", ")],
        )


def longest_chain(codes: np.ndarray) -> list[int]:
    codes = np.sort(codes)
    at = (codes // _PLACES).tolist()
    chain = _longest_rise((_PLACES - 1 - codes % _PLACES).tolist())
    return [at[chain[0]], at[chain[-1]], len(chain)]


def _longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising part of ``values``."""
    tails, last, before = [], [], []
    for i, value in enumerate(values):
        k = bisect_left(tails, value)
        before.append(last[k - 1] if k else -1)
        tails[k:k + 1] = [value]
        last[k:k + 1] = [i]
    out, i = [], last[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Words are runs of digits, letters and all beyond ASCII, with A-Z lower-cased.
    n_base counts the places of the PHRASES, first_word and last_word are the smallest
    and largest of them (null without one); labels are distinct, sorted and joined by
    commas, an empty text without one. The score is the largest part of a template that
    a place covers, 0 without one.

    Null and empty texts have no words. Repeated rows, and rows without id, are scanned
    each on their own; other columns are not read.
    """
    spark = docs.sparkSession
    votes = staged(
        license_votes(docs, template_grams(spark), id_col=id_col, text_col=text_col), "votes"
    )
    exact = F.col("exact")
    found = license_spans(votes).groupBy("row").agg(
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).alias("first_word"),
        F.max(F.when(exact, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(exact, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("covered").alias("score"),
    )

    def joined(name):
        labels = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.array_join(F.array_sort(labels), ",").alias(name)

    texts = votes.where("at < 0").select("row", "doc_id", "n_words")
    return texts.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word", joined("base_labels"), joined("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
