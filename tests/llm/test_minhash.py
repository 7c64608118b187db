import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tastegrid.llm import minhash
from tastegrid.llm.components import components
from tastegrid.llm.runs import roots, runs, slices
from tastegrid.llm.words import MARKS, SPACES, pairs, words_of


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:]))


def brute(rows, percent=80):
    """Smallest id reachable, for rows of distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_like_brute_force(documents, by_id):
    rng = random.Random(5)
    rows, next_id = [], 0
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((next_id, edited(rng, words, rng.randrange(0, len(words) // 12 + 2))))
            next_id += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two")]
    rng.shuffle(rows)
    found = by_id(minhash.near_duplicates(documents(rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute(rows)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_large_group_and_shared_passage(documents, by_id, monkeypatch):
    """Nodes above the leaf size branch to the last level and are compared in tiles."""
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "CLUSTER_TILE", 8)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, edited(rng, base, 2)) for i in range(90)]
    passage = " ".join(f"p{i}" for i in range(15))
    rows += [(100 + i, passage + " " + " ".join(f"x{rng.random()}" for _ in range(40))) for i in range(80)]
    found = by_id(minhash.near_duplicates(documents(rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute(rows)


def test_null_ids_repeats_long_texts_and_clashing_columns(documents):
    long = " ".join(f"t{i}" for i in range(200_000))
    docs = documents([(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "A b  c"), (7, long),
                      (8, long + " end"), (None, None)])
    docs = docs.withColumn("n_shingles", F.lit(1)).withColumn("sig", F.lit(2)).withColumn("kept", F.lit(0))
    rows = sorted((str(r["doc_id"]), r["component_id"], r["kept"])
                  for r in minhash.near_duplicates(docs).collect())
    assert rows == [("1", 1, True), ("3", 1, False), ("3", 1, False), ("7", 7, True),
                    ("8", 7, False), ("None", None, True), ("None", None, True)]
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "7", "None", "None"]


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).count() == 0


def test_more_trees_for_more_recall():
    assert minhash.trees_for(0.9) < minhash.trees_for(0.999) < minhash.trees_for(0.999, percent=50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab\tB \néÀ1-", max_size=30)), max_size=12))
def test_words_of_a_batch(texts):
    import re
    for separators, pattern in ((SPACES, rb"[^\x20\x09-\x0D]+"),
                                (MARKS, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = words_of(pa.array(texts, pa.string()), separators)
        hashes, first = pairs(words)
        known, known_pairs = {}, {}
        for i, text in enumerate(texts):
            want = re.findall(pattern, (text or "").encode().lower())
            a, b = words.first[i], words.first[i + 1]
            got = [bytes(words.data[s:e]) for s, e in zip(words.start[a:b], words.end[a:b])]
            assert got == want
            known.update(zip(got, words.hash[a:b]))
            assert all(known[w] == h for w, h in zip(got, words.hash[a:b]))
            own = hashes[first[i]:first[i + 1]]
            assert len(own) == max(0, len(want) - 1)
            known_pairs.update(zip(zip(want, want[1:]), own))
        assert len(set(known.values())) == len(known)
        assert len(set(known_pairs.values())) == len(known_pairs)


def test_similar_sets_by_percent():
    a = np.arange(0, 9, dtype=np.uint64)
    sets = [a, a[:8], np.arange(100, 110, dtype=np.uint64), a[:7], a[:0]]
    links = minhash.similar_sets(sets, 80)
    assert links[0, 1] and not links[0, 3] and links[1, 3] and not links[2, :2].any()
    assert not links[4].any()


def test_runs_slices_and_roots():
    parts = [(np.array([1, 1]), np.array([5, 6])), (np.array([1, 2]), np.array([7, 8])),
             (np.array([], int), np.array([], int)), (np.array([3]), np.array([9]))]
    assert [(k[0], v.tolist()) for k, v in runs(parts)] == [(1, [5, 6, 7]), (2, [8]), (3, [9])]
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 9, "", "c"])], ["t"])
    cut = list(slices([batch], 0, 4))
    assert sum(map(len, cut)) == 5 and len(cut) > 1
    links = np.zeros((4, 4), bool)
    links[0, 2] = links[2, 0] = links[2, 3] = links[3, 2] = True
    assert roots(links).tolist() == [0, 1, 0, 0]


@pytest.mark.parametrize("edges, want", [
    ([(i, i + 1) for i in range(30)] + [(50, 40), (40, 50), (60, 60)], {**dict.fromkeys(range(31), 0), 40: 40, 50: 40}),
    ([], {}),
    ([(None, 1), (2, None), (9, 3), (9, 3)], {9: 3, 3: 3}),
])
def test_components(spark, edges, want):
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in rows} == want and len(rows) == len(want)
