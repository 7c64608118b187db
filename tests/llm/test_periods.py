import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tastegrid.llm import periods
from tastegrid.llm.periods import find_runs, gram_lengths, least_overlap, periodic_runs, plant, summary


def brute(words, min_words=6, min_periods=4):
    """Every maximal stretch of every period; those that a smaller period explains go."""
    n, runs = len(words), []
    for q in range(1, n):
        start = 0
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                continue
            length = i + q - start
            if length >= max(min_words, min_periods * q) and not any(
                p < q and all(words[x] == words[x + p] for x in range(start, start + length - p))
                for p in range(1, q)
            ):
                runs.append((start, length, q))
            start = i + 1
    return sorted(runs)


def numbered(texts):
    numbers = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in text] for text in texts]
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return np.array([x for w in words for x in w], np.int64), ends


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4))
def test_runs_of_two_words_are_those_of_brute_force(texts):
    assert find_runs(*numbered(texts)) == [brute(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", min_size=1, max_size=12), st.integers(1, 8)), max_size=6),
       st.integers(2, 8), st.integers(2, 5))
def test_repeated_pieces_with_other_limits(pieces, min_words, min_periods):
    text = "".join(piece * times for piece, times in pieces)
    assert find_runs(*numbered([text]), min_words, min_periods) == [brute(text, min_words, min_periods)]


def test_long_periods_and_runs_beside_each_other():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 50, 70), rng.integers(50, 90, 200)
    words = np.concatenate([rng.integers(0, 9, 30), np.tile(one, 9)[:600], np.tile(two, 4), np.zeros(40, int)])
    assert find_runs(words, np.array([len(words)])) == [brute(words.tolist())]


def test_grams_leave_no_period_out():
    for min_words, min_periods in ((6, 4), (2, 2), (30, 2), (9, 7)):
        seen = []
        for gram, least, most in gram_lengths(4000, min_words, min_periods):
            seen += range(least, most + 1)
            assert all(most >= q and gram <= least_overlap(q, min_words, min_periods) and gram >= q
                       for q in range(least, most + 1))
        longest = max(q for q in range(1, 4000) if max(min_words, min_periods * q) <= 4000)
        assert seen[:longest] == list(range(1, longest + 1))


def test_a_covered_diagonal_is_extended_once(monkeypatch):
    calls = []
    matches = periods._matches
    monkeypatch.setattr(periods, "_matches", lambda *a: calls.append(a) or matches(*a))
    assert find_runs(*numbered(["a" * 5000])) == [[(0, 5000, 1)]]
    assert len(calls) == 1


ROWS = [
    (1, "x y " * 5), (2, None), (3, ""), (4, " \t\n"), (5, "a b c d e f"), (6, "a" * 10), (6, "z " * 7),
    (None, "z " * 7), (7, "é  é\té\né é é x"), (8, "a b " * 6), (9, "A a " * 3 + "A A A A A A"),
]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rows_of_the_operator(documents):
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                 for r in periodic_runs(documents(ROWS)).collect())
    want = []
    for doc_id, text in ROWS:
        words = split(text)
        runs = brute(words)
        gone = {i for s, l, q in runs for i in range(s + q, s + l)}
        want.append((doc_id or 0, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want)


def planted(doc_id, text):
    words = split(text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_the_query_against_brute_force(documents, by_id):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 90)))) for i in range(150)]
    rows += [(-5, None), (1000, "a b " * 30)]
    got = by_id(summary(periodic_runs(plant(documents(rows)))))
    assert sum(r["n_runs"] > 0 for r in got.values()) > 5
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = brute(words)
        gone = {i for s, l, q in runs for i in range(s + q, s + l)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{l},{q}\n" for s, l, q in runs)
        body = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[doc_id] == dict(
            doc_id=doc_id, n_runs=len(runs), start=best[0], length=best[1], period=best[2],
            exponent_milli=best[1] and 1000 * best[1] // best[2],
            runs_sha256=hashlib.sha256(lines.encode()).hexdigest(),
            collapsed_sha256=hashlib.sha256(body.encode()).hexdigest(),
        )


def test_long_texts_empty_tables_and_clashing_columns(documents):
    assert periodic_runs(documents([])).count() == 0
    assert plant(documents([])).columns == documents([]).columns
    docs = documents([(1, "word" * 100_000), (2, "a b c " * 400_000), (3, "q " * 3)])
    docs = docs.selectExpr("*", "1 AS runs", "2 AS n_words", "'x' AS collapsed")
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[2].runs] == [(0, 1_200_000, 3)] and got[2].collapsed == "a b c"
    assert got[1].n_words == 1 and got[3].runs == []
    with pytest.raises(ValueError):
        periodic_runs(docs, min_periods=1)
