import re

import numpy as np
from pyspark.sql import functions as F

from tastegrid.llm import licenses


def by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    places = [(i, label) for phrase, label in licenses.PHRASES.items()
              for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_places_of_phrases(documents, by_id):
    texts = [
        "CC BY, cc-by; CC\nBY! ccby cc x by", "All rights reserved. all rights all rights reserved",
        "GNU General Public License, general  public_license", "cc", "", None, "by cc by", "É cc by é",
        "ALL RIGHTS RESERVED general public", "cc by " * 50, "word " * 100_000 + "cc by",
    ]
    docs = documents(list(enumerate(texts))).withColumn("row", F.lit(1)).withColumn("hash", F.lit(2))
    found = by_id(licenses.scan_licenses(docs))
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == by_hand(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert (r["score"] > 0) == (r["labels"] != "")


def test_changed_sentences_are_found_on_neighbouring_diagonals(documents, by_id):
    whole = next(t for t, label in licenses.TEMPLATES.items() if label == "bsd")
    words = whole.split()
    texts = {
        1: "intro " + whole + " outro", 2: " ".join(words[:9] + ["oddly"] + words[9:]),
        3: " ".join(words[:9] + words[10:]), 4: " ".join(words[:8]), 5: " ".join(sorted(words)),
        6: "Released under the MIT License.", 7: "released under the blue license",
    }
    found = by_id(licenses.scan_licenses(documents(list(texts.items()))))
    assert [found[i]["labels"] for i in sorted(found)] == ["bsd", "bsd", "bsd", "", "", "mit", ""]
    assert found[1]["score"] == 1.0 > found[2]["score"] >= licenses.COVERED
    assert all(found[i]["n_base"] == 0 for i in found)


def test_spans(spark, documents):
    docs = documents([(1, "a b All rights reserved c Licensed under the Apache License, Version 2.0 d")])
    votes = licenses.license_votes(docs, licenses.template_grams(spark))
    spans = sorted((r["label"], r["start"], r["end"]) for r in licenses.license_spans(votes).collect())
    assert spans == [("apache-2.0", 6, 14), ("reserved", 2, 5)]


def test_equal_hashes_of_other_words_do_not_vote(spark, documents):
    grams = licenses.template_grams(spark, {"cc by": "x"}, {}).withColumn("t_next", F.lit("bye"))
    assert licenses.license_votes(documents([(1, "cc by")]), grams).where("at >= 0").count() == 0


def test_null_ids_repeats_and_an_empty_table(documents):
    assert licenses.scan_licenses(documents([])).count() == 0
    rows = licenses.scan_licenses(documents([(None, "cc by"), (None, "x"), (4, "cc by"), (4, "cc by")]))
    assert sorted((str(r["doc_id"]), r["n_base"]) for r in rows.collect()) == [
        ("4", 1), ("4", 1), ("None", 0), ("None", 1)]


def test_words_put_in_at_one_place(documents, by_id):
    bsd = next(t for t, label in licenses.TEMPLATES.items() if label == "bsd").split()
    texts = {
        1: "Licensed under the terms of the Apache License, Version 2.0",
        2: "Released under the terms of the MIT license",
        3: "This work is licensed under the terms of the GNU General Public License version 3",
        4: "released under the new mit license", 5: "released under the blue license",
        6: " ".join(bsd[:9] + ["word"] * 12 + bsd[9:]), 7: " ".join(bsd[:9] + ["word"] * 100 + bsd[9:]),
        8: "mit license under the released under", 9: "the mit license. " * 3 + "released under the mit license",
        10: "licensed under cc by 4 0",
    }
    found = by_id(licenses.scan_licenses(documents(list(texts.items()))))
    assert [found[i]["labels"] for i in sorted(found)] == [
        "apache-2.0", "mit", "gpl,gpl-3", "mit", "", "bsd", "", "", "mit", "cc-by"]
    assert [found[i]["score"] for i in (1, 2, 3, 4, 9)] == [1.0, 1.0, 1.0, 0.75, 1.0]
    assert found[6]["score"] == (len(bsd) - 2) / (len(bsd) - 1)


def labels_by_hand(text):
    """Every start diagonal of every template, and the longest chain of its votes."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    labels, score = set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        k = len(phrase.split())
        if any(words[i:i + k] == phrase.split() for i in range(len(words))):
            labels.add(label)
            score = 1.0
    for template, label in licenses.TEMPLATES.items():
        own = template.split()
        grams = len(own) - 1
        missing = max(int((1 - licenses.COVERED) * grams + 1e-9), 1 if grams >= licenses.SHORT else 0)
        votes = sorted((i, p) for i in range(len(words) - 1) for p in range(grams)
                       if words[i:i + 2] == own[p:p + 2])
        for low in {i - p for i, p in votes}:
            best = {}
            for i, p in votes:
                if low <= i - p <= low + licenses.NEAR * grams:
                    best[i, p] = 1 + max((n for (j, q), n in best.items() if j < i and q < p), default=0)
            if max(best.values()) >= grams - missing:
                labels.add(label)
                score = max(score, max(best.values()) / grams)
    return ",".join(sorted(labels)), score


def test_label_sets_of_random_edits_by_brute_force(documents, by_id):
    rng = np.random.default_rng(12)
    templates = [*licenses.TEMPLATES, *licenses.PHRASES]
    common = "the of under license is and licensed this work in software word oddly v 2 0".split()
    texts = []
    for _ in range(250):
        words = []
        for template in rng.choice(templates, rng.integers(1, 4)):
            own = template.split()
            for _ in range(rng.integers(0, 4)):
                at = int(rng.integers(0, len(own) + 1))
                kind = rng.integers(0, 4)
                if kind == 0:
                    own[at:at] = rng.choice(common, rng.integers(1, 50)).tolist()
                elif kind == 1:
                    del own[at:at + int(rng.integers(1, 3))]
                elif kind == 2 and own:
                    own[min(at, len(own) - 1)] = "changed"
                else:
                    own = own[at:] + own[:at]
            words += rng.choice(common, rng.integers(0, 12)).tolist() + own
        texts.append(" ".join(words))
    found = by_id(licenses.scan_licenses(documents(list(enumerate(texts)))))
    got = [(found[i]["labels"], found[i]["score"]) for i in range(len(texts))]
    want = [labels_by_hand(t) for t in texts]
    assert got == want
    assert 20 < sum(0 < score < 1 for _, score in want) and any(label == "" for label, _ in want)


def test_words_put_in_up_to_twice_the_grams(documents, by_id):
    bsd = next(t for t, label in licenses.TEMPLATES.items() if label == "bsd").split()
    texts = {n: " ".join(bsd[:9] + ["word"] * n + bsd[9:]) for n in (0, 1, 39, 40, 41, 60)}
    found = by_id(licenses.scan_licenses(documents(list(texts.items()))))
    assert [found[n]["labels"] for n in texts] == ["bsd"] * 4 + ["", ""]
    assert found[40]["score"] == 19 / 20


def test_places_of_a_template_that_lie_apart(spark, documents):
    text = ("released under the mit license " + "x " * 30) * 3 + "released under the new mit license"
    votes = licenses.license_votes(documents([(1, text)]), licenses.template_grams(spark))
    spans = sorted((r["start"], r["end"], r["covered"]) for r in licenses.license_spans(votes).collect())
    assert spans == [(0, 5, 1.0), (35, 40, 1.0), (70, 75, 1.0), (105, 111, 0.75)]
