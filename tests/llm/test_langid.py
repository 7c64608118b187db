import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastegrid.llm import langid
from tastegrid.llm.columns import remainder

EN = "the quick brown fox jumps over the lazy dog and then it sleeps under that old tree"
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann unter dem baum"


def counted(text):
    codes, before, last = langid.letters_of(pa.array([text]))
    return langid._count_grams(codes, langid._places(before, last)[1])


def test_letters_between_single_spaces():
    codes, before, last = langid.letters_of(pa.array(["Ab, c!", None, "", "É1é"]))
    assert codes.tobytes().decode("utf-32-le") == "   ab c   é é   "
    assert [max(0, n) for n in last - before] == [5, 0, 0, 4]


def test_probabilities_sum_to_one():
    counts = {}
    for lang, text in (("en", EN), ("de", DE)):
        grams, n = counted(text)
        counts[lang] = dict(zip(grams, n.tolist()))
    model = langid.build_model(counts)
    letters = sorted({c for own in counts.values() for g in own for c in g})
    for context in ("the", "r b", "zzz", " de"):
        codes = np.frombuffer("".join(context + c for c in letters).encode("utf-32-le"), np.uint32)
        total = np.exp(model.scores(codes)[0][3::4]).sum(axis=0)
        assert (total <= 1 + 1e-9).all() and (total > 0).all()
        if context == "the":
            assert total[model.langs.index("en")] > 0.6 > total[model.langs.index("de")] * 0.6


def test_kneser_ney_by_hand():
    """Shorter sequences count by the distinct characters before them."""
    grams = {"abcd": 3, "xbcd": 1, "abce": 2}
    model = langid.build_model({"one": grams})
    d, a = langid.DISCOUNT, langid.ALPHABET
    level2, level3 = {"cd": 1, "ce": 1}, {"bcd": 2, "bce": 1}
    one = (1 - d) / 2 + d * 2 / 2 / a
    two = (level2["cd"] - d) / 2 + d * 2 / 2 * one
    three = (level3["bcd"] - d) / 3 + d * 2 / 3 * two
    four = (3 - d) / 5 + d * 2 / 5 * three
    codes = np.frombuffer("abcd".encode("utf-32-le"), np.uint32)
    assert np.exp(model.scores(codes)[0][3, 0]) == pytest.approx(four)


@pytest.fixture
def two_languages(documents):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(text.split())), lang, "a")
            for i in range(120) for lang, text in [("en", EN) if i % 2 else ("de", DE)]]
    return rows


def test_held_out_accuracy_and_rejection(documents, by_id, two_languages):
    odd = [(1000, "жук и лиса в лесу спят", None, "a"), (1001, "12 !", None, "a"), (1002, None, None, "a"),
           (1003, "", "en", "a"), (1004, "Hund", None, "a")]
    docs = documents(two_languages + odd).withColumn("row", F.lit(1)).withColumn("found", F.lit(2))
    found = by_id(langid.identify_documents(docs))
    held = docs.where(remainder(F.col("doc_id"), 4) == 2)
    assert {i for i, r in found.items() if r["held_out"]} == {r["doc_id"] for r in held.collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang, _ in two_languages)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3
    assert found[1000]["rejected"] and found[1000]["lang_pred"] in ("en", "de")
    assert found[1004]["lang_pred"] == "de"


def test_long_repeated_and_unlabelled(documents, two_languages):
    rows = two_languages + [(500, EN + " " + "the dog " * 100_000, None, "a"), (None, DE, "de", "a"), (7, EN, "en", "a")]
    out = langid.identify_documents(documents(rows)).collect()
    assert len(out) == len(rows)
    assert [r["lang_pred"] for r in out if r["doc_id"] in (500, None)] == ["en", "de"] or {
        r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (500, None)} == {500: "en", None: "de"}
    none = langid.identify_documents(documents([(1, EN, None, "a"), (2, None, None, "a")])).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify_documents(documents([])).count() == 0


def test_parts_give_the_same_scores(two_languages, monkeypatch):
    counts = {}
    for lang, text in (("en", EN), ("de", DE)):
        grams, n = counted(text)
        counts[lang] = dict(zip(grams, n.tolist()))
    model = langid.build_model(counts)
    texts = [t for _, t, *_ in two_languages] + [
        None, "", "x", "  12 a" * 50, "- " * 300, "ab" + " " * 200 + "cd", EN * 40, "1" * 500 + "z"]
    whole = model.entropies(pa.array(texts))
    for most in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "PART", most)
        assert np.allclose(whole, model.entropies(pa.array(texts)), equal_nan=True)


def test_a_long_text_takes_no_more_memory(two_languages):
    """Beside the text itself, what is held follows PART."""
    import tracemalloc

    grams, n = counted(EN)
    model = langid.build_model({"en": dict(zip(grams, n.tolist()))})
    model.entropies(pa.array([EN]))
    peaks = []
    for times in (1 << 15, 1 << 18):
        text = pa.array([EN * times])
        tracemalloc.start()
        model.entropies(text)
        peaks.append(tracemalloc.get_traced_memory()[1] - len(EN) * times)
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + (8 << 20)


@pytest.mark.parametrize("held, bits", [(4 << 20, 1 << 25), (24 * 40, 1 << 15), (1, 1 << 25)])
def test_no_sequence_is_dropped(documents, two_languages, monkeypatch, held, bits):
    """Whatever part of the model is held, and however full the bits are: the
    cross-entropies are those of a whole model."""
    rows = two_languages + [(900, "qzk жук x", None, "a"), (901, "12 !", None, "a"), (902, None, "en", "a")]
    docs = documents(rows).select("doc_id", "text")
    texts = documents(rows).select("text", "lang")
    counts = {}
    for row in langid.counts_of(texts.withColumn("part", F.lit(0)))[1].collect():
        counts.setdefault(row["lang"], {})[row["gram"]] = row["n"]
    whole = dict(zip([r[0] for r in rows], langid.build_model(counts).entropies(
        pa.array([r[1] for r in rows], pa.string()))))
    monkeypatch.setattr(langid, "HELD", held)
    monkeypatch.setattr(langid, "BITS", bits)
    langs, judged = langid.entropies_of(docs, texts)
    assert langs == ["de", "en"]
    found = {r["doc_id"]: r["h"] for r in judged.collect()}
    assert len(found) == len(rows)
    for i, h in found.items():
        h = np.array([None] * 2 if h is None else h, float)
        assert np.allclose(h, whole[i], equal_nan=True), i


def test_predictions_by_a_small_part_of_the_model(documents, two_languages, monkeypatch):
    rows = two_languages + [(1001, "12 !", None, "a"), (None, DE, "de", "a"), (7, EN, "en", "a")]
    def found():
        return sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 9), r["rejected"])
                      for r in langid.identify_documents(documents(rows)).collect())
    small = found()
    monkeypatch.setattr(langid, "HELD", 960)
    assert found() == small and len(small) == len(rows)


def test_rejection_level_holds_for_unseen_texts(documents):
    """Texts that the model hasn't counted are rejected about as often as PASS says."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 12)), "en", "a") for i in range(3000)]
    found = langid.identify_documents(documents(rows)).where("held_out").collect()
    out = sum(r["rejected"] for r in found) / len(found)
    assert out < 0.02
