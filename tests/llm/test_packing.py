import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tastegrid.llm.packing import binary_lengths, pack, write_buckets
from tastegrid.llm.tokens import PART, added_tokens, encoded, encoder


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return encoded(encoder(), text, added_tokens()).tolist()


@given(st.integers(0, 100_000))
def test_lengths_are_powers_that_sum_up(n):
    lengths = binary_lengths(n)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
    assert lengths == sorted(lengths, reverse=True)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.just("<|endoftext|>"), st.sampled_from("<|> \n")), max_size=12))
def test_ids_are_those_of_the_other_library(parts):
    text = "".join(parts)
    assert ids_of(text) == tokenizer().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "a word, énorme  and 12 more\n\n " * 20_000, "x" * 300_000, " " * 300_000, "<|endoftext|> a",
    "<|endoftext|>", "<|endoftext|><|endoftext|>", "in<|endoftext|>side", "a <|endoftext|>  \n<|endoftext|> b",
    "<|endoftext|", "<|<|endoftext|>|>", "many words <|endoftext|> and more " * 20_000,
])
def test_long_texts_are_encoded_in_parts(text):
    assert len(text) < 100 or len(text) > 2 * PART
    assert ids_of(text) == tokenizer().encode(text, add_special_tokens=False).ids


def test_pieces_hold_each_id_once(documents, tmp_path, spark):
    rows = [(1, "hello world " * 1200), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "two words"),
            (5, "<|endoftext|> hi"), (6, "hi<|endoftext|>" * 40)]
    docs = documents(rows)
    pieces = pack(docs)
    found = pieces.collect()
    assert len({r["sequence_id"] for r in found}) == len(found)
    for doc_id, text in rows:
        ids = tokenizer().encode(text or "", add_special_tokens=False).ids + [1]
        own = [r for r in found if r["doc_id"] == doc_id]
        copies = sum(d == doc_id for d, _ in rows)
        assert sum(r["length"] for r in own) == len(ids) * copies
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids"] == part and r["doc_tokens"] == len(ids) and r["offset"] == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == 1 << r["bucket"] <= 2048
    write_buckets(pieces, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "bucket=11")).count() == sum(
        r["length"] == 2048 for r in found)


def test_empty_table_clashing_columns_and_limits(documents):
    assert pack(documents([])).count() == 0
    docs = documents([(1, "a b c d")]).selectExpr("*", "1 AS start", "2 AS ids", "3 AS sequence_id")
    assert sum(r["length"] for r in pack(docs, limit=2).collect()) == 5
    with pytest.raises(ValueError):
        pack(docs, limit=100)
