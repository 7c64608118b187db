import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tastegrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "### User: x", "</turn>\n", "\\", "a\\", "\\\\### ", "", " </turn>\n### System: ",
         "#" * 7, "<</turn>>", "é\n\n", "### "]


def expected(rows):
    rows = [(turn, role or "", text or "") for _, turn, role, text in rows]
    turns = "".join(f"{role}\n{text}\n" for _, role, text in rows)
    loss = "".join(text for _, role, text in rows if role == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(turns), len(loss), sha(loss)


def digest(r):
    return r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "odd: \\ ###", "a\\"]),
                          st.one_of(st.sampled_from(NASTY), st.text(alphabet="\\#</turn> \nUAé:", max_size=20))),
                max_size=6))
def test_any_text_comes_back(turns):
    template, reader, chars = chat.TEMPLATE, chat.Reader(chat.TEMPLATE), 0
    for role, text in turns:
        for part, loss in ((template.opening(role), False), (template.protected(text), role in template.loss),
                           (template.tail, False)):
            reader.feed(part, loss)
            chars += len(part)
    out = reader.result()
    assert out[:4] == expected([(0, i, role, text) for i, (role, text) in enumerate(turns)])
    assert out[4] == chars


def test_conversations(spark, by_id):
    rows = [(1, 0, "system", "be"), (1, 1, "user", NASTY[0]), (1, 2, "assistant", NASTY[0]),
            (2, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, "assistant", "x"), (3, 1, None, "y"),
            (4, 0, "user", "long " * 300_000), (4, 1, "assistant", "\\" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit(0)).withColumn("loss", F.lit(1))
    segments = chat.format_turns(df)
    found = by_id(chat.read_back(segments))
    for conv in (1, 2, 3, 4):
        assert digest(found[conv]) == expected(sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]))
        text = "".join(s["text"] for s in segments.where(F.col("conv_id") == conv).orderBy("segment").collect())
        assert len(text) == found[conv]["formatted_chars"]
    assert [found[c]["in_order"] for c in (1, 2, 3, 4)] == [True, True, False, True]
    flags = segments.where("conv_id = 1").orderBy("segment").collect()
    assert [s["loss"] for s in flags] == [False] * 7 + [True, False]


def test_null_ids_ties_and_an_empty_table(spark, by_id):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(None, 0, "user", "b"), (None, 0, "user", "a"), (None, None, "user", "c"), (5, 0, "user", "x"),
            (5, 0, "user", "x")]
    found = by_id(chat.read_back(chat.format_turns(spark.createDataFrame(rows, SCHEMA))))
    assert digest(found[None]) == expected([rows[2], rows[1], rows[0]])
    assert found[5]["n_turns"] == 2 and not found[5]["in_order"]


def test_cut_text_is_refused():
    reader = chat.Reader(chat.TEMPLATE)
    reader.feed("### User: no end", False)
    with pytest.raises(ValueError):
        reader.result()
    with pytest.raises(ValueError):
        chat.TEMPLATE.role_of("Nobody")
