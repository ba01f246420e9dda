"""Problem 8: the transducer against the public libraries, and round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratagraph.llm import encoding, transducer

pytestmark = pytest.mark.skipif(not os.path.exists(transducer.FOLDER), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{transducer.FOLDER}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_library(library, text):
    if any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        return
    ids = transducer.load().encode(text)
    assert ids == library(text)
    assert "".join(transducer.decode_stream(ids, transducer.load().bytes_of)) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab" * 3000, "é" * 999, "<|endoftext|> x", "\r\n\r\n  x", "日本語😀" * 50, "​‍" * 9])
def test_long_and_odd_texts(library, text):
    assert transducer.load().encode(text) == library(text)


def test_bounded_tables_change_nothing(library):
    small = transducer.Transducer(transducer.read_ranks(f"{transducer.FOLDER}/byte_bpe_50k.tiktoken"), max_states=50, max_words=20)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abcdefg hijkl ÄÖ\n\t0123.,") for _ in range(120))
        assert small.encode(text) == library(text)
    assert len(small.words) <= 20


def test_utf8_stream_equals_python():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choice([rng.randrange(256), 0x41, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0]) for _ in range(rng.randrange(12)))
        stream = transducer.Utf8Stream()
        assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.end() == data.decode("utf-8", "replace")


def test_frame_with_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "two words"), (1, "two words"), (2, None), (3, ""), (None, "x"), (4, "y" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "key": F.lit(1)})
    got = encoding.encode_texts(df, "doc_id", "text")
    assert got.columns == ["doc_id", "ids"]
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got.collect()) == sorted((a or 0, tuple(library(b)) if b else ()) for a, b in rows)
    back = {(r.doc_id, r.text) for r in encoding.decode_ids(got, "doc_id", "ids").collect()}
    assert back == {(a, b or "") for a, b in rows}
    assert encoding.encode_texts(df.limit(0), "doc_id", "text").count() == 0
