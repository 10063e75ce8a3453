import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracequarry.llm import tokens

PATH = tokens.vocabulary_path("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="vocabulary files are absent")
PIECES = ["a", "b", "'", "s", "'re", " the", " ", "  ", "\n", "\n\n", "\t", "!", "?", ".", "1", "99", "é", "ñ", "漢字", "\u00a0", "\u3000", "\u2003", "ї", "😀", "<|endoftext|>", "\x00", "\x85", "x'"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_same_as_encoding_whole(parts):
    text = "".join(parts)
    e = tokens.encoder(PATH)
    assert e.encode(text) == e.base.encode_ordinary(text)


def test_columns_with_nulls_and_long_texts():
    random.seed(2)
    texts = ["".join(random.choices(PIECES, k=random.randint(0, 60))) for _ in range(3000)] + [None, "", "word " * 60_000, "x" * 30_000, "a", "a"]
    e = tokens.encoder(PATH)
    ids, ends = tokens.encode_column(pa.array(texts), PATH)
    counts = tokens.count_column(pa.array(texts), PATH)
    begin = 0
    for t, end, n in zip(texts, ends, counts):
        assert ids[begin:end].tolist() == e.base.encode_ordinary(t or "") and n == end - begin
        begin = end


def test_operator(spark):
    rows = [(1, "Hello world", "clash"), (2, None, None), (3, "", "x"), (1, "Hello world", "clash"), (None, "again", "y")]
    out = tokens.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert [(r.doc_id, list(r.ids)) for r in out][:4] == [(1, [15496, 995]), (2, []), (3, []), (1, [15496, 995])]
    assert out[4].doc_id is None and tokens.token_ids(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    n = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")).collect()}
    assert n[1] == 2 and n[2] == 0
