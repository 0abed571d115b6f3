import random

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankspark.llm import encode as E


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TRICKY = ["", " ", "  a", "\n\n x", "don't we'll I'VE", "<|endoftext|>", "a" * 3000, " " * 500, "=" * 300, "語彙" * 400, "é́ñ", "﻿x", "👩‍🔬", "1234567 ½ ²", "\x00\x7f\x85 ", "tab\tcr\r\nlf"]


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts(reference, text):
    assert E.encoder().ids(text) == reference(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(text):
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json") if not hasattr(test_any_text, "t") else test_any_text.t
    t.encode_special_tokens = True
    test_any_text.t = t
    assert E.encoder().ids(text) == t.encode(text, add_special_tokens=False).ids


def test_documents(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in E.token_ids(docs).collect()}
    want = {r["doc_id"]: reference(r["text"]) if r["text"] else [] for r in docs.collect()}
    assert got == want
    counts = {r["doc_id"]: r["tokens"] for r in E.token_counts(docs, "doc_id").collect()}
    assert counts == {k: len(v) for k, v in want.items()}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "tokens": F.lit(1)})
    got = sorted(((r["doc_id"], r["ids"]) for r in E.token_ids(df).collect()), key=repr)
    assert got == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275]), (None, [87])]
    assert E.token_ids(df.limit(0)).count() == 0


def test_prefix_tables_take_edits():
    rng, v = random.Random(5), E.encoder().pieces.vocabulary
    spent = full = 0
    for _ in range(150):
        text = "".join(rng.choice(["the", "ing", "er", "ation", " ", "x", "é", "un"]) for _ in range(120)).encode()
        table = E.Prefixes(v, text[:50])
        table.append(text[50:])
        assert table.last == E.Prefixes(v, text).last
        a = rng.randrange(len(text))
        b, new = min(len(text), a + rng.randrange(8)), bytes(rng.choice(b"abcthe ") for _ in range(rng.randrange(6)))
        spent += table.replace(a, b, new)
        fresh = E.Prefixes(v, text[:a] + new + text[b:])
        full += len(fresh.last)
        assert (table.data, table.last) == (fresh.data, fresh.last)
        assert b"".join(v.piece[t] for t in table.ids()) == bytes(table.data)
    assert spent < full
