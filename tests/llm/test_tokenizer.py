import pytest
from beatloom.llm import tokenizer as K
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.read_ranks())


def ours(encoder, texts):
    flat, ends = encoder.encode_batch(texts)
    return [list(flat[a:b]) for a, b in zip([0, *ends], ends)]


EDGE = ["", " ", "\n\n \t x", "<|endoftext|> a", "a" * 5000, "ab" * 3000 + "é" * 700, " " * 3000 + "x", "\u0000​﻿ 💥" * 60, "naïve façade — “ok”", "Ünïcödé 日本語 한국어 हिन्दी العربية", "it's we'll I'd 123456789 ---- !!", "é"]


def test_edge_texts(encoder, reference):
    assert ours(encoder, EDGE) == [reference(t) for t in EDGE]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(encoder, reference, texts):
    assert ours(encoder, texts) == [reference(t) for t in texts]


def test_merging_agrees_with_speculation(encoder):
    for text in EDGE:
        for word in encoder.words.findall(text):
            assert list(encoder.known.get(word) or ours(encoder, [word])[0]) == encoder.merged(word.encode())


def test_query(spark, sf_dir, reference):
    import __spark_entry__ as entry

    rows = {r["doc_id"]: r["ids"] for r in entry.queries()["p8_ids"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert rows == {i: reference(t) if t else [] for i, t in texts.items()}


def test_null_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9), (None, "x", 9)], "ids int, text string, key int")
    rows = K.encoded(df.withColumnRenamed("ids", "doc"), "doc", "text").collect()
    assert sorted((str(r["doc"]), len(r["ids"])) for r in rows) == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("None", 1)]


def test_empty_table(spark):
    assert K.encoded(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
