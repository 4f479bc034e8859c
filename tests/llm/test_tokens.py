import random

import pyarrow.parquet as pq
import pytest
import tiktoken
from strandlake.llm import tokens

TEXTS = [
    None, "", " ", "\n\n  \t", "Hello, world! It's 3,141.59 o'clock.", "naïve café ﬁle Ⅳ ½", "日本語と русский  mixed\r\n\r\n", "<|endoftext|> is ordinary text", "a" * 5000, "   leading and trailing   ",
    "x                 y", "'s 't 're 'VE ''' ​﻿", "🙂🙃 👩‍👩‍👧 \U0001f9ff", "I'll we'd they're it's 'tis",
]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks(), special_tokens={})


def by_doc(df):
    return {r.doc_id: list(r.ids) for r in df.collect()}


def test_as_the_plain_encoder(spark, encoding):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab'  .,\n1é日") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, ids string, block int").repartition(3)
    for chars in (tokens.BLOCK_CHARS, 100):
        got = by_doc(tokens.encode(df, block_chars=chars))
        assert got == {k: encoding.encode_ordinary(t) if t else [] for k, t in enumerate(texts)}


def test_round_trip_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    found = tokens.round_trip(df).collect()
    assert len(found) == len(TEXTS) and all(r.intact for r in found)
    assert tokens.encode(df.limit(0)).count() == 0
    twice = tokens.encode(df.filter("doc_id = 4").union(df.filter("doc_id = 4"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_decoding_in_blocks(spark, encoding):
    texts = [t for t in TEXTS if t] * 3
    ids = [(k, encoding.encode_ordinary(t)) for k, t in enumerate(texts)] + [(900, []), (901, None), (902, [-5, 10**8])]
    df = spark.createDataFrame(ids, "doc_id bigint, ids array<int>").repartition(3)
    for size in (tokens.BLOCK_IDS, 7, 200):
        got = {r.doc_id: r.text for r in tokens.decode(df, block_ids=size).collect()}
        assert got == dict(enumerate(texts)) | {900: "", 901: "", 902: ""}
    assert tokens.decode(df.limit(0)).count() == 0


def test_only_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "")], "doc_id bigint, text string").coalesce(1)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in tokens.encode(df).collect()) == [(0, []), (1, []), (2, [])]


def test_test_data(spark, encoding):
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = dict(zip(*pq.read_table(path, columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    assert by_doc(tokens.encode(spark.read.parquet(path))) == {k: encoding.encode_ordinary(t) if t else [] for k, t in texts.items()}
