"""Op 7 against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskweave.llm import bpe_count, queries

from ..conftest import SF_ORACLE

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(docs, lengths(library, list(docs.values()))))
    for r in queries.QUERIES["op7_token_counts"](spark, SF_ORACLE).collect():
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(docs[r.doc_id].encode()), want[r.doc_id] > 1024)


def test_every_character(library):
    count = bpe_count.counter(PATH).count
    chars = [chr(k) for k in range(0x20000) if not 0xD800 <= k < 0xE000] + [chr(k) for k in range(0x20000, 0x110000, 97)]
    rnd = random.Random(1)
    texts = ["".join(chars[i:i + 40]) for i in range(0, len(chars), 40)]
    texts += [f"a{c} {c}b  {c}\n{c}1" for c in chars[:0x3100]]
    texts += ["".join(rnd.choice(" \t\n  \x85\x1cab1é'’中🙂s.,") for _ in range(rnd.randrange(60))) for _ in range(5000)]
    got = [count(t) for t in texts]
    bad = [(t, g, w) for t, g, w in zip(texts, got, lengths(library, texts)) if g != w]
    assert not bad, (len(bad), bad[:5])


def test_special_strings_long_and_repeated(library):
    count = bpe_count.counter(PATH).count
    rnd = random.Random(2)
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", " " * 9000, "x" * 30000, "ab" * 9000,
             "".join(rnd.choice("abcdeé") for _ in range(20000)), "\n" * 500 + "end", ""]
    assert [count(t) for t in texts] == lengths(library, texts)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b", 3)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, bpe_count.token_counts(df, PATH, limit=1).collect()), key=str) == sorted(
        [(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 3, 2, True)], key=str)
    assert bpe_count.token_counts(df.limit(0), PATH).collect() == []
