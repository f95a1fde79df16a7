import random

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import encode
from stemma.llm.encode import TOKENIZER_DIR, _encoded, chunked, encode_documents, encoding, token_counts, vocabulary

WORDS = ["the ", " it's", "don't", "x", "\n", "\r\n", "  ", "\t", " ", "　", "é", "漢字", "🙂", "12345", "'", "''", "'v", "e", "...", "<|endoftext|>", " a", "\x1c", "\x85", "़", "Ǆ", "a" * 40, "\u00a0 ", "\u2028\n", "р ", "'re "]


@pytest.fixture(scope="module")
def enc():
    return encoding(vocabulary())


def whole(enc, text):
    return enc.text(text)


@pytest.mark.parametrize("bits", [0, 1, 2, 4, 8])
def test_joins_are_exact(enc, bits, monkeypatch):
    monkeypatch.setattr(encode.chunked, "__defaults__", (bits,))
    rng = random.Random(bits)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 80))) for _ in range(400)]
    chunks, counts = chunked(pa.array(texts))
    parts = iter(chunks.to_pylist())
    assert ["".join(next(parts) for _ in range(n)) for n in counts] == texts
    column = pa.chunked_array([pa.array(texts[:100]), pa.array([*texts[100:], None]).slice(0, 300)])
    assert _encoded(column, enc).to_pylist() == [whole(enc, t) for t in texts]
    assert _encoded(column, enc, lengths_only=True).to_pylist() == [len(whole(enc, t)) for t in texts]


def test_equal_passages_are_encoded_once(enc):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    asked = []
    chunks, _ = chunked(pa.array(["x" * 37 + " " + passage, passage + " tail", passage, ""]))
    asked = chunks.dictionary.to_pylist()
    assert len(asked) == len(set(asked)) and sum(map(len, asked)) < 1.1 * len(passage)
    assert np.median([len(s) for s in asked]) < 50
    for at_once in (1, 100, 1 << 20):
        ids, counts = enc.chunks(asked, at_once)
        assert ids.tolist() == [i for s in asked for i in whole(enc, s)] and counts.tolist() == [len(whole(enc, s)) for s in asked]


def test_other_library_agrees(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.ids for r in encode_documents(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], [e.ids for e in t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]))
    assert got == want


def test_edges(spark, enc):
    rng = random.Random(8)
    long = "".join(rng.choice(WORDS) for _ in range(60_000))
    texts = [None, "", " ", "\n", "a", long, long, "b" * 200_000]
    df = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)], "doc_id long, text string, seq int, chunk string")
    got = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    assert got == {i: whole(enc, t or "") for i, t in enumerate(texts)}
    assert encode_documents(df.limit(0)).count() == 0
    counts = {r.doc_id: r.n_tokens for r in token_counts(df.selectExpr("*", "'s' as source")).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
