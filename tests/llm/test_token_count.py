import random

import pytest

from ledgerlark.llm.token_count import encoder, op4, pieces, with_counts

TEXTS = [None, "", " ", "a<|endoftext|>b", "It's 12 o'clock\n\n  now", "été Éte ñ " * 30, "x" * 5000, "one two  three\tfour " * 300, "漢字かな 123 !!??", "ΣΑΣ σας ́x"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_counts_equal_the_library_on_whole_texts(spark, name):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["a", "B7", "'s", " ", " ", "\n", "é", "!", "<|endoftext|>"]) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    count, _ = encoder(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "n_bytes long, text string")
    for r in with_counts(docs, vocabulary=name, prefix="__", piece=40).collect():
        assert r["__n_tokens"] == (count([texts[r.n_bytes]])[0] if texts[r.n_bytes] else 0), texts[r.n_bytes]
        assert r["__n_bytes"] == len((texts[r.n_bytes] or "").encode())
    assert with_counts(docs.limit(0), vocabulary=name, prefix="__").count() == 0


def test_pieces_join_to_the_text():
    text = b"ab cd " * 1000 + b"!" * 300
    assert b"".join(pieces(text, 50)) == text and max(map(len, pieces(text, 50))) < 400


def test_query(spark, tmp_path):
    texts = [*TEXTS, "word " * 2048, "word " * 2100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    count, _ = encoder("word_bpe_49k.json")
    for r in got.collect():
        n = count([texts[r.doc_id]])[0] if texts[r.doc_id] else 0
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)
