import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm.bwt import repeated_starts
from ledgerlark.llm.suffix_dedup import cleaned, without_repeats


def brute(texts, least):
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def test_transform_finds_every_repeat():
    rng = random.Random(1)
    for _ in range(150):
        least, letters = rng.choice([1, 2, 3, 5, 9, 20]), rng.choice([1, 2, 3, 20, 256])
        texts = [bytes(rng.randrange(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 8))]
        texts += [texts[0][:20] + texts[-1], texts[0]] if rng.random() < 0.5 else []
        count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
        want = [[i for i in range(len(t) - least + 1) if count[t[i : i + least]] > 1] for t in texts]
        assert [x.tolist() for x in repeated_starts(texts, least)] == want


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [prose(40) + " " + passage[rng.randint(0, 20) : rng.randint(150, 300)] + " " + prose(rng.randint(0, 60)) for _ in range(40)]
    return [*texts, *texts[:4], "ab" * 200, "xab" * 150, "q" * 400, passage, None, "", "short"]


@pytest.mark.parametrize("limit", [2048, 3])
def test_equals_brute_force(spark, limit):
    texts = corpus(random.Random(7))
    docs = spark.createDataFrame([(k, t, -k, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes long, th string")
    for least in (40, 100):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) for r in without_repeats(docs, least=least, limit=limit).collect()}
        assert got == dict(enumerate(brute([(t or "").encode() for t in texts], least)))


def test_repeated_and_null_ids_and_cleaned_text(spark):
    rng = random.Random(3)
    text = "é".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (None, text[:300] + "unlike", "c"), (2, None, "d"), (1, "other text", "e"), (None, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = cleaned(docs)
    assert got.columns == docs.columns
    left = {r.kept: r.text for r in got.collect()}
    assert left == {"c": "unlike", "d": None, "e": "other text", "f": ""}
    assert cleaned(docs.limit(0)).count() == 0


def test_a_text_longer_than_a_block(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghijklmnop") for _ in range(5_000_000))
    docs = spark.createDataFrame([(1, body), (2, body[2_097_000:2_097_800]), (3, "z" + body[10:150])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in without_repeats(docs).select("doc_id", "n_removed", "n_spans", F.lit(1)).collect()}
    assert got == {1: (800, 1), 2: (800, 1), 3: (0, 0)}
