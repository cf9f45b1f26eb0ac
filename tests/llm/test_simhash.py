import random

import numpy as np
import xxhash

from ledgerlark.llm.components import connected_components
from ledgerlark.llm.simhash_dedup import _BALL, _Forest, _near, keep_one, near_duplicates, near_links, op9, simhash


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {n: min(m for m in nodes if find(m) == find(n)) for n in nodes}


def test_simhash_of_a_few_words():
    assert simhash(b"") == simhash(b" \n\t") == 0
    assert simhash(b"One  two") == xxhash.xxh64_intdigest(b"one two", 42)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c a", b"c a b", b"a b c")]
    expected = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 4)
    assert simhash(b"a b\nc A  b C") == expected


def _prints(rng):
    out = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 40])):
            out.add(x)
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.choice([rng.randrange(64), rng.randrange(4)])
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


def test_links_have_the_components_of_all_near_pairs(spark):
    prints = _prints(random.Random(5))
    pairs = [(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    wanted = brute_components(pairs, prints)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    for heavy in (1024, 2):
        links = {(r.a, r.b) for r in near_links(df, heavy).collect()}
        assert {(min(x), max(x)) for x in links} <= set(pairs)
        assert brute_components(links, prints) == wanted
        if heavy == 1024:
            assert {(min(x), max(x)) for x in links} == set(pairs)


def test_a_full_bucket_links_in_whichever_half_the_entry_has_the_0(spark):
    entry = 0x12345678_0F0E0D0C
    for high, low in ((1, 1), (1, 0), (0, 1), (0, 0)):
        a = entry & ~(1 << 16 | 1) | high << 16 | low
        b = a ^ (1 << 32 | 1 << 16 | 1)
        # The fillers make the bucket of x full; 0x...78 ends in 0, so b asks for a's bucket.
        for x, y in ((a, b), (b, a)):
            prints = [x, y, *(x >> 32 << 32 | f for f in (0xF0F1F2F3, 0xF0F10D0C))]
            links = near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 1).collect()
            assert (min(a, b), max(a, b)) in {(min(r), max(r)) for r in links}, (high, low, x == a)


def test_balls_find_what_each_with_each_finds():
    rng = np.random.default_rng(3)
    for shift in (0, 16, 32, 48):
        base = np.uint64(0x0123456789ABCDEF)
        flips = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        free = rng.integers(0, 1 << 16, 6000, dtype=np.uint64) << np.uint64(shift)
        left, right = base ^ free[:3000] ^ flips(3000), base ^ free[3000:]
        got = {p for a, b in _near(left, right, shift) for p in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(a, int(right[k])) for a in left.tolist() for k in np.flatnonzero(np.bitwise_count(np.uint64(a) ^ right) <= 3)}
        assert len(left) * len(right) > len(_BALL) * 6000 and got == want


def test_a_forest_joins_what_its_links_join():
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    forest = _Forest(np.arange(200, dtype=np.uint64))
    for at in range(0, 150, 40):
        a, b = zip(*links[at : at + 40], strict=True)
        forest.add(np.array(a, np.uint64), np.array(b, np.uint64))
    out = [(r["a"], r["b"]) for r in forest.table().to_pylist()]
    want = brute_components(links, range(200))
    assert set(out) <= set(links) and brute_components(out, range(200)) == want and len(out) == 200 - len(set(want.values()))


def test_components_of_chains_stars_and_nulls(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 200), (None, 3), (201, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and len({got[k] for k in range(100, 140)}) == 1
    assert len(set(got.values())) == 3 and 201 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_with_nulls_ties_and_clashing_columns(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(5, text, 1, 1), (3, text.upper(), 2, 2), (3, text, 3, 3), (None, text, 4, 4), (9, None, 5, 5), (8, "", 6, 6), (7, "else", 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id int")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.fp for r in kept.collect()) == [2, 3, 4, 6, 7]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    texts = ["one two three four five six seven eight nine ten", "One Two three four five six seven eight nine ten", "quite another text with other words", None, " "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op9(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[k].fingerprint == f"{simhash((t or '').encode()):016x}" for k, t in enumerate(texts))
    assert [by[k].component_id for k in range(5)] == [0, 0, 2, 3, 3]
