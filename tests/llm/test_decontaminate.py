import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlark.llm.decontaminate import keep_clean, n_hit, op6, with_hits

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=13):
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            v = words(item)
            size = min(window, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if size and tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add("null" if name is None else str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def longest(text, item, window=13):
    """(words, place in the item, place in the text) of the longest common run of a window or more, the first of equals."""
    w, v = words(text), words(item)
    least, best = min(window, len(v)), None
    table = [[0] * (len(w) + 1) for _ in range(len(v) + 1)]
    for a in range(len(v) - 1, -1, -1):
        for b in range(len(w) - 1, -1, -1):
            if v[a] == w[b]:
                n = table[a][b] = table[a + 1][b + 1] + 1
                if n >= least and (best is None or (-n, a, b) < (-best[0], *best[1:])):
                    best = (n, a, b)
    return best


def cases(rng):
    word = lambda: rng.choice(["a", "B", "été", "d9", "e", "f"])
    prose = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate([20, 40, 3, 13, 14, 0, 7])] + [(None, "solo"), (3, "once more"), (9, None), (10, "!!")]
    docs = [prose(rng.randint(0, 30)) + rng.choice(items)[1 if rng.random() < 0.9 else 0].__str__() + prose(20) for _ in range(60)]
    return [*docs, None, "", "SOLO", "a solo, once\tMORE", prose(3000)], items


def test_equals_brute_force(spark):
    docs, items = cases(random.Random(2))
    want = brute(docs, items)
    left = spark.createDataFrame([(k, t, k) for k, t in enumerate(docs)], "doc_id long, text string, item_id int")
    right = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 300):
        found = with_hits(left, right, limit=limit).withColumn("n_hit", n_hit("hits"))
        got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()}
        assert got == dict(enumerate(want))
        for r in found.collect():
            assert [x.item for x in r.matches] == sorted(r["items"])
            for x in r.matches:
                best = [longest(docs[r.doc_id], t) for k, t in items if str(k) == x.item or k is None and x.item == "null"]
                assert (x.n, x.at, x.low) == min((b for b in best if b), key=lambda b: (-b[0], *b[1:])), (r.doc_id, x)
    kept = keep_clean(left, right)
    assert kept.columns == left.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, (n, h, _) in enumerate(want) if not (h and 20 * h >= n)]


def test_empty_tables_repeated_rows_and_blocks(spark):
    docs = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x y"), (2, "y z")], "item_id long, text string")
    for limit in (1 << 20, 1):
        assert sorted((r.doc_id or 0, [tuple(x) for x in r.hits]) for r in with_hits(docs, items, limit=limit).collect()) == [(0, [(0, 2)]), (1, [(0, 3)]), (1, [(0, 3)])]
    assert with_hits(docs.limit(0), items).count() == 0
    assert with_hits(docs, items.limit(0)).where(F.size("hits") > 0).count() == 0


def test_rows_of_items_with_one_id_count_once(spark):
    docs = spark.createDataFrame([(1, "x y z w")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x y"), (1, "z w"), (2, "q")], "item_id long, text string")
    for limit in (1 << 20, 1):
        assert with_hits(docs, items, limit=limit).first()["items"] == ["1"]


def test_long_repeats_keep_memory_and_matches_right(spark):
    docs = spark.createDataFrame([(1, "a " * 3000), (2, "b " + "a " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a " * 40)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.hits], [tuple(x) for x in r.matches]) for r in with_hits(docs, items).collect()}
    assert got == {1: (3000, [(0, 3000)], [("1", 0, 0, 40)]), 2: (51, [(1, 50)], [("1", 0, 1, 40)])}


def test_query(spark, tmp_path):
    docs, items = cases(random.Random(3))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in op6(spark, str(tmp_path)).collect():
        n, h, found = brute([docs[r.doc_id]], items)[0]
        assert r.longest == max((b[0] for _, t in items if (b := longest(docs[r.doc_id], t))), default=0)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0 and 20 * h >= n)
