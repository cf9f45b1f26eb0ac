import random

from pyspark.sql import functions as F

from ledgerlark.llm import near_copies as module
from ledgerlark.llm import shared
from ledgerlark.llm.components import connected_components
from ledgerlark.llm.near_copies import alike, keep_one, near_copies, prefix_links, text_parts
from ledgerlark.llm.shared import stored


def shingles(text, width=5):
    w = (text or "").lower().split()
    n = min(len(w), width)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    line = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([8, 20, 45, 150, 400]))]
        if rng.random() < 0.4:
            base += line.split()
        for _ in range(rng.choice([1, 1, 2, 25])):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    return texts


def components(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [min(m for m in range(n) if find(m) == find(k)) for k in range(n)]


def test_finds_copies_and_only_those(spark):
    texts = corpus(random.Random(3))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similar(texts[a], texts[b])]
    want = components(links, len(texts))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert [k for k in range(len(texts)) if got[k] != want[k]] == []
    assert len(set(want)) < len(texts) - 50


def components_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    return [got[k] for k in range(len(texts))]


def test_a_long_quote_from_elsewhere_hides_no_group(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base, quote = words(1200), words(200)
        copies = [list(base) for _ in range(4)]
        for c in copies:
            c[rng.randrange(1200)] = "edited"
        copies[0][600:600] = quote
        texts += [" ".join(c) for c in copies] + [" ".join(words(300) + quote + words(300))]
    want = components([(a, b) for a in range(len(texts)) for b in range(a) if similar(texts[a], texts[b])], len(texts))
    assert want == [k - k % 5 if k % 5 < 4 else k for k in range(len(texts))]
    assert components_of(spark, texts) == want


def test_short_texts_with_an_edit_are_all_found(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(250):
        base = [f"w{rng.randrange(10**7)}" for _ in range(rng.randint(50, 60))]
        edited = list(base)
        edited[rng.randrange(len(base))] = "edited"
        texts += [" ".join(base), " ".join(edited)]
    want = [k - k % 2 if similar(texts[k - k % 2], texts[k - k % 2 + 1]) else k for k in range(len(texts))]
    assert components_of(spark, texts) == want


def test_few_distinct_words_and_random_groups_leave_no_wrong_component(spark):
    texts = corpus(random.Random(21)) + [" ".join(["one", "two"] * 40 + [f"x{k}"] * (k % 2)) for k in range(4)]
    want = components([(a, b) for a in range(len(texts)) for b in range(a) if similar(texts[a], texts[b])], len(texts))
    assert components_of(spark, texts) == want


def test_links_are_verified_and_blocks_change_nothing(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    parts = stored(text_parts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "parts")
    of = {r.th: texts[r.doc_id] for r in parts.select("doc_id", "th").collect()}
    for rows in (1024, 7):
        links = [(r.a, r.b) for r in alike(parts, block_rows=rows).collect()]
        assert all(similar(of[a], of[b]) for a, b in links)
    brute = components([(i, j) for i in range(60) for j in range(60) if i < j and similar(texts[i], texts[j])], 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (1024, 7):
        got = {r.doc_id: r.component_id for r in near_copies(docs, block_rows=rows).collect()}
        assert [got[k] for k in range(60)] == brute


def test_crowded_keys_lose_no_link_between_strangers_and_kin(spark, monkeypatch):
    rng = random.Random(31)
    monkeypatch.setattr("ledgerlark.llm.near_copies._PARITY_ROWS", 5)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(40):  # one group around a text, strangers that share much of it, and pairs of them
        t = list(base)
        t[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    for _ in range(25):
        own = base[:18] + [f"s{rng.randrange(10**6)}" for _ in range(22)]
        near = list(own)
        near[30] = "edited"
        texts += [" ".join(own), " ".join(near)]
    want = components([(a, b) for a in range(len(texts)) for b in range(a) if similar(texts[a], texts[b])], len(texts))
    assert len(set(want)) > 20
    parts = stored(text_parts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "parts")
    of = {r.th: r.doc_id for r in parts.select("doc_id", "th").collect()}
    # With nothing linked beforehand, and with the first group known: the prefix filter finds the rest.
    group = [th for th, d in of.items() if want[d] == want[0]]
    known = [(th, group[0]) for th in group]
    for linked in ([], known):
        rooted = stored(spark.createDataFrame(linked, "node long, root long"), "linked")
        links = [(of[r.a], of[r.b]) for r in prefix_links(parts, rooted).collect()] + [(of[a], of[b]) for a, b in linked]
        assert components(links, len(texts)) == want


def test_nulls_ties_and_clashing_columns(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(5, t, 1), (3, t.upper(), 2), (3, t + " more", 3), (None, t, 4), (9, None, 5), (8, " ", 6), (7, "else", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.th for r in kept.collect()) == [2, 3, 4, 6, 7]
    assert keep_one(docs.limit(0)).count() == 0


def test_equal_groups_are_compared_once(spark, monkeypatch):
    """Passages that stand in the same classes bring these together a single time; the links stay."""
    rng = random.Random(31)
    texts = {}
    for k in range(0, 60, 3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for j in range(3):
            texts[k + j] = " ".join([*words[: 280 - j], f"end{k + j}"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    parts = stored(text_parts(docs), "parts")
    seen, inner = [], module._compared
    monkeypatch.setattr(module, "_compared", lambda chosen, *x: seen.append(chosen) or inner(chosen, *x))
    links = connected_components(alike(parts))
    assert links.select("root").distinct().count() == 20 and links.count() == 60
    groups = seen[0].groupBy("key").agg(F.sort_array(F.collect_set("th")).alias("g"))
    assert groups.count() == groups.select("g").distinct().count()


def test_what_led_to_the_result_is_dropped(spark):
    """After ``keep_one`` only the ids that go are left on disk."""
    docs = spark.createDataFrame([(k, f"text {k // 2}") for k in range(20)], "doc_id long, text string")
    before = len(shared._MADE.__dict__.get("paths", []))
    out = keep_one(docs)
    assert len(shared._MADE.paths) - before == 1 and out.count() == 10


def test_scaled_parities_tell_large_sets_apart(spark):
    """Large strangers that 1,024 bits can't tell apart are ruled out; alike ones of different lengths of bits stay."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(4200)
    texts = [" ".join(x) for x in (base, [*base[:4000], "end"], words(4200), words(4100))]
    parts = stored(text_parts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "parts")
    th = [r.th for r in parts.orderBy("doc_id").collect()]
    pairs = stored(spark.createDataFrame([(*sorted((th[i], th[j])), 1, 2) for i in range(4) for j in range(i)], "a long, b long, root_a long, root_b long"), "pairs")
    left = module._still_possible(pairs, parts, 0.8).collect()
    assert [(r.a, r.b) for r in left] == [tuple(sorted(th[:2]))]
    bits = {r.th: bytes(r.bits) for r in module._parities(parts).collect()}
    assert module._differing(bits[th[0]], bits[th[2]]) < 0.2 / 1.8 * 8300
