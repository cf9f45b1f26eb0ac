import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from ledgerlark.llm.quality_rules import binomial_tail, cutoffs, judged, keep_good, with_signals

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b", "a b c a b c", "x\n x\nx\nx \n\n\n y\x0bz", "a a a a", "é #é|é é é &<>", "w1 w2 w3 " * 40, "\n".join(["same line here"] * 5), " ".join(map(str, range(60)))]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words long")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r[0]: tuple(r)[1:] for r in with_signals(docs).select("doc_id", *[F.col("__quality_" + n) for n in names], "__quality_base_failed").collect()}
    for k, t in enumerate(TEXTS):
        want = brute(t)
        assert got[k] == (*want, want[0] < 50 or 100 * want[4] > 50 * want[0]), t


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (10, 60, 500) for k in (0, 1, 3, 7) if k < n]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p"))
    for r in df.collect():
        want = sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.05 else 1.0
        assert abs(r.p - want) < 1e-12
    assert spark.range(1).select(binomial_tail(F.lit(10**6), F.lit(4000), 0.005).alias("p")).first().p < 1e-40


def _corpus(spark, n=3000):
    clean = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{clean} {k}", "en", 1) for k in range(n)] + [(n + k, clean.replace(" ", "# ") + f" {k}", "en", 0) for k in range(50)]
    return spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")


def test_thresholds_keep_clean_and_need_evidence(spark):
    docs, labels = _corpus(spark)
    assert keep_good(docs, labels).count() == 3000
    few = labels.where("doc_id < 200")
    assert keep_good(docs, few).count() == 3050
    assert keep_good(docs, labels.limit(0)).count() == 3050 and keep_good(docs.limit(0), labels).count() == 0


def test_nulls_repeated_rows_and_clashing_columns(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, clean, None, 1.0), (1, clean, None, 1.0), (None, clean, "xx", 2.0), (2, None, "en", 3.0)], "doc_id long, text string, lang string, quality double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.quality for r in kept.collect()) == [1.0, 1.0, 2.0]
    signals = with_signals(docs)
    assert judged(signals, cutoffs(signals, labels, "lang"), "lang").count() == 4
