"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each whole text gives counts (words, symbols, repeated lines, words in repeated
windows). Two base rules reject outright. The method rejects more: for each stratum
(language) and each signal it looks for the strictest cutoff of a fixed grid for
which labelled good documents show, by an exact binomial test, that at most
``alpha`` / (number of signals) of good documents exceed it. The level ``delta`` is
divided by the number of tests made (strata x signals x cutoffs, Bonferroni), so with
probability 1 - delta no stratum loses more than ``alpha`` of its good documents to
the method. Where too few labels exist to show this, a signal rejects nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import only, stored

#: White space between words.
SPACE = " \t\n\x0b\f\r"
#: Cutoffs of each signal, from strict to lenient.
GRIDS: Mapping[str, tuple[float, ...]] = {
    "symbols_per_word": (0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0),
    "shouts_per_word": (0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0),
    "dup_line_share": (0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75),
    "repeat_word_share": (0.25, 0.3, 0.35, 0.4, 0.45),
}
#: Base rules: fewest words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
ALPHA, DELTA = 0.02, 0.05
#: Internal columns begin so; input columns must not.
_P = "__quality_"


def _c(name: str) -> Column:
    return F.col(_P + name)


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column for each count and signal, their names prefixed; a null text has no words.

    Windows of three words are compared by 64-bit hashes. Everything is a function of
    one row, so nothing is shuffled; memory is linear in the longest text.
    """
    put = lambda df, **kw: df.withColumns({_P + k: v for k, v in kw.items()})
    clean = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    df = put(docs, clean=clean, symbols=F.regexp_count(F.col(text), F.lit("[#*$%&|<>]")), shouts=F.regexp_count(F.col(text), F.lit("!")))
    df = put(
        df,
        words=F.when(_c("clean") == "", F.array().cast("array<string>")).otherwise(F.split(_c("clean"), "[\\x20\\x09-\\x0D]+")),
        lines=F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
    ).drop(_P + "clean")
    df = put(
        df,
        n_words=F.size(_c("words")).cast("long"),
        word_chars=F.char_length(F.array_join(_c("words"), "")).cast("long"),
        n_lines=F.size(_c("lines")).cast("long"),
        n_dup_lines=(F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
        hashes=F.transform(_c("words"), lambda w: F.xxhash64(w)),
    ).drop(_P + "words", _P + "lines")
    h = _c("hashes")
    df = put(df, windows=F.when(_c("n_words") < 3, F.array().cast("array<long>")).otherwise(F.transform(F.slice(h, F.lit(1), F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))).drop(_P + "hashes")
    w = _c("windows")
    df = put(df, ordered=F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop(_P + "windows")
    o = _c("ordered")
    again = F.filter(o, lambda x, i: F.coalesce(F.when(i > 0, F.get(o, i - 1)["h"]) == x["h"], F.lit(False)) | F.coalesce(F.get(o, i + 1)["h"] == x["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    df = put(df, n_repeat_words=F.coalesce(F.size(covered), F.lit(0)).cast("long"), n_symbols=F.coalesce(_c("symbols"), F.lit(0)).cast("long")).drop(_P + "ordered")
    per = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    df = put(
        df,
        base_failed=(_c("n_words") < MIN_WORDS) | (100 * _c("n_repeat_words") > MAX_REPEAT_PCT * _c("n_words")),
        symbols_per_word=per(_c("n_symbols"), _c("n_words")),
        shouts_per_word=per(F.coalesce(_c("shouts"), F.lit(0)), _c("n_words")),
        dup_line_share=per(_c("n_dup_lines"), _c("n_lines")),
        repeat_word_share=per(_c("n_repeat_words"), _c("n_words")),
    )
    return df.drop(_P + "symbols", _P + "shouts")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding, for k < n * p; 1 for any larger k.

    The largest term is found from its logarithm, the others by their ratios.
    """
    log_choose = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda a, j: a + F.log((n - k + j) / j))
    log_top = log_choose + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        i = k - j + 1
        term = a["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    rest = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, add, lambda a: a["sum"])
    return F.when(k < n * p, F.exp(log_top) * rest).otherwise(F.lit(1.0))


def cutoffs(signals: DataFrame, labels: DataFrame, stratum: str, doc_id: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA, grids: Mapping[str, tuple[float, ...]] = GRIDS) -> DataFrame:
    """(stratum, a cutoff for each signal or null): what ``signals`` (of with_signals) and ``labels`` (doc_id, quality) allow.

    Good documents are those that pass the base rules and whose labels, if several,
    all say 1. Null ids, labels and strata without good documents take no part.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(doc_id)).agg(F.min("quality").alias("least")).where("least = 1").select(doc_id)
    held = signals.where(~_c("base_failed")).select(doc_id, F.col(stratum).alias("stratum"), *[_c(s) for s in grids]).join(good, doc_id, "left_semi")
    tests = [(s, c, f"{s}_{i}") for s, cuts in grids.items() for i, c in enumerate(cuts)]
    counted = stored(held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(_c(s) > c, 1)).alias(name) for s, c, name in tests]), "counts")
    level = delta / max(1, counted.count() * len(tests))
    risk = alpha / len(grids)
    passed = {name: F.when(binomial_tail(F.col("n"), F.col(name), risk) <= level, F.lit(c)) for _, c, name in tests}
    least = {s: F.least(*[passed[name] for t, _, name in tests if t == s]) for s in grids}
    return stored(counted.select("stratum", *[x.alias(f"max_{s}") for s, x in least.items()]), "cutoffs")


def judged(signals: DataFrame, cuts: DataFrame, stratum: str, grids: Mapping[str, tuple[float, ...]] = GRIDS) -> DataFrame:
    """``signals`` with ``__quality_kept``: false if a base rule failed or a signal exceeds its stratum's cutoff."""
    renamed = cuts.select(F.col("stratum").alias(_P + "stratum"), *[F.col(f"max_{s}").alias(f"{_P}max_{s}") for s in grids])
    over = F.lit(False)
    for s in grids:
        over = over | F.coalesce(_c(s) > _c(f"max_{s}"), F.lit(False))
    joined = signals.join(renamed, F.col(stratum).eqNullSafe(_c("stratum")), "left")
    return joined.withColumn(_P + "kept", ~(_c("base_failed") | over))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Rows of ``docs`` that the rules keep; thresholds are learnt from those of ``docs`` that ``labels`` covers.

    A null text has no words and goes by the base rules, as does an empty one; repeated rows
    are judged alike; columns of ``docs`` beginning with "__quality_" aren't allowed. Rows
    are stored once with their signals, so that these are computed once.
    """
    rows = stored(with_signals(docs, text), "signals")
    cuts = cutoffs(rows.select(doc_id, F.col(stratum).alias("stratum"), *[_c(c) for c in ("base_failed", *GRIDS)]), labels, "stratum", doc_id)
    return only(judged(rows, cuts, stratum), _c("kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    signals = stored(with_signals(docs).drop("text"), "signals")
    cuts = cutoffs(signals, spark.read.parquet(f"{sf_dir}/labels.parquet"), "lang")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *GRIDS]
    return judged(signals, cuts, "lang").select("doc_id", *[_c(n).alias(n) for n in names])
