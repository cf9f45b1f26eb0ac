"""Mixing to target weights with soft membership, in DataFrame functions only.

Domains are those of the label table: ``clean`` (good and not toxic), ``low`` (not good,
not toxic) and ``toxic``. A naive Bayes classifier over the presence and absence of hashed words,
fitted on at most ``SAMPLE`` labelled documents, gives each document the domains'
posteriors p. With t tokens in a document, rates r >= 0 are fitted so that each
domain's expected tokens, the sum of t * p * r, match its target: projected gradient
descent on the squared residuals, starting from r = 1.

With G = sum of t p p', the residual is measured in the metric of G's inverse, and
rates in that of t; then step length 1 is right. A step goes on in the last step's
direction by a share b, subtracts p . m and cuts off at 0, where m holds one number for
each domain (accelerated projected gradient, begun anew where the residual grows). So
the rates follow from the list of (b, m) alone, and a step is one pass of sums over a
narrow table: the driver only sees as many numbers as there are domains. The rates are
stored every ``HELD`` steps, so the passes' work is in proportion to their number.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, stored, stored_at

DOMAINS = ("clean", "low", "toxic")
#: Target shares of tokens.
TARGETS: Mapping[str, float] = {"clean": 0.85, "low": 0.1, "toxic": 0.05}
#: Labelled documents fitted on at most, and hash buckets of words.
SAMPLE, BUCKETS = 20_000, 16_384
#: A bucket counts if its log ratio is so many standard errors from 0.
SIGNIFICANT = 4.0
STEPS, TOLERANCE = 200, 1e-6
#: After so many steps the rates so far are stored, so a pass never repeats more of them.
HELD = 8
#: The fit ends where ten steps make the squared residual less by no more than this share.
GAIN = 1e-4
#: A domain's share that misses its target by more is told.
TOLD = 1e-3
_SPACE = "[\\x20\\x09-\\x0D]+"


def _features(text: Column, buckets: int) -> tuple[Column, Column]:
    """(number of words, distinct hash buckets of lower-cased words) of a text; null is empty."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(clean), _SPACE))
    return words, lambda w: F.array_distinct(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")))


def _with_features(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    words, hashed = _features(F.col(text), buckets)
    return docs.withColumn("__words", words).withColumns({"__tokens": F.size("__words").cast("long"), "__buckets": hashed(F.col("__words"))}).drop("__words")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[list[float], list[list[float]]]:
    """(each domain's score of a text without words, each bucket's share) against the first of DOMAINS from at most ``sample`` labelled ids.

    The sample is those with the least hash of their id, so it is the same on each
    run; labels that contradict each other count as bad and toxic. Null ids and
    documents without labels take no part; without any, all domains are alike.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(doc_id)).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    named = known.select(doc_id, F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "clean").when(F.col("q") == 0, "low").alias("__domain")).where("__domain IS NOT NULL")
    chosen = stored(named.orderBy(F.xxhash64(doc_id), doc_id).limit(sample), "sample")
    # At most ``sample`` short rows: small enough for every executor.
    mine = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
    seen = stored(_with_features(mine.select("__domain", text), text, buckets).drop(text), "features")
    size = {r["__domain"]: r["count"] for r in seen.groupBy("__domain").count().collect()}
    count = {d: [0] * buckets for d in DOMAINS}
    for r in seen.select("__domain", F.explode("__buckets").alias("b")).groupBy("__domain", "b").count().collect():
        count[r["__domain"]][r["b"]] = r["count"]
    n = {d: size.get(d, 0) + 1.0 for d in DOMAINS}
    empty, shares = [], []
    for d in DOMAINS[1:]:
        score, row = log(n[d] / n[DOMAINS[0]]), []
        for here, base in zip(count[d], count[DOMAINS[0]], strict=True):
            a, b = (here + 0.5) / n[d], (base + 0.5) / n[DOMAINS[0]]
            a, b = min(a, 1 - 0.5 / n[d]), min(b, 1 - 0.5 / n[DOMAINS[0]])
            odds = log(a / (1 - a)) - log(b / (1 - b))
            if abs(odds) > SIGNIFICANT * (1 / (n[d] * a * (1 - a)) + 1 / (n[DOMAINS[0]] * b * (1 - b))) ** 0.5:
                score += log((1 - a) / (1 - b))
                row.append(odds)
            else:
                row.append(0.0)
        empty.append(score)
        shares.append(row)
    return empty, shares


def with_posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with __tokens and __p_<domain>, which add up to 1."""
    empty, shares = model
    df = _with_features(docs, text, buckets)
    for d, score, row in zip(DOMAINS[1:], empty, shares, strict=True):
        table = F.split(F.lit(",".join(map(repr, row))), ",").cast("array<double>")
        df = df.withColumn(f"__s_{d}", F.aggregate("__buckets", F.lit(score), lambda a, b: a + F.get(table, b)))  # noqa: B023
    top = F.greatest(F.lit(0.0), *[F.col(f"__s_{d}") for d in DOMAINS[1:]])
    df = df.withColumn("__top", top)
    weight = {d: F.exp((F.col(f"__s_{d}") if k else F.lit(0.0)) - F.col("__top")) for k, d in enumerate(DOMAINS)}
    df = df.withColumns({f"__w_{d}": w for d, w in weight.items()})
    all_ = sum((F.col(f"__w_{d}") for d in DOMAINS), F.lit(0.0))
    df = df.withColumns({f"__p_{d}": F.col(f"__w_{d}") / all_ for d in DOMAINS})
    return df.drop("__buckets", "__top", *[f"__{x}_{d}" for x in "sw" for d in DOMAINS])


def _state(history: Sequence[Sequence[float]], now: Column, last: Column) -> Column:
    """(now, last): a document's rate after the steps of ``history`` and before the last of them; each has the share of the last step to go on by, then a number for each domain."""
    pair = lambda a, b: F.struct(a.alias("now"), b.alias("last"))
    if not history:
        return pair(now, last)
    # One flat list is folded to a constant; lists within a lambda would be parsed for each row.
    numbers = F.split(F.lit(",".join(repr(x) for m in history for x in m)), ",").cast("array<double>")

    def step(a: Column, i: Column) -> Column:
        at = lambda k: F.get(numbers, i * (len(DOMAINS) + 1) + k)
        down = sum((F.col(f"__p_{d}") * at(k) for k, d in enumerate(DOMAINS, 1)), F.lit(0.0))
        return pair(F.greatest(F.lit(0.0), a["now"] + at(0) * (a["now"] - a["last"]) - down), a["now"])

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(history) - 1)), pair(now, last), step)


def rate(history: Sequence[Sequence[float]]) -> Column:
    """A document's rate after the steps of ``history``, from 1 on."""
    return _state(history, F.lit(1.0), F.lit(1.0))["now"]


def _solve(g: list[list[float]], y: list[float]) -> list[float]:
    """g x = y for a positive semidefinite g, lifted by a trifle."""
    n = len(y)
    lift = 1e-9 * max(1e-300, sum(g[k][k] for k in range(n)))
    rows = [[*map(float, g[k]), y[k]] for k in range(n)]
    for k in range(n):
        rows[k][k] += lift
    for k in range(n):
        p = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[p] = rows[p], rows[k]
        for i in range(n):
            if i != k:
                f = rows[i][k] / rows[k][k]
                rows[i] = [a - f * b for a, b in zip(rows[i], rows[k], strict=True)]
    return [rows[k][n] / rows[k][k] for k in range(n)]


class Fit(NamedTuple):
    """The steps that make the rates, and by how much the shares of all tokens that they give miss their targets."""

    steps: list[list[float]]
    missed: dict[str, float]


def fit_rates(table: DataFrame, targets: Mapping[str, float] = TARGETS, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """What brings the expected tokens of ``table`` (__tokens, __p_*) to the shares ``targets`` of all its tokens.

    Ends where all targets are met, where they come no nearer, or after ``steps``. What is
    left is in ``missed``, and if that is more than ``TOLD``, a warning says so: no rates of
    0 or more may reach the targets.
    """
    t, p = F.col("__tokens"), {d: F.col(f"__p_{d}") for d in DOMAINS}
    pairs = [(a, b) for a in DOMAINS for b in DOMAINS]
    once = table.agg(F.coalesce(F.sum(t), F.lit(0)).alias("all"), *[F.coalesce(F.sum(t * p[a] * p[b]), F.lit(0.0)).alias(f"{a}_{b}") for a, b in pairs]).first()
    if not once["all"]:
        return Fit([], dict.fromkeys(DOMAINS, 0.0))
    g = [[once[f"{a}_{b}"] for b in DOMAINS] for a in DOMAINS]
    wanted = [targets[d] * once["all"] for d in DOMAINS]
    history: list[list[float]] = []
    costs: list[float] = []
    before, turn = None, 1.0
    held, folder = table.select(t, *p.values(), F.lit(1.0).alias("__now"), F.lit(1.0).alias("__last")), None
    while True:
        recent = history[len(history) - len(history) % HELD :]
        rated = held.select(t, *p.values(), _state(recent, F.col("__now"), F.col("__last")).alias("__r"))
        now = rated.select(t, *p.values(), F.col("__r.now").alias("__r")).agg(*[F.sum(t * p[d] * F.col("__r")).alias(d) for d in DOMAINS]).first()
        left = [now[d] - w for d, w in zip(DOMAINS, wanted, strict=True)]
        size = max(map(abs, left)) / once["all"]
        costs.append(sum(a * b for a, b in zip(left, _solve(g, left), strict=True)))
        if size <= tolerance or len(history) == steps or len(costs) > 10 and costs[-1] >= (1 - GAIN) * costs[-11]:
            break
        # What the rates give is linear in them, so the residual ahead follows from the last two.
        turn = 1.0 if len(costs) > 1 and costs[-1] > costs[-2] else turn
        after = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        share = (turn - 1) / after if before else 0.0
        ahead = [x + share * (x - y) for x, y in zip(left, before or left, strict=True)]
        history.append([share, *_solve(g, ahead)])
        before, turn = left, after
        if len(history) % HELD == 0:
            rated = held.select(t, *p.values(), _state(history[-HELD:], F.col("__now"), F.col("__last")).alias("__r"))
            old = folder
            held, folder = stored_at(rated.select(t, *p.values(), F.col("__r.now").alias("__now"), F.col("__r.last").alias("__last")), "rates")
            if old:
                drop_folder(table.sparkSession, old)
    if folder:
        drop_folder(table.sparkSession, folder)
    missed = {d: x / once["all"] for d, x in zip(DOMAINS, left, strict=True)}
    if size > TOLD:
        warnings.warn(f"targets aren't met; shares of tokens beyond them: {missed}", stacklevel=2)
    return Fit(history, missed)


def mixed_rates(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``docs`` with __tokens, __p_<domain> and __rate, which columns of ``docs`` must not be named.

    Null and empty texts have no tokens: their rate follows from the priors and
    weighs nothing. Repeated rows each count. Rows are stored once with their posteriors.
    """
    table = stored(with_posteriors(docs, fit(docs, labels, doc_id, text), text), "posteriors")
    return table.withColumn("__rate", rate(fit_rates(table, targets).steps))


def op3(spark, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors and rate of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    table = stored(with_posteriors(docs, model).drop("text"), "posteriors")
    return table.select("doc_id", F.col("__tokens").alias("n_tokens"), *[F.col(f"__p_{d}").alias(f"p_{d}") for d in DOMAINS], rate(fit_rates(table).steps).alias("rate"))
