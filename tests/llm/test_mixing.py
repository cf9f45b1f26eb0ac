import math
import random
import warnings

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm.mixing import BUCKETS, DOMAINS, SIGNIFICANT, TOLD, fit, fit_rates, mixed_rates, op3, rate, with_posteriors


def corpus(spark, n=600):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        domain = rng.choices(DOMAINS, [6, 3, 1])[0]
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(20, 80))]
        if domain == "low":
            words += ["junk"] * 3
        if domain == "toxic":
            words += ["slur"]
        rng.shuffle(words)
        docs.append((k, " ".join(words), domain))
        if k % 2:
            labels.append((k, int(domain != "low"), int(domain == "toxic")))
    return spark.createDataFrame(docs, "doc_id long, text string, domain string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_posteriors_and_targets(spark):
    docs, labels = corpus(spark)
    targets = {"clean": 0.7, "low": 0.25, "toxic": 0.05}
    done = mixed_rates(docs, labels, targets=targets).cache()
    right = done.where(F.greatest(*[F.col(f"__p_{d}") for d in DOMAINS]) == F.element_at(F.create_map(*[x for d in DOMAINS for x in (F.lit(d), F.col(f"__p_{d}"))]), F.col("domain"))).count()
    assert right > 570
    total = done.agg(F.sum("__tokens")).first()[0]
    for d, share in targets.items():
        mine = done.agg(F.sum(F.col("__tokens") * F.col(f"__p_{d}") * F.col("__rate"))).first()[0]
        assert mine == pytest.approx(share * total, rel=1e-4)
    assert done.where("__rate < 0").count() == 0 and done.where("abs(__p_clean + __p_low + __p_toxic - 1) > 1e-9").count() == 0


def test_targets_out_of_reach_stay_nonnegative(spark):
    table = spark.createDataFrame([(10, 0.5, 0.3, 0.2), (20, 0.6, 0.3, 0.1)], "__tokens long, __p_clean double, __p_low double, __p_toxic double")
    with pytest.warns(UserWarning, match="aren't met"):
        found = fit_rates(table, {"clean": 0.0, "low": 0.0, "toxic": 1.0})
    assert all(r.x >= 0 for r in table.select(rate(found.steps).alias("x")).collect()) and max(map(abs, found.missed.values())) > TOLD
    assert fit_rates(table.limit(0)).steps == [] and table.select(rate([]).alias("x")).first().x == 1.0


def test_nulls_contradictions_and_clashing_columns(spark):
    docs, labels = corpus(spark, 100)
    odd = spark.createDataFrame([(None, None, "a"), (0, "", "b"), (0, "w1 w2", "c")], "doc_id long, text string, domain string")
    more = spark.createDataFrame([(None, 1, 1), (1, 0, 1), (1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    all_ = docs.unionByName(odd).withColumns({"rate": F.lit("r"), "quality": F.lit(9)})
    done = mixed_rates(all_, labels.unionByName(more))
    assert done.count() == 103 and done.where("domain = 'b'").first()["__tokens"] == 0 and done.where("__rate IS NULL").count() == 0
    assert mixed_rates(all_.limit(0), labels).count() == 0


def test_without_labels_all_are_alike(spark):
    docs, labels = corpus(spark, 20)
    model = fit(docs, labels.limit(0))
    assert with_posteriors(docs, model).select("__p_clean").distinct().count() == 1


def test_the_sample_is_bounded(spark):
    docs, labels = corpus(spark, 200)
    assert fit(docs, labels, sample=10) == fit(docs, labels, sample=10)


def test_no_python_in_the_plan(spark):
    docs, labels = corpus(spark, 20)
    plan = mixed_rates(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def bag(text):
    # 2 ** 64 is a multiple of the number of buckets, so the hash's sign changes nothing.
    return {xxhash.xxh64_intdigest(w.encode(), 42) % BUCKETS for w in (text or "").lower().split()}


def test_posteriors_equal_brute_force(spark):
    docs, labels = corpus(spark)
    model = fit(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    domain = {r.doc_id: "toxic" if r.toxic else "clean" if r.quality else "low" for r in labels.collect()}
    bags = {d: [bag(rows[k]) for k, x in domain.items() if x == d] for d in DOMAINS}
    n = {d: len(bags[d]) + 1.0 for d in DOMAINS}
    share = {d: np.array([min((sum(b in x for x in bags[d]) + 0.5) / n[d], 1 - 0.5 / n[d]) if any(b in x for e in DOMAINS for x in bags[e]) else 0.5 / n[d] for b in range(BUCKETS)]) for d in DOMAINS}

    def posteriors(text):
        mine, scores = bag(text), [0.0]
        for d in DOMAINS[1:]:
            a, c = share[d], share["clean"]
            odds = np.log(a / (1 - a)) - np.log(c / (1 - c))
            counts = np.abs(odds) > SIGNIFICANT * np.sqrt(1 / (n[d] * a * (1 - a)) + 1 / (n["clean"] * c * (1 - c)))
            there = np.zeros(BUCKETS, bool)
            there[list(mine)] = True
            scores.append(math.log(n[d] / n["clean"]) + np.where(there, np.log(a / c), np.log((1 - a) / (1 - c)))[counts].sum())
        e = np.exp(np.array(scores) - max(scores))
        return e / e.sum()

    odd = spark.createDataFrame([(9001, "", "x"), (9002, None, "x"), (9003, "junk SLUR w1", "x")], docs.schema)
    for r in with_posteriors(docs.limit(40).unionByName(odd), model).collect():
        assert np.allclose([r[f"__p_{d}"] for d in DOMAINS], posteriors(rows.get(r.doc_id, {9003: "junk SLUR w1"}.get(r.doc_id))), atol=1e-9), r.doc_id


def test_rates_are_a_least_squares_solution(spark):
    rng = np.random.default_rng(5)
    for targets in ((0.5, 0.3, 0.2), (0.1, 0.1, 2.5)):
        t, p = rng.integers(1, 50, 12).astype(float), rng.dirichlet([1.0, 0.6, 0.3], 12)
        table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(t, p, strict=True)], "__tokens long, __p_clean double, __p_low double, __p_toxic double")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = fit_rates(table, dict(zip(DOMAINS, targets, strict=True)), steps=400, tolerance=1e-9)
        mine = np.array([r.x for r in table.select(rate(found.steps).alias("x")).collect()])
        # By coordinates: each rate in turn to its best value of 0 or more.
        g, y = (p * t[:, None]).T @ p, np.array(targets) * t.sum()
        root = np.linalg.cholesky(np.linalg.inv(g)).T
        a, b = root @ (p * t[:, None]).T, root @ y
        r = np.ones(12)
        for _ in range(5000):
            for k in range(12):
                r[k] = max(0.0, r[k] + a[:, k] @ (b - a @ r) / (a[:, k] @ a[:, k]))
        cost = lambda x: float(np.sum((a @ x - b) ** 2))
        assert cost(mine) <= cost(r) * 1.02 + 1e-6 * float(b @ b) and (mine >= 0).all()
        assert np.allclose([found.missed[d] for d in DOMAINS], ((p * t[:, None]).T @ mine - y) / t.sum(), atol=1e-9)


def test_query(spark, tmp_path):
    docs, labels = corpus(spark, 200)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = op3(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "p_clean": "double", "p_low": "double", "p_toxic": "double", "rate": "double"}
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == 200 and all(by[r.doc_id].n_tokens == len(r.text.split()) and by[r.doc_id].rate >= 0 for r in docs.collect())


def test_rates_are_held_between_steps(spark, monkeypatch):
    """A pass goes over the last steps only, whatever their number, and gives what all steps give."""
    from ledgerlark.llm import mixing

    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.3], 200)
    table = spark.createDataFrame([(k % 50 + 1, *map(float, x)) for k, x in enumerate(p)], "__tokens long, __p_clean double, __p_low double, __p_toxic double")
    longest, inner = [], mixing._state
    monkeypatch.setattr(mixing, "HELD", 3)
    monkeypatch.setattr(mixing, "_state", lambda history, *x: longest.append(len(history)) or inner(history, *x))
    found = fit_rates(table, steps=10, tolerance=0.0)
    assert len(found.steps) == 10 and max(longest) == 3
    monkeypatch.setattr(mixing, "_state", inner)
    rated = table.select("*", rate(found.steps).alias("r"))
    # Constants aren't parsed for each row.
    assert "split" not in rated._jdf.queryExecution().optimizedPlan().toString()
    want = np.array(found.steps)
    now, last = np.ones(200), np.ones(200)
    for share, *m in want:
        now, last = np.maximum(0, now + share * (now - last) - p @ m), now
    assert np.allclose([r.r for r in rated.collect()], now, rtol=1e-9)
    tokens = np.array([k % 50 + 1 for k in range(200)])
    assert np.allclose([found.missed[d] for d in DOMAINS], (tokens * now) @ p / tokens.sum() - [mixing.TARGETS[d] for d in DOMAINS], atol=1e-9)
