import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from ledgerlark.llm.url_filter import OP8_SQL, filtered, host, intervals, op8, parents

T0 = datetime(2024, 1, 1)
EVENTS = "list string, entry string, added boolean, at timestamp"


def test_hosts(spark):
    urls = {"http://A.b.C/x": "a.b.c", "https://u:p@h.org:80/?q": "h.org", "ftp://h.org.": "h.org", "no url": None, "": None, None: None, "http://": None, "http://[::1]/": "[::1]", "http://u@[2001:DB8::7]:80/x": "[2001:db8::7]", "http://10.0.0.7:8/": "10.0.0.7", "http://[::1": None, "https://x.y?z": "x.y"}
    got = {r.u: r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", host(F.col("u")).alias("h")).collect()}
    assert got == urls
    names = {"a.b.c": ["a.b.c", "b.c", "c"], "10.0.0.7": ["10.0.0.7"], "[::1]": ["[::1]"], "org": ["org"]}
    assert {r.n: r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", parents(F.col("n")).alias("p")).collect()} == names


def test_intervals_are_disjoint(spark):
    day = lambda n: T0 + timedelta(days=n)
    rows = [("l", "X.org", True, day(1)), ("l", "x.org", True, day(2)), ("l", "x.org", False, day(3)), ("l", "x.org", False, day(4)), ("l", "x.org", True, day(5)), ("l", "y", True, day(1)), ("l", "y", False, day(1)), (None, "z", True, day(1)), ("l", "z", None, day(1)), ("l", "z", False, day(1))]
    got = sorted((r.entry, r.valid_from, r.valid_to) for r in intervals(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == [("x.org", day(1), day(3)), ("x.org", day(5), None)]


def brute(captures, events):
    state = {}
    for name, entry, added, at in sorted(events, key=lambda e: (e[3], not e[2])):
        state.setdefault((name, entry), []).append((at, added))
    out = []
    for page, url, at in captures:
        h = (url or "").split("://")[-1].split("/")[0] or None
        hits = []
        for (name, entry), history in state.items():
            if h and at and (h == entry or h.endswith("." + entry)):
                active = [added for t, added in history if t <= at]
                if active and active[-1]:
                    hits.append(f"{name}:{entry}")
        hits.sort()
        out.append((page, hits, any(x.startswith("block") for x in hits) and not any(x.startswith("allow") for x in hits)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    names = ["a.org", "b.a.org", "c.b.a.org", "d.net", "net", "e.com"]
    events = [(rng.choice(["block-1", "block-2", "allow-1"]), rng.choice(names), rng.random() < 0.6, T0 + timedelta(hours=rng.randrange(5000))) for _ in range(80)]
    captures = [(k, f"http://{rng.choice(['', 'www.'])}{rng.choice(names)}/p", T0 + timedelta(hours=rng.randrange(5000))) for k in range(300)] + [(900, None, T0), (901, "http://a.org/", None), (902, "junk", T0)]
    events = list({(e[0], e[1], e[3]): e for e in events}.values())
    got = {r.page_id: (r.hits, r.blocked) for r in filtered(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(events, EVENTS)).collect()}
    assert got == {p: (h, b) for p, h, b in brute(captures, events)}


def test_empty_tables_repeats_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", T0, "x"), (1, "http://a.org/", T0, "y")], "page_id long, url string, fetched_at timestamp, hits string")
    none = spark.createDataFrame([], EVENTS)
    assert [r.hits for r in filtered(pages, none).collect()] == [[], []]
    some = spark.createDataFrame([("block", "a.org", True, T0)], EVENTS)
    assert [r.blocked for r in filtered(pages, some).collect()] == [True, True]
    assert filtered(pages.limit(0), some).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = duckdb.execute(OP8_SQL).fetchall()
    got = [tuple(r) for r in op8(spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(r[4] for r in got) > 0
