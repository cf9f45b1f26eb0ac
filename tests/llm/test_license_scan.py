import random
import re
import time

from ledgerlark.llm.license_rules import BASE, rules
from ledgerlark.llm.license_scan import base_places, detections, op1, scan

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall((text or "").encode().lower())
    places = []
    for label, phrase in BASE:
        p = phrase.encode().split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "under the mit license", "UNDER the, MIT\nLicense; (cc-by-nc) apache license version 2.0", "under the mit licensed", "xunder the mit license", "été cc by nc cc  by---nc é",
    "this cc by nc-sa 4.0 thing", "plain text " * 50 + "Apache License, Version 2" + " more" * 9, "SPDX-License-Identifier: GPL-3.0-only", "accé by nc", "a\x00under\x00the mit license\x7f",
]


def test_base_columns_equal_brute_force(spark, tmp_path):
    rng = random.Random(1)
    words = ["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "é"]
    texts = TEXTS + ["".join(rng.choice(words) + rng.choice([" ", ", ", "-", "x"]) for _ in range(200)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1(spark, str(tmp_path)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_rules_are_many_and_each_needs_its_keywords():
    found = rules()
    assert len(found) > 250 and len({r.name for r in found}) == len(found)
    assert sum("/text-" in r.name for r in found) > 300


def made(items, gap):
    """Strings that a parsed pattern matches, with each branch and optional part present and absent."""
    outs = [""]
    for op, arg in items:
        kind = str(op)
        if kind == "LITERAL":
            some = [chr(arg)]
        elif kind == "IN":
            some = [gap] if str(arg[0][0]) == "NEGATE" else [chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg][:2]
        elif kind == "BRANCH":
            some = [y for b in arg[1] for y in made(b, gap)]
        elif kind == "SUBPATTERN":
            some = made(arg[3], gap)
        elif kind == "MAX_REPEAT":
            some = [""] * (arg[0] == 0) + [y * max(arg[0], 1) for y in made(arg[2], gap)]
        else:
            some = ["x"] if kind == "NOT_LITERAL" else [""]
        outs = [a + b for a in outs for b in some]
        outs = outs[:: len(outs) // 200 + 1]
    return outs


def test_keywords_keep_every_match():
    for rule in rules():
        for gap in (" ", "\n *     "):
            found = [m for m in (x.encode("latin-1") for x in made(re._parser.parse(rule.pattern.pattern), gap)) if rule.pattern.search(m)]
            assert found, rule.name
            for m in found:
                assert any(k in m for k in rule.keywords), (rule.name, m)


def ungated(text):
    """All matches of all rules without keywords; each that overlaps none of a higher priority stays."""
    kept = []
    for rule in sorted(rules(), key=lambda r: -r.priority):
        for m in rule.pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, _ in kept):
                kept.append((*m.span(), rule.name))
    return sorted(kept)


def test_gates_and_suppression_equal_ungated_rules():
    rng = random.Random(6)
    some = [m for rule in rules() for x in made(re._parser.parse(rule.pattern.pattern), " ")[:6] if rule.pattern.search(m := x.encode("latin-1"))]
    filler = [b"the", b"license", b"under", b"version 2", b"public", b"3.0", b"no", b"by", b"and", b"software", b"cc", b"general"]
    for _ in range(150):
        text = b"".join(rng.choice(some if rng.random() < 0.5 else filler) + rng.choice([b" ", b", ", b"\n    ", b"-"]) for _ in range(25))
        assert [(a, b, r.name) for a, b, r in detections(text)] == ungated(text)
    for text in (b"released under isc", b"distributed under zlib", b"expat license", b"apache license\n      version 2.0"):
        assert len(detections(text)) == 1, text


def test_many_hits_take_near_linear_time():
    text = b"the mit license, all rights reserved; cc by 4.0. " * 8000
    start = time.monotonic()
    assert len(detections(text)) == 24000 and time.monotonic() - start < 10


def test_labels_that_keywords_hid():
    label = lambda t: {r.label for _, _, r in detections(t)}
    assert label(b"licensed under creative commons attribution non-commercial 4.0") == {"cc-by-nc"}
    assert label(b"creative commons attribution no derivatives") == {"cc-by-nd"}
    assert label(b"creative commons zero") == {"cc0"} and label(b"asl 2.0") == {"apache-2"}
    assert label(b"expat license") == {"mit"} and label(b"ms pl") == {"ms-pl"}
    assert label(b"# apache license,\n#      version 2.0") == {"apache-2"}


def test_priority_and_containment():
    one = lambda t: [(r.label, t[a:b]) for a, b, r in detections(t)]
    assert one(b"gnu general public license, version 3.") == [("gpl-3", b"gnu general public license, version 3")]
    assert one(b"spdx-license-identifier: mit") == [("mit", b"spdx-license-identifier: mit")]
    assert [x[0] for x in one(b"cc by-nc-sa 4.0 or cc by 4.0")] == ["cc-by-nc-sa", "cc-by"]
    assert one(b"gnu lesser general public license, version 2.1")[0][0] == "lgpl-2.1"
    assert [x[0] for x in one(b"the mit license, or the apache license, version 2.0; all rights reserved")] == ["mit", "apache-2", "all-rights-reserved"]
    assert one(b"released under the gpl-2.0 license")[0][0] == "gpl-2"
    assert one(b"nothing of the kind") == [] and base_places(b"cc by nc") == [(0, 8, "cc-by-nc")]


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "under the mit license", 5)], "doc_id long, text string, n_words int")
    assert scan(docs, prefix="__").first()["n_words"] == 5
    assert scan(docs.limit(0), prefix="__").count() == 0
