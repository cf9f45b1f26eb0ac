"""License scans: ordered signature rules behind keyword gates.

A text is lower-cased (A-Z) and each distinct keyword is looked for once; a rule's pattern
is run only where one of its keywords, of which every match holds one, is there.
Detections are byte intervals. They are resolved by priority: one that lies within the
interval of a detection of higher priority, or that overlaps one, is suppressed. Base
phrases are found apart from that and always stay.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from .license_rules import BASE_PATTERNS, Rule, rules
from .shared import mapped
from .textblocks import LOWER, blocks, word_spans


@functools.cache
def _rules() -> tuple[tuple[Rule, ...], tuple[bytes, ...]]:
    found = tuple(sorted(rules(), key=lambda r: -r.priority))
    return found, tuple(sorted({k for r in found for k in r.keywords}))


def resolved(found: Iterable[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What stays of detections that come by falling priority: those clear of all that came before, by start."""
    starts: list[int] = []
    kept: list[tuple[int, int, Rule]] = []
    for low, high, rule in found:
        # What is kept doesn't overlap, so only the neighbours can.
        i = bisect_left(starts, low)
        if (i == 0 or kept[i - 1][1] <= low) and (i == len(kept) or kept[i][0] >= high):
            starts.insert(i, low)
            kept.insert(i, (low, high, rule))
    return kept


def detections(text: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of what stands in lower-cased ``text`` after suppression, by start."""
    ordered, keywords = _rules()
    there = {k for k in keywords if k in text}
    return resolved((*m.span(), rule) for rule in ordered if not there.isdisjoint(rule.keywords) for m in rule.pattern.finditer(text)) if there else []


def base_places(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, label) of each place of a base phrase in lower-cased ``text``."""
    return sorted((*m.span(), label) for label, word, pattern in BASE_PATTERNS if word in text for m in pattern.finditer(text))


def scan(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, base and found.

    base: the places of base phrases (start: words before it, label); found: the other
    detections (low, high: bytes; label, rule, score). Null texts are empty. Memory is
    linear in the longest text. ``prefix`` keeps new names off those of ``docs``.
    """
    base_type = ArrayType(StructType().add("start", LongType()).add("label", StringType()))
    found_type = ArrayType(StructType().add("low", IntegerType()).add("high", IntegerType()).add("label", StringType()).add("rule", StringType()).add("score", DoubleType()))
    new = [prefix + c for c in ("n_words", "base", "found")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = [pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("label", pa.string()), ("rule", pa.string()), ("score", pa.float64())]))]
        for rows, data, offsets in blocks(batches, text):
            starts, _, first = word_spans(data, offsets)
            lowered = LOWER[data].tobytes()
            base: list[list[dict]] = []
            found: list[list[dict]] = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                body = lowered[a:b]
                places = base_places(body)
                at = np.searchsorted(starts, [a + p[0] for p in places]) - np.searchsorted(starts, a)
                base.append([{"start": int(s), "label": p[2]} for s, p in zip(at, places, strict=True)])
                found.append([{"low": low, "high": high, "label": r.label, "rule": r.name, "score": r.score} for low, high, r in detections(body)])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(first)), pa.array(base, arrow[0]), pa.array(found, arrow[1])], [*rows.schema.names, *new])

    schema = StructType([*docs.schema]).add(new[0], LongType()).add(new[1], base_type).add(new[2], found_type)
    return mapped(docs, run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    base, more = F.col("base.label"), F.col("found.label")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"), labels(base).alias("base_labels"), labels(F.concat(base, more)).alias("labels"), score.alias("score"), F.size("found").cast("long").alias("n_found"))
