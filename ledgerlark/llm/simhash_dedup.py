"""SimHash near-duplicates by multi-index hashing.

A document's words (runs of anything but ASCII white space, A-Z lower-cased) form
shingles of ``width`` words, repeats included; a shingle's XXH64 (seed 42) votes on
64 bits. Fingerprints that differ in at most three bits are linked, and a document's
component is the least id that it reaches over links.

Linking: if two 64-bit fingerprints differ in at most 3 bits, one of their two 32-bit
segments differs in at most 1. So each distinct fingerprint stands in a table under
each segment's value, and asks for each value of the Hamming ball of radius 1 around
its own segment; of two segments that differ in one bit, the one that has a 0 there
asks, which halves the questions. Hits are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import mapped, stored
from .textblocks import ranges

_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
_PLACES = (np.arange(8) * 256).astype(np.int16)
_VALUES = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: A bucket with more table entries than this is divided by the rest of the fingerprint.
HEAVY = 1024
#: Shingles hashed before their votes are added up.
_PIECE = 1 << 18


def simhash(text: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint of UTF-8 text: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    n, x = len(words), xxhash.xxh64_intdigest
    if not n:
        return 0
    if n < width:
        return x(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: n - width + 1], ends[width - 1 :]
    votes = np.zeros((8, 256), np.int64)
    for k in range(0, len(starts), _PIECE):
        hashes = np.array([x(joined[s:e], 42) for s, e in zip(starts[k : k + _PIECE].tolist(), ends[k : k + _PIECE].tolist(), strict=True)], np.uint64)
        votes += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    return int(_VALUES[((votes @ _BITS).ravel() * 2) > len(starts)].sum())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row; a null text has no words, and ids stay as they are."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((simhash(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, f"doc_id {kind}, fp long")


def _keyed(rows: DataFrame, halves: list, bits: int, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(table, questions), each with (seg, key): values of the segments, and values one bit above them."""
    mine = F.array(*[F.struct(F.lit(k).alias("seg"), h.alias("key")) for k, h in enumerate(halves)])
    table = rows.select(*carried, F.explode(mine).alias("s")).select(*carried, "s.seg", "s.key")
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.lit(1).cast("long") * F.pow(F.lit(2.0), b).cast("long")), lambda v: F.col("key").bitwiseAND(v) == 0)
    asked = table.select(*carried, "seg", F.explode(F.transform(flips, lambda v: F.col("key").bitwiseOR(v))).alias("key"))
    return table, asked


#: Masks of up to three of 16 bits, the least first.
_BALL = np.array(sorted((m for m in range(1 << 16) if m.bit_count() <= 3), key=lambda m: (m.bit_count(), m)), np.uint64)


class _Forest:
    """Links that join what no earlier link has joined."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = np.unique(nodes)
        self.root = np.arange(len(self.nodes))
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Takes in links between fingerprints; of those that go out of one tree one counts at a time."""
        i, j = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        while True:
            p, q = self.root[i], self.root[j]
            apart = p != q
            if not apart.any():
                return
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            high, first = np.unique(np.maximum(p, q), return_index=True)
            # A root hangs itself under a lesser one, so no ring can arise.
            self.root[high] = np.minimum(p, q)[first]
            self.links.append((self.nodes[i[first]], self.nodes[j[first]]))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]

    def table(self) -> pa.Table:
        a, b = (np.concatenate([x[k] for x in self.links] or [np.zeros(0, np.uint64)]) for k in (0, 1))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def _near(left: np.ndarray, right: np.ndarray, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within three bits. What differs between all of a part, but for few bits, is the 16 bits from ``shift`` on.

    Few are compared each with each. Of many, each of ``left`` looks up the ball of its 16
    bits in ``right``, so the time is linear.
    """
    if len(left) * len(right) <= len(_BALL) * (len(left) + len(right)):
        for at in range(0, len(left), 256):
            rows, cols = np.nonzero(np.bitwise_count(left[at : at + 256, None] ^ right[None, :]) <= 3)
            yield left[at + rows], right[cols]
        return
    free = (right >> np.uint64(shift)) & np.uint64(0xFFFF)
    order = np.argsort(free, kind="stable")
    right, first = right[order], np.searchsorted(free[order], np.arange((1 << 16) + 1))
    mine = ((left >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
    for mask in _BALL.astype(np.int64).tolist():
        value = mine ^ mask
        times = first[value + 1] - first[value]
        a, b = np.repeat(left, times), right[ranges(first[value], times)]
        close = np.bitwise_count(a ^ b) <= 3
        yield a[close], b[close]


def _forest(batch: pa.Table) -> pa.Table:
    """A spanning forest of the links of a bucket's entries with each other and with its questions.

    ``flipped`` rows stand under a value one bit above theirs; two of them needn't meet,
    and nor need two questions.
    """
    fp, asks, flipped = batch["fp"].to_numpy().view(np.uint64), batch["asks"].to_numpy(), batch["flipped"].to_numpy()
    # The bucket fixes one 32-bit segment, the part a half of the other one; the second half is free.
    shift = (0 if batch["s1"][0].as_py() == 0 else 32) + (0 if batch["seg"][0].as_py() == 0 else 16)
    forest = _Forest(fp)
    for left, right in ((fp, fp[~asks & ~flipped]), (fp[asks & ~flipped], fp[~asks & flipped])):
        for a, b in _near(left, right, shift):
            forest.add(a, b)
    return forest.table()


def near_links(distinct: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, b) over distinct ``fp``: with the same components as all pairs that differ in 3 bits or fewer.

    Buckets of up to ``heavy`` table entries give every verified pair. A larger one
    is divided again by the other segment's 16-bit halves in the same way; such a
    part has at most 2**16 distinct entries, and gives a spanning forest of its links in
    time linear in its rows.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    table, asked = _keyed(distinct.select("fp"), [high, low], 32, "fp")
    big = stored(table.groupBy("seg", "key").count().where(F.col("count") > heavy).select("seg", "key"), "heavy")
    some = not big.isEmpty()
    rows = table.select("seg", "key", "fp", F.lit(False).alias("asks")).unionByName(asked.select("seg", "key", "fp", F.lit(True).alias("asks")))
    light = table.join(big, ["seg", "key"], "left_anti") if some else table
    t, q = light.select("seg", "key", F.col("fp").alias("a")), rows.select("seg", "key", F.col("fp").alias("b"), "asks")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3
    links = t.join(q, (t.seg == q.seg) & (t.key == q.key) & near & (q.asks | (F.col("a") < F.col("b")))).select("a", "b")
    if not some:
        return links
    inner = rows.join(big, ["seg", "key"]).withColumns({"k1": F.col("key"), "s1": F.col("seg"), "rest": F.when(F.col("seg") == 0, low).otherwise(high)})
    halves = [F.shiftrightunsigned("rest", 16), F.col("rest").bitwiseAND(0xFFFF)]
    table2, asked2 = _keyed(inner.drop("seg", "key"), halves, 16, "s1", "k1", "fp", "asks")
    # Either of an entry and a question of the first level can have the 0 bit here, so both ask; asks stays the first level's.
    parts = table2.withColumn("flipped", F.lit(False)).unionByName(asked2.withColumn("flipped", F.lit(True)))
    return links.unionByName(parts.groupBy("s1", "k1", "seg", "key").applyInArrow(_forest, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of ``docs``.

    Empty and null texts share the fingerprint 0. Rows that repeat an id each keep a
    row. A null id is never a component's name unless the component has no other.
    """
    prints = stored(fingerprints(docs, doc_id, text, width), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = connected_components(near_links(classes, heavy))
    named = linked.join(classes.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    across = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    names = stored(classes.join(across, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "names")
    return prints.join(names, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Rows of ``docs`` less those whose component has a smaller id; of rows that repeat an id, all or none stay."""
    found = near_duplicates(docs, doc_id, text, width)
    going = found.where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(going, doc_id, "left_anti").select(docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
