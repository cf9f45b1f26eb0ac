"""Removal of byte strings of a least length that occur more than once in a corpus.

A byte goes if a string of ``least`` bytes covers it that starts anywhere else too,
the same document included. Repeats are found by the interval expansion of ``bwt`` on
bounded blocks; this module brings strings that can be equal into one block:

1. Every window of ``least`` bytes picks the 16-byte string with the least hash in it
   (the last of equals). Equal windows pick alike, so windows can only be equal if
   their picks (anchors) are. Neighbouring windows share a pick; such a run is one
   chunk, a row of some 285 bytes of text for about 93 windows.
2. Anchors that occur once drop out. Chunks that are equal as a whole are one class;
   if an anchor has one class only, all its windows are repeated.
3. The other anchors' classes, one text each, go to blocks with all classes of an
   anchor together, where the transform finds the windows they share.
4. An anchor with too many classes for a block is divided: its windows are split by
   their distance to the anchor, and grouped by the bytes that all windows of a part
   have. Parts whose bytes are equal as a whole are settled, parts that are small
   enough go to blocks, others are halved again, down to single windows.

Hashes of 64 bits stand for anchors, and such a pair for a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from .bwt import repeated_starts
from .shared import mapped, settled, stored
from .textblocks import BLOCK_BYTES, SpanHash, blocks, mixed, ranges

#: Bytes of an anchor.
GRAM = 16
#: Classes of one anchor that a block takes.
LIMIT = 2048
_MASK = np.uint64((1 << 22) - 1)
_PIECE = 1 << 21


def _least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[i : i + width] for each i: that of a block's tail and of the next block's head."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(rows, width)
    heads = np.minimum.accumulate(table, axis=1).ravel()
    tails = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[:n], heads[width - 1 : width - 1 + n])


def chunks(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor's distance, anchor, chunk) of each run of windows with one anchor.

    ``data`` holds whole texts that begin at ``offsets``; fewer than 2**22 bytes.
    """
    empty = np.zeros(0, np.int64)
    gram = min(GRAM, least)
    if len(data) < least:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    spans = SpanHash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = mixed(spans.of(at, at + gram))
    packed = (hashes & ~_MASK) | (_MASK - at.astype(np.uint64))
    picks = (_MASK - (_least_in_window(packed, least - gram + 1) & _MASK)).astype(np.int64)
    valid = ranges(offsets[:-1], np.maximum(0, np.diff(offsets) - least + 1))
    if not len(valid):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    pick = picks[valid]
    head = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    start, n = valid[head], np.diff(np.concatenate([head, [len(valid)]]))
    whole = mixed(spans.of(start, start + n - 1 + least) ^ mixed(n.astype(np.uint64)))
    return start, n, pick[head] - start, hashes[pick[head]], whole


def _text_key(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text."""
    return np.array([int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


def _anchors(docs: DataFrame, least: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            keys = _text_key(data, offsets)
            for at in range(0, len(data), _PIECE) if len(data) > _PIECE else [0]:
                cut = np.array([0, min(_PIECE + least - 1, len(data) - at)]) if len(data) > _PIECE else offsets
                start, n, off, anchor, chunk = chunks(data[at : at + cut[-1]], cut, least)
                doc = np.searchsorted(offsets, start + at, "right") - 1
                ids = rows.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (keys[doc], (start + at - offsets[doc]).astype(np.int32), n.astype(np.int16), off.astype(np.int16), anchor.view(np.int64), chunk.view(np.int64)))], ["doc_id", "th", "start", "n", "off", "anchor", "chunk"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, th long, start int, n short, off short, anchor long, chunk long")


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` replaced by ``__th``, its hash, and ``__z``, its compressed bytes (null: null), so that shuffles move less."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for rows, data, offsets in blocks(batches, "__text"):
            missing = rows.column(rows.num_columns - 1).is_null().to_pylist()
            z = [None if gone else (b - a).to_bytes(4, "little") + codec.compress(data[a:b].tobytes(), asbytes=True) for a, b, gone in zip(offsets[:-1].tolist(), offsets[1:].tolist(), missing, strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(_text_key(data, offsets)), pa.array(z, pa.binary())], [*rows.schema.names[:-1], "__th", "__z"])

    schema = StructType([docs.schema[c] for c in rest]).add("__th", LongType()).add("__z", BinaryType())
    return mapped(docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text")), run, schema)


def _unpacked(z: bytes | None) -> bytes:
    if not z:
        return b""
    return pa.Codec("zstd").decompress(z[4:], int.from_bytes(z[:4], "little"), asbytes=True)


def _class_texts(places: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(anchor, chunk, copies, off, text): the bytes of each class's first place."""
    per_doc = places.groupBy(F.col("at.doc_id").alias("p_id"), F.col("at.th").alias("p_th")).agg(F.collect_list(F.struct("at.start", "at.n", "at.off", "anchor", "chunk", "copies")).alias("places"))
    packed = _packed(docs, "text")
    joined = packed.join(per_doc, packed["doc_id"].eqNullSafe(per_doc["p_id"]) & (packed["__th"] == per_doc["p_th"])).select("__z", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, places in zip(batch.column(0), batch.column(1), strict=True):
                text, items = _unpacked(z.as_py()), places.values
                start, n = items.field("start").to_pylist(), items.field("n").to_pylist()
                cut = [text[a : a + b - 1 + least] for a, b in zip(start, n, strict=True)]
                yield pa.RecordBatch.from_arrays([items.field("anchor"), items.field("chunk"), items.field("copies"), items.field("off"), pa.array(cut, pa.binary())], ["anchor", "chunk", "copies", "off", "text"])

    return mapped(joined, run, "anchor long, chunk long, copies long, off short, text binary")


def _covered_runs(starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal (start, length) covered by strings of ``least`` bytes at ``starts``, ascending."""
    if not len(starts):
        return []
    head = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + least]))
    last = starts[np.concatenate([head[1:] - 1, [len(starts) - 1]])]
    return list(zip(starts[head].tolist(), (last + least - starts[head]).tolist(), strict=True))


def _search(classes: DataFrame, least: int) -> DataFrame:
    """(anchor, chunk, low, len): the bytes of classes (anchor, chunk, copies, text) that repeat among an anchor's classes.

    Anchors are sorted within partitions and fill blocks one after another; an
    anchor's classes are never parted, and are few enough for a block.
    """

    def found(block: list[tuple]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for (anchor, chunk, copies, text), starts in zip(block, repeated_starts([x[3] for x in block], least), strict=True):
            runs = [(0, len(text))] if copies > 1 else _covered_runs(starts, least)
            rows += [(anchor, chunk, low, n) for low, n in runs]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["anchor", "chunk", "low", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > BLOCK_BYTES // 2 and row[0] != block[-1][0]:
                    yield found(block)
                    block, held = [], 0
                block.append(row)
                held += len(row[3])
        if block:
            yield found(block)

    return mapped(classes.select("anchor", "chunk", "copies", "text").repartition("anchor").sortWithinPartitions("anchor"), run, "anchor long, chunk long, low int, len int")


def _cut(start: Column, end: Column) -> Column:
    return F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))


def _divided(hot: DataFrame, least: int, limit: int) -> DataFrame:
    """(anchor, chunk, low, len) for classes of anchors that a block can't take; see the module's step 4."""
    out = [hot.where("copies > 1").select("anchor", "chunk", F.lit(0).alias("low"), F.length("text").alias("len"))]
    low, high = 0, least - min(GRAM, least)
    rows = hot.select("anchor", "chunk", "text", F.col("off").cast("int").alias("off"), (F.length("text") - least + 1).alias("n"), F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    while True:
        halves = F.array(F.struct(F.col("lo").alias("lo"), F.floor((F.col("lo") + F.col("hi")) / 2).cast("int").alias("hi")), F.struct((F.floor((F.col("lo") + F.col("hi")) / 2) + 1).cast("int").alias("lo"), F.col("hi").alias("hi")))
        parts = rows.withColumn("part", F.explode(F.when(F.col("lo") < F.col("hi"), halves).otherwise(F.array(F.struct("lo", "hi"))))).withColumns({"lo": F.col("part.lo"), "hi": F.col("part.hi")}).drop("part")
        parts = parts.where((F.col("lo") <= F.col("off")) & (F.col("hi") >= F.col("off") - F.col("n") + 1))
        first, last = F.col("off") - F.least("hi", "off"), F.col("off") - F.greatest(F.col("lo"), F.col("off") - F.col("n") + 1)
        keyed = parts.withColumns({"low": first, "part": _cut(first, last + least)})
        keyed = keyed.withColumns({"key": F.xxhash64("anchor", "lo", "hi", _cut(F.col("off") - F.col("lo"), F.col("off") - F.col("hi") + least)), "sub": F.xxhash64("part")})
        keyed = stored(keyed, "parts")
        per_sub = stored(keyed.groupBy("key", "sub").agg(F.count("*").alias("copies"), F.min("part").alias("text")), "subs")
        stats = stored(per_sub.groupBy("key").agg(F.count("*").alias("subs"), F.sum("copies").alias("all")).where("all > 1"), "stats")
        known = per_sub.join(stats, "key")
        small = known.where(F.col("subs") <= limit)
        runs = _search(small.select(F.col("key").alias("anchor"), F.col("sub").alias("chunk"), "copies", "text"), least)
        runs = stored(runs.select(F.col("anchor").alias("key"), F.col("chunk").alias("sub"), F.col("low").alias("more"), "len"), "runs")
        out.append(keyed.select("key", "sub", "anchor", "chunk", "low").join(runs, ["key", "sub"]).select("anchor", "chunk", (F.col("low") + F.col("more")).cast("int").alias("low"), "len"))
        wide = stats.where(F.col("subs") > limit).select("key")
        if wide.isEmpty():
            break
        rows = keyed.drop("low", "part", "sub").join(wide, "key", "left_semi").drop("key")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def repeated_ranges(docs: DataFrame, least: int = 200, limit: int = LIMIT) -> DataFrame:
    """(doc_id, th, low, len): byte ranges of ``docs`` (doc_id, text) that repeat; th is a hash of the text, ranges can overlap."""
    found = stored(_anchors(docs, least), "anchors")
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("chunk").alias("least"), F.max("chunk").alias("most")).where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("several")), "often")
    again = stored(found.join(often, "anchor"), "again")
    plain = again.where("NOT several").select("doc_id", "th", F.col("start").alias("low"), (F.col("n") + F.lit(least - 1)).cast("int").alias("len"))
    several = again.where("several")
    classes = several.groupBy("anchor", "chunk").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "start", "n", "off")).alias("at"))
    texts = stored(_class_texts(classes, docs, least), "texts")
    hot = stored(texts.groupBy("anchor").count().where(F.col("count") > limit).select("anchor"), "hot")
    if hot.isEmpty():
        runs = _search(texts, least)
    else:
        runs = _search(texts.join(hot, "anchor", "left_anti"), least).unionByName(_divided(stored(texts.join(hot, "anchor", "left_semi"), "divided"), least, limit))
    runs = stored(runs, "runs")
    shared = several.join(runs, ["anchor", "chunk"]).select("doc_id", "th", (F.col("start") + F.col("low")).alias("low"), "len")
    return plain.unionByName(shared)


def _removal(text: bytes, lows: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``text``, the bytes removed, and the number of maximal removed runs."""
    if not len(lows):
        return text, 0, 0
    turn = np.argsort(lows, kind="stable")
    lows, reach = lows[turn], np.maximum.accumulate((lows + lengths)[turn])
    head = np.flatnonzero(np.concatenate([[True], lows[1:] > reach[:-1]]))
    begins, ends = lows[head].tolist(), reach[np.concatenate([head[1:] - 1, [len(lows) - 1]])].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)], strict=True))
    return kept, len(text) - len(kept), len(begins)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 200, limit: int = LIMIT, prefix: str = "") -> DataFrame:
    """Rows of ``docs`` with n_bytes, n_removed, n_spans and kept (binary: the bytes that are left; null text: null).

    Columns of ``docs`` other than ``text`` stay; names that clash with the new ones
    are replaced by them (``prefix`` comes before each new name). Rows that repeat an id are told apart by their texts; rows
    equal in both repeat each other, so all of such a text from 200 bytes on goes.
    """
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # The ranges are few; what led to them goes before the texts are joined with them.
    where = settled(docs.sparkSession, lambda: repeated_ranges(named, least, limit), "ranges")
    per_doc = where.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__key")).agg(F.collect_list(F.struct("low", "len")).alias("__ranges"))
    new = [prefix + c for c in ("n_bytes", "n_removed", "n_spans", "kept")]
    packed = _packed(docs.drop(*[c for c in new if c not in (doc_id, text)]), text)
    rest = [c for c in packed.columns if c not in ("__th", "__z")]
    joined = packed.join(per_doc, packed[doc_id].eqNullSafe(per_doc["__id"]) & (packed["__th"] == per_doc["__key"]), "left").select(*[packed[f"`{c}`"] for c in rest], "__z", "__ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[tuple[int, int, int]] = []
            left: list[bytes | None] = []
            for z, found in zip(batch.column(len(rest)), batch.column(len(rest) + 1), strict=True):
                packed_text = z.as_py()
                body = _unpacked(packed_text)
                low, n = (found.values.field(k).to_numpy() for k in ("low", "len")) if found.is_valid else (np.zeros(0, np.int64),) * 2
                kept, removed, spans = _removal(body, low, n)
                counts.append((len(body), removed, spans))
                left.append(None if packed_text is None else kept)
            cols = [pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols, pa.array(left, pa.binary())], [*rest, *new])

    schema = StructType([packed.schema[c] for c in rest])
    for c in new[:3]:
        schema = schema.add(c, LongType())
    return mapped(joined, run, schema.add(new[3], BinaryType()))


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 200) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; a character whose bytes are only partly left goes, as do rows emptied by the cut."""
    done = without_repeats(docs, doc_id, text, least, prefix="__")
    # A cut inside a character leaves stray bytes, which become U+FFFD and go; texts without a cut stay as they are.
    kept = F.col("__kept").cast("string")
    left = F.when(F.col("__n_removed") > 0, F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))).otherwise(kept)
    stay = done.where("__n_removed < __n_bytes OR __n_bytes = 0").withColumn(text, left)
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    """What a removal of all 200-byte repeats does to every document."""
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))
