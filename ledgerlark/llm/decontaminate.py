"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a bounded slice of whole documents (a longer document is a shard of its
own). Its words (runs of 0-9, a-z and bytes from 0x80, A-Z lower-cased) become one
sequence with a separator after each document, and its suffixes are sorted. Every
suffix of every test item is looked up by binary search, word by word, up to the window
(13 words; the whole item if that is shorter), which gives all places of the window. A
place marks its words as hit. From the last suffix of an item to its first, places that
go on one word later are joined, which gives the longest verbatim match of each item in
each document, and where it stands in both.

Words are compared by 64-bit hashes. Test items are files of bounded bytes in the shared
folder, each of which is searched for in all shards: nothing goes through the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .bwt import suffix_order
from .shared import mapped, new_folder, open_file, stored
from .textblocks import LOWER, SpanHash, gathered, mixed, ranges, word_spans

#: Bytes of a file of test items, of which a worker holds eight; more are read again for each shard.
ITEM_BYTES = 4 << 20
#: Bytes of a shard: each test suffix is searched once in it.
SHARD_BYTES = 4 << 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each text's first word and the number of words)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return mixed(SpanHash(data).of(starts, ends) + (ends - starts).astype(np.uint64)), first


class Items:
    """Test items as one array of word hashes; ``need`` is the window of each suffix, 0 where none starts; ``name`` numbers distinct ids."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int):
        offsets = np.cumsum([0, *map(len, texts)])
        self.words, self.first = words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
        count = np.diff(self.first)
        self.item = np.repeat(np.arange(len(ids)), count)
        size = np.minimum(count, window)[self.item]
        self.left = (self.first[1:][self.item] - np.arange(len(self.words))) if len(self.words) else np.zeros(0, np.int64)
        self.need = np.where(self.left >= size, size, 0)
        self.names = sorted(set(ids))
        number = {x: k for k, x in enumerate(self.names)}
        self.name = np.array([number[x] for x in ids], np.int64)
        self.window = window


@functools.lru_cache(maxsize=8)
def _loaded(path: str, window: int) -> Items:
    with open_file(path, "rb") as f, pa.ipc.open_stream(f) as reader:
        table = reader.read_all()
    return Items(table["id"].to_pylist(), table["text"].to_pylist(), window)


class Shard:
    """Whole texts as words, with their suffixes in order of their first ``depth`` words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        self.words, self.first = words_of(data, offsets)
        count = np.diff(self.first)
        #: Where each text begins in ``sequence``, which has a separator after each.
        self.begin = self.first[:-1] + np.arange(len(count))
        self.vocabulary, ids = np.unique(self.words, return_inverse=True)
        self.sequence = np.zeros(len(self.words) + len(count), np.int64)
        self.sequence[ranges(self.begin, count)] = ids + 1
        self.order = suffix_order(self.sequence, depth, max(1, int(len(self.vocabulary)).bit_length()))

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, places, "right") - 1


def longest_matches(shard: Shard, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, low, high): for each test suffix, the words of its longest match (up to the window) and its ranks in the shard's order."""
    sequence, order = shard.sequence, shard.order
    place = np.searchsorted(shard.vocabulary, items.words)
    known = place < len(shard.vocabulary)
    known[known] = shard.vocabulary[place[known]] == items.words[known]
    wanted = np.where(known, place + 1, -1)
    n = len(items.words)
    length, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(order))
    alive = np.arange(n)
    for depth in range(items.window):
        alive = alive[items.left[alive] > depth]
        alive = alive[wanted[alive + depth] > 0]
        if not len(alive):
            break
        bounds = []
        for side in (0, 1):  # the first rank whose word is not below, and the first above
            a, b, word = low[alive].copy(), high[alive].copy(), wanted[alive + depth]
            while (open_ := a < b).any():
                mid = (a + b) // 2
                at = sequence[(order[np.minimum(mid, len(order) - 1)] + depth) % len(sequence)]
                right = open_ & ((at < word) if side == 0 else (at <= word))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            bounds.append(a)
        some = bounds[1] > bounds[0]
        alive = alive[some]
        low[alive], high[alive], length[alive] = bounds[0][some], bounds[1][some], depth + 1
    return length, low, high


def verbatim(shard: Shard, items: Items, hit: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(text, name): (words, place in the item, place in the text)}: the longest verbatim match of a window or more, the first of equals.

    From the last suffix to the first, a place takes over the length that the next suffix
    has at the next place; a suffix's places are all that is held.
    """
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    later, sizes, last = np.zeros(0, np.int64), np.zeros(0, np.int64), -1
    for s in hit[::-1].tolist():
        at = np.sort(shard.order[low[s] : high[s]])
        size = np.full(len(at), items.need[s])
        if last == s + 1 and items.item[last] == items.item[s]:
            k = np.minimum(np.searchsorted(later, at + 1), len(later) - 1)
            goes = later[k] == at + 1
            size[goes] = sizes[k[goes]] + 1
        text = shard.text_of(at)
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        name, place = int(items.name[items.item[s]]), s - int(items.first[items.item[s]])
        for t, best, a, b in zip(text[heads].tolist(), np.maximum.reduceat(size, heads).tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
            start = int(at[a + int(np.argmax(size[a:b] == best))] - shard.begin[t])
            if (t, name) not in found or (-best, place, start) < (-found[t, name][0], *found[t, name][1:]):
                found[t, name] = (best, place, start)
        later, sizes, last = at, size, s
    return found


def _searched(docs: DataFrame, text: str, paths: list[str], window: int, prefix: str) -> DataFrame:
    """``docs`` with n_words, hits, items and matches; see ``with_hits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in gathered(batches, text, SHARD_BYTES):
            shard = Shard(data, offsets, window)
            step = np.zeros(len(shard.words) + 1, np.int64)
            names: list[dict[str, tuple[int, int, int]]] = [{} for _ in range(rows.num_rows)]
            for path in paths:
                items = _loaded(path, window)
                length, low, high = longest_matches(shard, items)
                hit = np.flatnonzero((items.need > 0) & (length >= items.need))
                # Equal windows have equal ranks: their words are marked once.
                ranks = np.unique(np.stack([low[hit], high[hit], items.need[hit]], axis=1), axis=0)
                at = shard.order[ranges(ranks[:, 0], ranks[:, 1] - ranks[:, 0])]
                start = at - shard.text_of(at)
                np.add.at(step, start, 1)
                np.add.at(step, start + np.repeat(ranks[:, 2], ranks[:, 1] - ranks[:, 0]), -1)
                for (t, name), match in verbatim(shard, items, hit, low, high).items():
                    known = names[t].get(items.names[name])
                    if known is None or (-match[0], *match[1:]) < (-known[0], *known[1:]):
                        names[t][items.names[name]] = match
            first = shard.first
            covered = np.cumsum(step)[:-1] > 0
            # Runs of hit words, ended by a text's end.
            head, tail = covered.copy(), covered.copy()
            inner = np.zeros(len(covered) + 1, bool)
            inner[first] = True
            head[1:] &= ~covered[:-1] | inner[1:-1]
            tail[:-1] &= ~covered[1:] | inner[1:-1]
            begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
            owner = np.searchsorted(first, begin, "right") - 1
            cuts = np.searchsorted(owner, np.arange(len(offsets)))
            runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - first[owner], pa.int32()), pa.array(end - begin, pa.int32())], ["low", "n"]))
            sorted_names = [sorted(x) for x in names]
            ids = pa.array(sorted_names, pa.list_(pa.string()))
            matches = pa.array([[{"item": i, "at": x[i][1], "low": x[i][2], "n": x[i][0]} for i in order] for x, order in zip(names, sorted_names, strict=True)], pa.list_(pa.struct([("item", pa.string()), ("at", pa.int32()), ("low", pa.int32()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(first)), runs, ids, matches], [*rows.schema.names, *[prefix + c for c in ("n_words", "hits", "items", "matches")]])

    place = StructType().add("low", IntegerType()).add("n", IntegerType())
    match = StructType().add("item", StringType()).add("at", IntegerType()).add("low", IntegerType()).add("n", IntegerType())
    schema = StructType([*docs.schema]).add(prefix + "n_words", LongType()).add(prefix + "hits", ArrayType(place))
    return mapped(docs, run, schema.add(prefix + "items", ArrayType(StringType())).add(prefix + "matches", ArrayType(match)))


def item_files(benchmark: DataFrame, item_id: str, text: str, limit: int) -> list[str]:
    """Files of (id, text) of about ``limit`` bytes each (a longer item has one to itself) in the shared folder."""
    spark = benchmark.sparkSession
    folder = new_folder(spark, "items")
    named = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    size = named.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    schema = pa.schema([("id", pa.string()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get(), []
        for rows, _, _ in gathered(batches, "text", limit):
            # Each attempt of a task has names of its own; only those of the one that counts are told.
            path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):04d}.arrow"
            with open_file(path, "wb") as f, pa.ipc.new_stream(f, schema) as out:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(rows.columns, schema.types, strict=True)], schema=schema))
            made.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return sorted(r["path"] for r in stored(mapped(named.repartition(-(-size // limit) or 1), run, "path string"), "item-files").collect())


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, limit: int = ITEM_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, hits, items and matches, without a shuffle of ``docs``.

    hits are maximal runs of hit words (low, n); items the distinct ids of items whose
    windows occur, sorted; matches the longest verbatim match of each of them: its place in
    the item (at) and in the text (low), and its words (n), the first of equals. Null texts
    have no words; an item without words has no window; an item without id is named
    "null"; items with one id count as one. Names in ``docs`` must not clash with the new
    ones, which ``prefix`` precedes. ``limit`` is the bytes of a file of items and changes
    no result.
    """
    return _searched(docs, text, item_files(benchmark, item_id, item_text, limit), window, prefix)


def contaminated(n_hit, n_words):
    """The contract's rule: some word is hit, and hit words are a twentieth of all or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(hits: str):
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, r: a + r["n"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated; columns of ``docs`` beginning with "__decontam_" aren't allowed."""
    p = "__decontam_"
    found = with_hits(docs, benchmark, text, item_id, item_text, prefix=p)
    return found.where(~contaminated(n_hit(f"{p}hits"), F.col(f"{p}n_words"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    """Hit words, matched items, longest match and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("n_hit", n_hit("hits"))
    digest = F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256)
    longest = F.coalesce(F.array_max("matches.n"), F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), longest.alias("longest"))
