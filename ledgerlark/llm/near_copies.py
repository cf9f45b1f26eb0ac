"""Near copies by the overlap of their shingles, beyond what a fingerprint of 64 bits can tell.

Texts are alike if their sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Fingerprints of such texts differ in about ten of 64 bits, so a search within three
bits finds few of them. This module completes it, and verifies all it finds:

1. Equal word sequences are one class; all further work is on classes.
2. A text is cut into passages of about twelve words where a word's hash says so, so that
   an edit leaves the other passages' hashes as they are; a short text takes its
   shingles instead. Texts that are alike share most passages.
3. A passage that occurs in one class only tells nothing. Of the others each class keeps
   the rarest, as many as it needs to meet any class with which it shares ``SHARE`` of all
   its passages, and ``KEYS`` at most. So a passage that a third of all texts have brings
   nobody together unless a text has hardly anything else.
4. Classes that keep the same passage are compared by their whole sets, and give a forest
   of verified links; of passages that the same classes keep, one does for all. A crowded passage is dealt out in blocks; four classes of it are in
   all its blocks and join them, so a group of kin costs time in proportion to its size.
5. Steps 3 and 4 are quick and find nearly all; they may miss links. A prefix filter over
   the shingles themselves completes them: in any one order of all shingles, two sets of a
   similarity of 0.8 share one of the first n - ceil(0.8 n) + 1 of each. Only classes in
   different components so far are compared, and first by the parities of how many
   shingles fall on each of 1,024 bits: sets differ in as many shingles as bits at least.
   Pairs that this leaves are looked at with as many bits as they have shingles.
   So this costs little, and it is exact. The order puts frequent shingles last as far as a
   sketch of fixed size knows them; its errors cost time, never a link.

Shingles are compared by 32 bits of their hashes: of two texts of a thousand shingles, one
in four thousand pairs of texts has a chance match, which moves its similarity by 0.0005.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import mapped, settled, stored
from .simhash_dedup import near_links, simhash
from .textblocks import INK, LOWER, SpanHash, blocks, mixed, word_spans

SIMILARITY, WIDTH = 0.8, 5
#: One word in so many ends a passage; texts of fewer than SHORT words take their shingles as keys.
PASSAGE, SHORT = 12, 40
#: Share of its passages that a class has in common with one that is alike, and the keys that it keeps at most.
SHARE, KEYS = 0.35, 12
#: Classes and bytes of sets in a block.
BLOCK_ROWS, BLOCK_SIZE = 1024, 4 << 20
#: Places of each of the two rows of the sketch that orders shingles, and shingles that a task counts together.
_SKETCH, _COUNTED = 1 << 20, 8 << 20
#: Bits of the parities that stand for a set, and classes in a block of them.
_POWER, _PARITY_ROWS = 10, 1024
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP_BACK = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lowered = LOWER[data]
    starts, ends, first = word_spans(lowered, offsets, INK)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return mixed(SpanHash(lowered).of(starts, ends) + (ends - starts).astype(np.uint64)), first


def _text_parts(words: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(hash of the sequence, distinct keys, sorted distinct shingles of 32 bits) of one text's word hashes."""
    n = len(words)
    powers = np.full(n + 1, _STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    whole = int(mixed(np.array([np.sum(words * powers[1:]) + np.uint64(n)], np.uint64)).view(np.int64)[0])
    size = min(n, width)
    shingle = np.zeros(n - size + 1 if n else 1, np.uint64)
    for k in range(size):
        shingle = shingle * _STEP + words[k : n - size + 1 + k]
    shingle = np.unique(mixed(shingle))
    if n < SHORT:
        keys = shingle
    else:
        cuts = np.flatnonzero(words[:-1] % np.uint64(PASSAGE) == 0) + 1
        bounds = np.concatenate([[0], cuts, [n]])
        back = np.full(n + 1, _STEP_BACK, np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])])
        keys = np.unique(mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * back[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    return whole, keys, np.unique((shingle >> np.uint64(32)).astype(np.uint32))


def text_parts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, fp, n_keys, keys, shingles) of each row of ``docs`` (doc_id, text); a null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "text"):
            words, first = _word_hashes(data, offsets)
            raw = data.tobytes()
            parts = [_text_parts(words[a:b], width) for a, b in zip(first[:-1], first[1:], strict=True)]
            fps = np.array([simhash(raw[a:b], width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            keys = pa.array([p[1].view(np.int64) for p in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([p[0] for p in parts], pa.int64()), pa.array(fps.view(np.int64)), pa.array([len(p[1]) for p in parts], pa.int32()), keys, pa.array([p[2].tobytes() for p in parts], pa.binary())], ["doc_id", "th", "fp", "n_keys", "keys", "shingles"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, th long, fp long, n_keys int, keys array<long>, shingles binary")


def _forest(rows: list[tuple], similarity: float) -> tuple[list[int], list[int]]:
    """Verified links (none that closes a ring) between rows (th, side, shingles, root): all pairs, or if there are two sides those across; equal roots are linked already."""
    sets = [np.frombuffer(r[2], np.uint32) for r in rows]
    sizes = np.array([len(s) for s in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    side = np.array([r[1] for r in rows])
    roots, first, known = np.unique(np.array([r[3] for r in rows]), return_index=True, return_inverse=True)
    parent = first[known].tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b, parts = [], [], len(roots)
    mark = np.zeros(len(values), np.int64)
    across = side.min() != side.max()
    # All pairs: those of the largest known component meet the rest when the rest are looked at.
    turn = side == side.min() if across else known != np.bincount(known).argmax() if len(roots) < len(rows) else np.ones(len(rows), bool)
    for p in np.flatnonzero(turn):
        mine = place[starts[p] : starts[p + 1]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[place], starts[:-1])
        mark[mine] = 0
        alike = shared >= similarity * (sizes + sizes[p] - shared)
        alike[p] = False
        if across:
            alike &= side != side[p]
        for q in np.flatnonzero(alike).tolist():
            if (x := find(int(p))) != (y := find(q)):
                parent[x] = y
                a.append(rows[p][0])
                b.append(rows[q][0])
                parts -= 1
        if parts == 1:
            break
    return a, b


def alike(parts: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, most: int = KEYS, hints: DataFrame | None = None) -> DataFrame:
    """(a, b): verified links between classes ``th`` of stored text_parts, nearly all that there are up to components; ``hints`` (th, key) are further groups to compare."""
    spark = parts.sparkSession

    def chosen() -> DataFrame:
        pairs = parts.select("th", "n_keys", F.explode("keys").alias("key"))
        often = stored(pairs.groupBy("key").agg(F.min("th").alias("x"), F.max("th").alias("y")).where("x <> y").select("key"), "often")
        known = stored(pairs.join(often, "key").groupBy("th", "n_keys", "key").agg(F.count("*").alias("copies")).drop("copies"), "known")
        classes = known.groupBy("key").agg(F.count("*").alias("df"))
        ordered = F.array_sort(F.collect_list(F.struct("df", "key")))
        per = stored(known.join(classes, "key"), "ranked").groupBy("th", "n_keys").agg(ordered.alias("x"))
        # Of n keys, n - ceil(SHARE * n) + 1 are needed; those that are in no other class are the rarest of all.
        need = F.least(F.lit(most), F.size("x") - F.ceil(F.col("n_keys") * SHARE) + 1)
        kept = per.where(need > 0).select("th", F.explode(F.slice("x", F.lit(1), need.cast("int"))).alias("k")).select("th", F.col("k.key").alias("key"))
        kept = stored(kept.unionByName(hints) if hints else kept, "chosen")
        groups = kept.groupBy("key").agg(F.min("th").alias("x"), F.max("th").alias("y"), *_members())
        return kept.join(stored(_one_each(groups.where("x <> y")), "one"), "key", "left_semi")

    return _compared(settled(spark, chosen, "chosen").withColumn("root", F.col("th")), parts, similarity, block_rows)


def _members() -> list[Column]:
    """Aggregates over distinct ``th`` that are equal for equal groups only, but for collisions of 128 bits."""
    return [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(seed), "th")).alias(f"m{seed}") for seed in range(2)]]


def _one_each(groups: DataFrame) -> DataFrame:
    """One key of each group of classes: keys that stand in the same classes would have them compared again."""
    return groups.groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key")


def _compared(chosen: DataFrame, parts: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """(a, b): verified links between stored ``chosen`` (th, key, root) of a common key and different roots.

    A key with more classes than a block takes is dealt out in blocks, with four of its
    classes in each of them: rows are copied a bounded number of times on average, and
    links between blocks that don't follow from the four are not found.
    """
    wanted = chosen.select("th").distinct()
    sets = stored(parts.select("th", "shingles").join(stored(wanted, "wanted"), "th").groupBy("th").agg(F.min("shingles").alias("shingles")), "sets")
    mixed_th = F.xxhash64("th")
    ends = [f(x) for f in (F.min, F.max) for x in (F.struct(F.col("th").alias("x"), F.col("th")), F.struct(mixed_th.alias("x"), F.col("th")))]
    size = stored(chosen.join(sets, "th").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"), F.array(*[e["th"] for e in ends]).alias("guides")).where("n > 1"), "sizes")
    dealt = chosen.join(size, "key").join(sets, "th")
    many = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / BLOCK_SIZE)).cast("int")
    mine = F.array(F.pmod(mixed_th, F.col("many")).cast("int"))
    spread = dealt.withColumn("many", many).withColumn("i", F.explode(F.when(F.array_contains("guides", F.col("th")), F.sequence(F.lit(0), F.col("many") - 1)).otherwise(mine)))
    rows = spread.select("key", "i", F.lit(0).alias("j"), "th", F.lit(0).alias("side"), "shingles", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        now: tuple | None = None
        out_a: list[int] = []
        out_b: list[int] = []

        def close() -> None:
            if len(group) > 1:
                a, b = _forest(group, similarity)
                out_a.extend(a)
                out_b.extend(b)
            group.clear()

        for batch in batches:
            for key, i, j, th, side, shingles, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    close()
                    now = (key, i, j)
                group.append((th, side, shingles, root))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a.clear()
                out_b.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return mapped(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long")


def _places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles stand in the two rows of the sketch: by their low bits, and by mixed ones."""
    return shingles % np.uint32(_SKETCH), (shingles * np.uint32(0x9E3779B1)) >> np.uint32(12)


def _ordering(parts: DataFrame) -> np.ndarray:
    """A sketch of two rows; the less of its two values is at least the power of two of a shingle's count, as far as tasks meet it more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.frombuffer(b"".join(held), np.uint32), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often].astype(np.int64)), pa.array(counts[often])], ["shingle", "n"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            size += sum(map(len, held[len(held) - batch.num_rows :]))
            if size > 4 * _COUNTED:
                yield counted()
                held.clear()
                size = 0
        if held:
            yield counted()

    sums = mapped(parts.select("shingles"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            power = np.floor(np.log2(batch.column(1).to_numpy())).astype(np.int32)
            for row, place in enumerate(_places(batch.column(0).to_numpy().astype(np.uint32))):
                yield pa.RecordBatch.from_arrays([pa.array((place.astype(np.int64) + row * _SKETCH).astype(np.int32)), pa.array(power)], ["place", "power"])

    rows = mapped(sums, placed, "place int, power int").groupBy("place").agg(F.max("power").alias("power")).toArrow()
    out = np.zeros(2 * _SKETCH, np.uint8)
    out[rows["place"].to_numpy()] = rows["power"].to_numpy()
    return out.reshape(2, _SKETCH)


def prefix_links(parts: DataFrame, linked: DataFrame, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): verified links that, with stored ``linked`` (node, root), make whole the components of classes ``th``."""
    shared = parts.sparkSession.sparkContext.broadcast(_ordering(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            prefixes = []
            for raw in batch.column(1).to_pylist():
                x = np.frombuffer(raw, np.uint32)
                # Less a little, so that rounding never makes a prefix too short.
                size = len(x) - math.ceil(similarity * len(x) - 1e-6) + 1
                one, two = _places(x)
                prefixes.append(x[np.argsort(np.minimum(order[0][one], order[1][two]), kind="stable")[:size]])
            sizes = [len(p) for p in prefixes]
            ths = np.repeat(batch.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ths), pa.array(np.concatenate(prefixes).view(np.int32)) if prefixes else pa.array([], pa.int32())], ["th", "shingle"])

    rows = mapped(parts.select("th", "shingles"), run, "th long, shingle int")
    one = Window.partitionBy("shingle")
    spark = parts.sparkSession

    def possible() -> DataFrame:
        open_ = stored(rows.select("th", "shingle", F.min("th").over(one).alias("x"), F.max("th").over(one).alias("y")).where("x <> y").select("th", "shingle"), "open").distinct()
        rooted = stored(open_.join(linked.withColumnRenamed("node", "th"), "th", "left").select("th", F.col("shingle").cast("long").alias("key"), F.coalesce("root", "th").alias("root")), "rooted")
        groups = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), *_members())
        across = stored(_one_each(groups.where("x <> y")), "across")
        return _possible(stored(rooted.join(across, "key"), "apart"), parts, similarity).distinct()

    pairs = settled(spark, lambda: _still_possible(settled(spark, possible, "possible"), parts, similarity), "pairs")
    both = F.explode(F.array(*[F.struct(F.col(c).alias("th"), F.col(f"root_{c}").alias("root")) for c in "ab"])).alias("x")
    chosen = pairs.select(F.xxhash64("a", "b").alias("key"), both).select("x.th", "key", "x.root")
    return _compared(stored(chosen, "pairs"), parts, similarity, block_rows)


def _parities(parts: DataFrame, scaled: bool = False) -> DataFrame:
    """(th, size, bits) of each row of text_parts; if ``scaled``, a set has a power of two of bits, its size or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
            # The prefix's order and this one take different bits of the hash.
            powers = [max(_POWER, (len(x) - 1).bit_length()) if scaled else _POWER for x in sets]
            bits = [np.packbits(np.bincount(x >> np.uint32(32 - p), minlength=1 << p) & 1).tobytes() for x, p in zip(sets, powers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(bits, pa.binary())], ["th", "size", "bits"])

    return mapped(parts.select("th", "shingles"), run, "th long, size int, bits binary")


def _differing(one: bytes, two: bytes) -> int:
    """Bits in which two parities differ; the longer is folded to the other's length."""
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8)) for x in (one, two))
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(n, -1), axis=1) for x in (a, b))
    return int(np.count_nonzero(a != b))


def _still_possible(pairs: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """Those of stored ``pairs`` that parities as long as the sets don't rule out: for large sets 1,024 bits differ too little to tell."""
    ths = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    known = stored(_parities(parts, scaled=True).join(stored(ths, "ths"), "th").groupBy("th").agg(F.min("size").alias("size"), F.min("bits").alias("bits")), "scaled")
    one, two = (known.select(F.col("th").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    apart = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b, bits_a, bits_b = (c.to_pylist() for c in batch.columns[4:])
            keep = [_differing(x, y) <= apart * (m + n) + 1e-6 for m, n, x, y in zip(size_a, size_b, bits_a, bits_b, strict=True)]
            yield batch.select(["a", "b", "root_a", "root_b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "root_a", "root_b", "size_a", "size_b", "bits_a", "bits_b")
    return mapped(rows, run, "a long, b long, root_a long, root_b long")


def _possible(chosen: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, root_a, root_b), a < b: pairs of a key and different roots in ``chosen`` that sizes and parities don't rule out.

    Rows of a key's commonest root never meet each other. So the others are dealt out in
    blocks, of which each pair meets, and the commonest root's in chunks, each of which
    meets each block: a group of kin that is one component already costs no more than its
    size times the strangers among its keys.
    """
    wanted = stored(chosen.select("th").distinct(), "wanted")
    known = stored(_parities(parts).join(wanted, "th").groupBy("th").agg(F.min("size").alias("size"), F.min("bits").alias("bits")), "parities")
    per_root = chosen.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "root"))
    blocks_of = lambda n: F.greatest(F.lit(1), F.ceil(n / _PARITY_ROWS)).cast("int")
    deal = per_root.groupBy("key").agg(F.sum("n").alias("all"), most.alias("m")).select("key", F.col("m.root").alias("common"), blocks_of(F.col("all") - F.col("m.n")).alias("many"), blocks_of(F.col("m.n")).alias("chunks"))
    dealt = chosen.join(stored(deal, "deal"), "key").join(known, "th")
    h = F.xxhash64("th")
    block, chunk = F.pmod(h, F.col("many")).cast("int"), F.pmod(h, F.col("chunks")).cast("int")
    place = lambda i, j, c, side: F.struct(i.alias("i"), j.alias("j"), c.alias("c"), side.cast("int").alias("side"))
    zero, one = F.lit(0), F.lit(1)
    # Strangers: in each pair of blocks (c = 0), and beside each chunk of the commonest root (c from 1).
    among = F.transform(F.sequence(zero, F.col("many") - 1), lambda o: place(F.least(block, o), F.greatest(block, o), zero, block > o))
    beside = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda c: place(block, block, c + 1, zero))
    kin = F.transform(F.sequence(zero, F.col("many") - 1), lambda b: place(b, b, chunk + 1, one))
    spread = dealt.withColumn("at", F.explode(F.when(F.col("root") == F.col("common"), kin).otherwise(F.concat(among, beside))))
    rows = spread.select("key", "at.i", "at.j", "at.c", "at.side", "th", "root", "size", "bits")
    apart = (1 - similarity) / (1 + similarity)

    def pairs(group: list[tuple]) -> tuple[np.ndarray, ...]:
        side, th, root, size = (np.array(x) for x in list(zip(*group, strict=True))[:4])
        bits = np.frombuffer(b"".join(g[4] for g in group), np.uint64).reshape(len(group), -1)
        across = side.min() != side.max()
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in np.flatnonzero(side == side.min()):
            q = np.flatnonzero((root != root[p]) & (side != side[p] if across else th > th[p]) & (size >= similarity * size[p] - 1e-6) & (size[p] >= similarity * size - 1e-6))
            q = q[np.bitwise_count(bits[q] ^ bits[p]).sum(axis=1, dtype=np.int64) <= apart * (size[q] + size[p]) + 1e-6]
            out[0].append(np.full(len(q), p))
            out[1].append(q)
        p, q = (np.concatenate(x) for x in out)
        a, b = np.where(th[p] < th[q], p, q), np.where(th[p] < th[q], q, p)
        return th[a], th[b], root[a], root[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        now: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(group) > 1 and len((found := pairs(group))[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b", "root_a", "root_b"])
            group.clear()

        for batch in batches:
            for key, i, j, c, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j, c) != now:
                    yield from close()
                    now = (key, i, j, c)
                group.append(tuple(row))
        yield from close()

    return mapped(rows.repartition("key", "i", "j", "c").sortWithinPartitions("key", "i", "j", "c"), run, "a long, b long, root_a long, root_b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, component_id): components of texts whose sets are alike; the least id names one.

    What the search of near fingerprints finds is compared by sets as well.

    Null and empty texts are copies of each other. Ids may be null or repeated.
    """
    parts = stored(text_parts(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width), "parts")
    prints = stored(parts.groupBy("fp").agg(F.min("th").alias("a")), "prints")
    # Texts of one fingerprint are a group, and so are the two of each near link: those too are compared by their sets.
    shared = stored(parts.groupBy("fp").agg(F.min("th").alias("x"), F.max("th").alias("y")).where("x <> y").select("fp"), "shared")
    same = parts.join(shared, "fp").select("th", F.xxhash64(F.lit("fp"), "fp").alias("key")).distinct()
    bits = near_links(prints.select("fp")).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    one, two = (prints.select(F.col("fp").alias(f"fp_{x}"), F.col("a").alias(f"th_{x}")) for x in "ab")
    near = bits.join(one, "fp_a").join(two, "fp_b").select(F.explode(F.array("th_a", "th_b")).alias("th"), F.xxhash64("th_a", "th_b").alias("key")).distinct()
    spark = docs.sparkSession
    links = settled(spark, lambda: alike(parts, similarity, block_rows, hints=same.unionByName(near)), "links")
    more = settled(spark, lambda: prefix_links(parts, connected_components(links), similarity, block_rows), "more")
    linked = connected_components(links.unionByName(more))
    least = stored(parts.groupBy("th").agg(F.min("doc_id").alias("least")), "least")
    roots = stored(least.join(linked.withColumnRenamed("node", "th"), "th", "left").withColumn("root", F.coalesce("root", "th")), "roots")
    names = stored(roots.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    of_class = stored(roots.join(names, "root").select("th", "component_id"), "classes")
    return parts.select("doc_id", "th").join(of_class, "th").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` less those whose component has a smaller id; of rows that repeat an id, all or none stay.

    Null and empty texts are one group. A row without id stays.
    """
    def going() -> DataFrame:
        found = near_copies(docs, doc_id, text)
        return found.where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()

    return docs.join(settled(docs.sparkSession, going, "going"), doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
