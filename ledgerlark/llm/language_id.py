"""Language identification by interpolated Kneser-Ney character models.

Texts become letters in lower case with single spaces for all else. For each language
the counts of all 5-grams of characters are gathered over all training texts; those
of the lower orders are Kneser-Ney's continuation counts (in how many different
longer strings a string ends), and each order's discount follows from how many of its
strings were counted once and twice. A string's probability interpolates all orders.

The whole model scores: for each language and order, sorted arrays of 64-bit hashes with
probabilities and back-off weights, cut into files by ranges of the hash and kept in the
shared folder. Tasks read the files that their texts need and hold a bounded amount of
them, so the model may outgrow any executor's memory; it never passes through the
driver. A text gets the language with the lowest cross-entropy per character. It is
accepted if that is no higher than what a share ``ACCEPT`` of that language's texts in a
fold that the model was not fitted on reach.
"""

from __future__ import annotations

import functools
import math
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

from .shared import mapped, new_folder, open_file, stored
from .textblocks import blocks, mixed, ranges

ORDER = 5
#: Strings in a file of the model, about, and bytes of such files that a worker holds.
PART, HELD_BYTES = 1 << 20, 256 << 20
#: Share of a language's unseen texts that its threshold accepts, and one in so many training texts (by hash) that thresholds are set on.
ACCEPT, FOLD = 0.98, 10
#: Distinct strings counted in a task before they are passed on, and scores remembered in one.
_HELD = 400_000
_SPACE = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter or mark, or a space; and whether it is a letter."""
    table, real = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        c = chr(code)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
            real[code] = kind == "L"
    return table, real


def symbols(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, starts, letters): each text as 4 spaces, its letters with single spaces between, and a space.

    ``offsets`` are bytes; ``starts`` index the characters, the end last; ``letters``
    counts each text's letters, without marks.
    """
    table, real = _letters()
    raw = np.frombuffer(data, np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != before[-1]:  # bytes that aren't UTF-8: text by text
        parts = [np.frombuffer(data[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        before = np.cumsum([0, *map(len, parts)])
        points = np.concatenate(parts) if parts else points
    codes = table[points]
    space = codes == _SPACE
    stay = np.ones(len(codes), bool)
    stay[1:] = ~(space[1:] & space[:-1])
    starts = before[:-1][before[:-1] < len(codes)]
    stay[starts] = ~space[starts]  # none at a text's start
    kept = np.concatenate([[0], np.cumsum(stay)])[before]
    letters = np.diff(np.concatenate([[0], np.cumsum(real[points])])[before])
    sizes = np.diff(kept)
    out = np.full(int(sizes.sum()) + ORDER * len(sizes), _SPACE, np.uint32)
    begin = kept[:-1] + ORDER * np.arange(len(sizes))
    out[ranges(begin + ORDER - 1, sizes)] = codes[stay]
    return out, np.concatenate([begin, [len(out)]]), letters


def _keys(chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each place from ORDER - 1 on."""
    x = np.zeros(len(chars) - ORDER + 1, np.uint64)
    for k in range(n):
        x = x * _STEP + chars[ORDER - n + k : len(chars) - n + k + 1].astype(np.uint64) + np.uint64(1)
    return mixed(x)


def gram_key(gram: str) -> int:
    """The hash that ``_keys`` gives to a string."""
    return int(_keys(np.frombuffer(gram.rjust(ORDER).encode("utf-32-le"), np.uint32), len(gram))[0])


def gram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows: how often each string of ORDER characters occurs in a language's texts.

    Tasks add up what they read and pass on sums, which are added up by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts)), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "gram", "n"])
            held.clear()

        for rows, data, offsets in blocks(batches, "text"):
            chars, starts, _ = symbols(data.tobytes(), offsets)
            langs = rows.column(0).to_pylist()
            if len(chars) < ORDER:
                continue
            keys = _keys(chars, ORDER)
            windows = np.lib.stride_tricks.sliding_window_view(chars, ORDER)
            by_lang: dict[str, list[int]] = {}
            for k, name in enumerate(langs):
                by_lang.setdefault(name, []).append(k)
            for name, members in by_lang.items():
                m = np.array(members)
                at = ranges(starts[m], np.diff(starts)[m] - ORDER + 1)
                coded = pa.array(keys[at]).dictionary_encode()
                index = coded.indices.to_numpy()
                first = np.empty(len(coded.dictionary), np.int64)
                first[index[::-1]] = at[::-1]
                grams = np.ascontiguousarray(windows[first]).view(f"<U{ORDER}").ravel().tolist()
                counts = held.setdefault(name, {})
                for g, n in zip(grams, np.bincount(index).tolist(), strict=True):
                    counts[g] = counts.get(g, 0) + n
            if sum(map(len, held.values())) > _HELD:
                yield from flush()
        yield from flush()

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    # numpy drops what looks like padding from a string's end; spaces stay, and no letter is U+0000.
    return mapped(rows, run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def probabilities(top: DataFrame) -> list[DataFrame]:
    """For the orders 1 to ORDER: (lang, gram, n, p, weight) from the counts of the highest one.

    p is the interpolated probability of a string's last character after the others;
    weight is what the string, as a context, leaves to the next lower order (null if
    it is no context; n and p are null if it is only that).
    """
    tables = {ORDER: stored(top, "grams")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = stored(tables[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    seen = tables[1].groupBy("lang").agg(F.count("*").alias("kinds"))
    below = seen.select("lang", F.lit("").alias("gram"), (F.lit(1.0) / (F.col("kinds") + 1)).alias("p"))
    out: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        t = tables[k]
        cut = t.groupBy("lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("one"), F.count(F.when(F.col("n") == 2, 1)).alias("two"))
        discount = stored(cut.select("lang", F.when((F.col("one") > 0) & (F.col("two") > 0), F.col("one") / (F.col("one") + 2 * F.col("two"))).otherwise(F.lit(0.5)).alias("d")), "discounts")
        head, tail = F.substring("gram", 1, k - 1), F.substring("gram", 2, k - 1)
        context = stored(t.groupBy("lang", head.alias("head")).agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).join(discount, "lang").select("lang", "head", "all", "d", (F.col("d") * F.col("kinds") / F.col("all")).alias("weight")), "contexts")
        if out:
            # A text's beginning is a context without being any string's end, and so has no p.
            out[-1] = out[-1].join(context.select("lang", F.col("head").alias("gram"), "weight"), ["lang", "gram"], "full")
        named = t.withColumns({"head": head, "tail": tail}).join(context, ["lang", "head"])
        low = below.withColumnsRenamed({"gram": "tail", "p": "lower"})
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("all") + F.col("weight") * F.col("lower")
        mine = stored(named.join(low, ["lang", "tail"]).select("lang", "gram", "n", p.alias("p")), "probabilities")
        below = mine.select("lang", "gram", "p")
        out.append(mine)
    out[-1] = out[-1].withColumn("weight", F.lit(None).cast("double"))
    return out


class Model(NamedTuple):
    """Where the sorted arrays are: files[k, j] has one path for each range of 2 ** (64 - bits[k]) hashes of language j's strings of k characters."""

    name: str
    langs: tuple[str, ...]
    bits: tuple[int, ...]
    files: dict[tuple[int, int], list[str | None]]
    floor: np.ndarray


def train(docs: DataFrame, lang: str = "lang", text: str = "text", part: int = PART) -> Model:
    """A model of all languages named in ``docs``, every string of them; rows without a language take no part.

    The driver sees the languages' names and the files' (one for about ``part`` strings).
    """
    tables = probabilities(gram_counts(docs, lang, text))
    spark = docs.sparkSession
    kinds = {r["lang"]: r["count"] for r in tables[0].where("n IS NOT NULL").groupBy("lang").count().collect()}
    langs = tuple(sorted(kinds))
    bits, rows = [0], None
    for k, t in enumerate(tables, 1):
        hashed = stored(_hashed(t.where(F.col("lang").isin(*langs)), k, langs), "hashed")
        most = hashed.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
        bits.append(max(0, math.ceil(math.log2(most / part))))
        own = hashed.select(F.lit(k).alias("k"), "lang", (F.shiftrightunsigned("hash", 64 - bits[k]) if bits[k] else F.lit(0).cast("long")).alias("part"), "hash", "p", "weight")
        rows = rows.unionByName(own) if rows else own
    files: dict[tuple[int, int], list[str | None]] = {(k, j): [None] * (1 << bits[k]) for k in range(1, ORDER + 1) for j in range(len(langs))}
    for r in _model_files(rows, new_folder(spark, "model")).collect():
        files[r["k"], r["lang"]][r["part"]] = r["path"]
    return Model(uuid.uuid4().hex, langs, tuple(bits), files, -np.log(np.array([kinds[x] + 1.0 for x in langs])))


def _model_files(rows: DataFrame, folder: str) -> DataFrame:
    """(k, lang, part, path): the arrays of each order, language and range of hashes as a file, the hashes sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        made: list[tuple] = []

        def close() -> None:
            if not held:
                return
            whole = pa.Table.from_batches(held)
            order = np.argsort(whole["hash"].to_numpy().view(np.uint64))
            # Each attempt of a task has names of its own; only those of the one that counts are told.
            path = f"{folder}/{now[0]}-{now[1]}-{now[2]}-{task.taskAttemptId()}"
            with open_file(path, "wb") as f:
                for column, kind in (("hash", np.int64), ("p", np.float32), ("weight", np.float32)):
                    f.write(whole[column].to_numpy().astype(kind)[order].tobytes())
            made.append((*now, path))
            held.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            heads = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(heads, [*heads[1:], len(keys)], strict=True):
                if keys[a] != now:
                    close()
                    now = keys[a]
                held.append(batch.slice(a, b - a))
        close()
        cols = list(zip(*made, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["k", "lang", "part", "path"])

    sorted_ = rows.repartition("k", "lang", "part").sortWithinPartitions("k", "lang", "part")
    return stored(mapped(sorted_, run, "k int, lang int, part long, path string"), "model-files")


def _hashed(table: DataFrame, k: int, langs: tuple[str, ...]) -> DataFrame:
    """(lang: its place in ``langs``, hash, log p, log weight): strings become numbers."""
    place = {x: j for j, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(1).to_pylist()
            chars = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, k)
            hashes = np.zeros(len(grams), np.uint64)
            for j in range(k):
                hashes = hashes * _STEP + chars[:, j].astype(np.uint64) + np.uint64(1)
            logs = [np.log(b.column(c).cast(pa.float64()).fill_null(math.nan).to_numpy()).astype(np.float32) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([place[x] for x in b.column(0).to_pylist()], pa.int32()), pa.array(mixed(hashes).view(np.int64)), *map(pa.array, logs)], ["lang", "hash", "p", "weight"])

    return mapped(table.select("lang", "gram", "p", "weight"), run, "lang int, hash long, p float, weight float")


class _Parts:
    """A model's files as arrays (hashes, log p, log weight), the last used ones held up to ``HELD_BYTES``."""

    def __init__(self) -> None:
        self.held: OrderedDict[str, tuple[np.ndarray, ...]] = OrderedDict()
        self.size = 0

    def of(self, path: str) -> tuple[np.ndarray, ...]:
        if path in self.held:
            self.held.move_to_end(path)
            return self.held[path]
        with open_file(path, "rb") as f:
            raw = f.read()
        n = len(raw) // 16
        arrays = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.float32, n, 8 * n), np.frombuffer(raw, np.float32, n, 12 * n)
        self.held[path] = arrays
        self.size += len(raw)
        while self.size > HELD_BYTES and len(self.held) > 1:
            self.size -= 16 * len(self.held.popitem(last=False)[1][0])
        return arrays


_PARTS = _Parts()


def _found(model: Model, k: int, j: int, keys: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is there, its log p (1) or log weight (2)) of strings of k characters in language j."""
    there, out = np.zeros(len(keys), bool), np.zeros(len(keys))
    paths, bits = model.files[k, j], model.bits[k]
    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(parts, kind="stable") if bits else np.arange(len(keys))
    bounds = np.searchsorted(parts[order], np.arange(len(paths) + 1))
    for path, a, b in zip(paths, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if path is None or a == b:
            continue
        arrays, mine = _PARTS.of(path), order[a:b]
        at = np.minimum(np.searchsorted(arrays[0], keys[mine]), len(arrays[0]) - 1)
        values = arrays[column][at]
        # A string can be there as a context only, or as a text's end only.
        there[mine] = (arrays[0][at] == keys[mine]) & ~np.isnan(values)
        out[mine] = values
    return there, out


def log_probabilities(model: Model, chars: np.ndarray) -> np.ndarray:
    """(strings, languages): log p of the last of the ORDER characters in each row of ``chars``."""
    out = np.empty((len(chars), len(model.langs)))
    suffix, prefix = [], []
    for k in range(1, ORDER + 1):
        for into, low, high in ((suffix, ORDER - k, ORDER), (prefix, ORDER - k, ORDER - 1)):
            x = np.zeros(len(chars), np.uint64)
            for j in range(low, high):
                x = x * _STEP + chars[:, j].astype(np.uint64) + np.uint64(1)
            into.append(mixed(x))
    for j in range(len(model.langs)):
        value = np.full(len(chars), model.floor[j])
        for k in range(1, ORDER + 1):
            there, p = _found(model, k, j, suffix[k - 1], 1)
            if k > 1:
                context, weight = _found(model, k - 1, j, prefix[k - 1], 2)
                value = np.where(there, p, value + np.where(context, weight, 0.0))
            else:
                value = np.where(there, p, value)
        out[:, j] = value
    return out


class _Scorer:
    """Scores by string, remembered from block to block."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(model.langs)))

    def of(self, keys: np.ndarray, windows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Values for distinct ``keys``, whose strings are windows[first]."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            old = self.keys[at] == keys
        else:
            at, old = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        out = np.empty((len(keys), len(self.model.langs)))
        out[old] = self.values[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            out[new] = log_probabilities(self.model, windows[first[new]])
            if len(self.keys) + len(new) > _HELD:
                self.keys, self.values = keys[new], out[new]
            else:
                self.keys, self.values = np.concatenate([self.keys, keys[new]]), np.concatenate([self.values, out[new]])
            turn = np.argsort(self.keys)
            self.keys, self.values = self.keys[turn], self.values[turn]
        return out


_SCORERS: dict[str, _Scorer] = {}
#: Characters scored at once.
_PIECE = 1 << 20


def scored(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_letters and entropy (per character, for each of the model's languages; null without letters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared.value.name
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = _Scorer(shared.value)
        scorer, width = _SCORERS[key], len(shared.value.langs)
        for rows, data, offsets in blocks(batches, text):
            chars, starts, letters = symbols(data.tobytes(), offsets)
            total = np.zeros((len(letters), width))
            for low in range(0, len(chars) - ORDER + 1, _PIECE):
                part = chars[low : low + _PIECE + ORDER - 1]
                coded = pa.array(_keys(part, ORDER)).dictionary_encode()
                index = coded.indices.to_numpy()
                first = np.empty(len(coded.dictionary), np.int64)
                first[index[::-1]] = np.arange(len(index))[::-1]
                values = scorer.of(coded.dictionary.to_numpy(), np.lib.stride_tricks.sliding_window_view(part, ORDER), first)
                # Places at which a text's own windows begin, in this piece.
                a = np.clip(starts[:-1] - low, 0, len(index))
                b = np.clip(starts[1:] - ORDER + 1 - low, a, len(index))
                for j in range(width):
                    sums = np.concatenate([[0.0], np.cumsum(values[index, j])])
                    total[:, j] += sums[b] - sums[a]
            n = np.maximum(np.diff(starts) - ORDER + 1, 1)
            entropy = pa.FixedSizeListArray.from_arrays(pa.array((-total / n[:, None]).ravel()), width).cast(pa.list_(pa.float64())) if width else pa.array([[]] * len(n), pa.list_(pa.float64()))
            entropy = pc.if_else(pa.array(letters > 0), entropy, pa.scalar(None, entropy.type))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(letters.astype(np.int64)), entropy], [*rows.schema.names, prefix + "n_letters", prefix + "entropy"])

    return mapped(docs, run, StructType([*docs.schema]).add(prefix + "n_letters", LongType()).add(prefix + "entropy", ArrayType(DoubleType())))


def identified(docs: DataFrame, training: str, lang: str = "lang", text: str = "text", accept: float = ACCEPT, part: int = PART) -> DataFrame:
    """``docs`` less ``text`` and ``lang``, with lang_pred, score and accepted, which replace columns of these names.

    Learns from rows where the SQL condition ``training`` holds and the language isn't
    null. Texts that are null or have no letter, and all texts if nothing was learnt,
    are ``und`` with score 0, not accepted. The score is the best language's share
    among all, by their probabilities per character. Equal entropies go to the first
    name. Repeated rows each keep a row.

    Of the training texts one in ``FOLD``, chosen by a hash of the text so that copies stay
    together, isn't fitted: a language's threshold is the share ``accept`` of the n + 1
    entropies of its n texts there and infinity. So it accepts that share of unseen texts
    like them, and anything where the fold has too few of them to tell.
    """
    new = ("lang_pred", "score", "accepted")
    trains = F.expr(f"coalesce({training}, false)") & F.col(f"`{lang}`").isNotNull()
    fold = F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(FOLD)) == 0
    model = train(docs.where(trains & ~fold).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")), part=part)
    names = F.array(*[F.lit(x) for x in model.langs]).cast("array<string>")
    rest = [c for c in docs.columns if c not in (lang, text, *new)]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.when(trains & fold, F.col(f"`{lang}`").cast("string")).alias("__own"), F.col(f"`{text}`").alias("__text"))
    found = stored(scored(rows, model, "__text", "__").drop("__text"), "entropies")
    best = F.array_min("__entropy")
    own = F.get("__entropy", F.array_position(names, F.col("__own")).cast("int") - 1)
    seen = found.where("__own IS NOT NULL").select(F.col("__own").alias("lang"), own.alias("x")).where("x IS NOT NULL")
    endless = docs.sparkSession.createDataFrame([(x, math.inf) for x in model.langs], "lang string, x double")
    limits = seen.unionByName(endless).groupBy("lang").agg(F.percentile_approx("x", accept, 10_000).alias("limit")).collect()
    limit = F.coalesce(F.create_map(*[F.lit(x) for r in limits for x in (r["lang"], float(r["limit"]))])[F.col("lang_pred")], F.lit(-math.inf)) if limits else F.lit(-math.inf)
    some = F.col("__entropy").isNotNull() & (F.size("__entropy") > 0)
    share = F.lit(1.0) / F.aggregate("__entropy", F.lit(0.0), lambda a, x: a + F.exp(best - x))
    named = found.withColumn("lang_pred", F.when(some, F.get(names, F.array_position(F.col("__entropy"), best).cast("int") - 1)).otherwise("und"))
    return named.withColumns({"score": F.when(some, share).otherwise(F.lit(0.0)), "accepted": F.coalesce(some & (best <= limit), F.lit(False)).cast(BooleanType())}).select(*[F.col(f"`{c}`") for c in rest], *new)


def op5(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    return identified(held, "NOT held_out AND doc_id IS NOT NULL").select("doc_id", "held_out", "lang_pred", "score", "accepted")
