"""Text columns as bounded blocks of bytes for vectorised work in Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; what numpy holds beside it is a small multiple of this.
BLOCK_BYTES = 1 << 20


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows cut into slices of about ``limit`` bytes of ``text``; a longer text is a slice of its own.

    Yields (rows, bytes, offsets): the UTF-8 bytes of the slice's texts joined, and
    where each begins, with the end last. Nulls are empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``blocks`` of about ``limit`` bytes where single batches are smaller."""

    def joined() -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return blocks(joined(), text, limit)


#: 1 for the bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = _WORD[0x41:0x5B] = True
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


#: 1 for all bytes but ASCII white space.
INK = np.ones(256, bool)
INK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each text's first word, the number of words last.

    A word is a run of bytes marked in ``word`` (0-9, a-z, A-Z and bytes from 0x80); texts end words.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # texts that meet inside a run
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK_BYTES * 2), base, np.uint64)
        x[0] = 1
        have = _POWERS[base] = np.cumprod(x)
    return have[:n]


class SpanHash:
    """Polynomial hashes modulo 2**64 of any spans of a byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * _powers(_BASE, len(data)), out=self.sums[1:])
        self.back = _powers(_BACK, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word (the finaliser of a 64-bit hash)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of the lengths, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    ends = np.cumsum(lengths)
    keep = lengths > 0
    starts, lengths, ends = starts[keep], lengths[keep], ends[keep]
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
