"""Token counts of whole texts: batches balanced by bytes, long texts cut where no token can span.

Only lengths leave the encoder. A text longer than ``PIECE`` bytes is cut before a
space between two ASCII letters or digits: pretokenisers of the supported kinds end a
word there and normalisers change nothing across it, so the counts add up. Where no
such place follows, the piece goes on. SentencePiece models add a mark to the front of
each piece, so their texts aren't cut.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .shared import mapped
from .textblocks import blocks

#: Bytes of a piece, and of the pieces that are encoded together.
PIECE, BATCH = 1 << 16, 1 << 18
_SAFE = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


@functools.cache
def encoder(vocabulary: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(numbers of tokens of some texts, whether texts can be cut) for a vocabulary file's name."""
    import public_tokenizers

    path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        bpe = Tokenizer.from_file(path)
        bpe.no_truncation()
        bpe.no_padding()
        return lambda texts: [len(e) for e in bpe.encode_batch_fast(texts, add_special_tokens=False)], True
    if path.endswith(".tiktoken"):
        import public_tokenizers as public
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranked = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(ranked.encode_ordinary(t)) for t in texts], True
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``text`` cut at safe places, each piece at least ``size`` bytes but the last."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def with_counts(docs: DataFrame, text: str = "text", vocabulary: str = "word_bpe_49k.json", prefix: str = "", piece: int = PIECE) -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens; a null text is empty. ``prefix`` keeps new names off those of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cuts = encoder(vocabulary)
        for rows, data, offsets in blocks(batches, text):
            raw, tokens = data.tobytes(), np.zeros(len(offsets) - 1, np.int64)
            owner: list[int] = []
            waiting: list[str] = []
            held = 0

            def flush() -> None:
                np.add.at(tokens, owner, count(waiting))  # noqa: B023
                owner.clear()  # noqa: B023
                waiting.clear()  # noqa: B023

            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if a == b:
                    continue
                for part in pieces(raw[a:b], piece) if cuts else (raw[a:b],):
                    owner.append(k)
                    waiting.append(part.decode("utf-8", "replace"))
                    held += len(part)
                    if held >= BATCH:
                        flush()
                        held = 0
            if waiting:
                flush()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(offsets)), pa.array(tokens)], [*rows.schema.names, prefix + "n_bytes", prefix + "n_tokens"])

    return mapped(docs, run, StructType([*docs.schema]).add(prefix + "n_bytes", LongType()).add(prefix + "n_tokens", LongType()))


def op4(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_counts(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
