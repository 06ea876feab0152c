"""Problem 6: encoding of the whole corpus with a public byte-level tokenizer.

Documents are encoded where they are read: there is no shuffle. The ids of
words are kept in a bounded cache of each Python worker, and words new to it
are encoded side by side by segment trees (``bpe``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm.bpe import Encoder, read_ranks

#: Where the rank file of byte_bpe_50k lies; a parameter of every operator here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters that are encoded at once in a worker.
CHUNK = 2_000_000

_encoders: dict[str, Encoder] = {}


def encoder(path: str = RANKS) -> Encoder:
    """The encoder of a rank file, built once for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of at most ``limit`` characters, a longer text alone; null is read as empty text."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield start, part


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """(key, ids array<int>) of each document, without special tokens.

    Empty and null texts give an empty list. Texts of special tokens are
    ordinary text. Other columns of the input are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            keys = batch.column(0)
            for start, part in chunks(batch.column(1).to_pylist()):
                ids, offsets = code.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(start, len(part)), lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """(key, n_tokens bigint) of each document; 0 for empty and null texts. The ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for start, part in chunks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(code.lengths(part), pa.int64())], names=[key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
