"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Encoding is row-local. A text longer than ``piece_chars`` is cut first, only in front of
a space between two letters: the pre-splitting expression never joins across that place
(a letter run ends there, and the space begins the next piece), so the ids of the parts
in a row are the ids of the whole. Decoding joins the raw bytes of the ids and needs no
valid UTF-8 in between; bytes that are no UTF-8 as a whole become U+FFFD in the text.

Defined results: a null text gives null ids and a null count; an empty text no ids and 0;
repeated rows and null ids of documents are encoded like any other; an empty table gives
an empty result; special tokens in a text are ordinary text; a very long text without a
safe place is encoded in one piece. Columns called like those that are made are replaced by
``encode`` and ``decode``; where the id column has such a name, ``round_trip``'s has an
underscore appended. The rank file must be where every executor can read it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free_names

#: The folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
RANKS = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
#: What the rank files were made with: splits a text before its bytes are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` cut at the first safe place after every ``size`` characters."""
    start, n = 0, len(text)
    while n - start > size:
        safe = _SAFE.search(text, start + size)
        if safe is None:
            break
        yield text[start : safe.start()]
        start = safe.start()
    yield text[start:]


def encode_text(text: str, path: str = RANKS, piece_chars: int = 1 << 15) -> list[int]:
    enc = encoding(path)
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, piece_chars) for i in enc.encode_ordinary(piece)]


def _encoded(texts: pa.Array, path: str, piece_chars: int) -> pa.ListArray:
    """Lists of ids; built from one flat buffer."""
    offsets, flat, total, missing = [0], [], 0, []
    for text in texts.to_pylist():
        missing.append(text is None)
        if text is not None:
            ids = np.asarray(encode_text(text, path, piece_chars), np.int32)
            flat.append(ids)
            total += len(ids)
        offsets.append(total)
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=pa.array(missing, pa.bool_()) if any(missing) else None
    )


def _small(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, to bound a worker's memory."""
    from tessera.llm.common import slices, text_buffer

    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        for lo, hi in slices(offsets, limit):
            yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens", ranks: str = RANKS, piece_chars: int = 1 << 15) -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>) and ``count_col``; columns of those names are replaced. Row-local; no shuffle."""
    kept = [c for c in docs.columns if c.lower() not in (ids_col.lower(), count_col.lower())]
    fields = [docs.schema[c] for c in kept]
    at = kept.index(text_col)
    schema = T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(count_col, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, at):
            ids = _encoded(batch.column(at), ranks, piece_chars)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, ids.value_lengths().cast(pa.int32())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def decode_bytes(ids: list[int], path: str = RANKS) -> bytes:
    return encoding(path).decode_bytes(ids)


def decode(rows: DataFrame, ids_col: str = "token_ids", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``rows`` with ``text_col`` from ``ids_col``: raw bytes joined, then read as UTF-8. Null ids give a null text; an unknown id is an error."""

    @F.arrow_udf(T.StringType())
    def run(lists: pa.Array) -> pa.Array:
        enc = encoding(ranks)
        return pa.array([None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return rows.withColumn(text_col, run(F.col(ids_col)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, piece_chars: int = 1 << 15) -> DataFrame:
    """id, n_tokens, token_ids, and whether the ids' raw bytes are exactly the text's (``exact``; null for a null text)."""
    schema = T.StructType([
        docs.schema[id_col], *(T.StructField(n, k) for n, k in zip(free_names(id_col, "n_tokens", "token_ids", "exact"), (T.IntegerType(), T.ArrayType(T.IntegerType()), T.BooleanType()), strict=True))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.common import text_buffer

        tokens = sorted(read_ranks(ranks).items(), key=lambda x: x[1])
        if [rank for _, rank in tokens] != list(range(len(tokens))):
            raise ValueError("ranks have gaps")
        lengths = np.array([len(token) for token, _ in tokens])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        table = np.frombuffer(b"".join(token for token, _ in tokens), np.uint8)
        for batch in _small(batches, 1):
            ids = _encoded(batch.column(1), ranks, piece_chars)
            raw, offsets = text_buffer(batch.column(1))
            flat = ids.values.to_numpy()
            size = lengths[flat]
            # raw-byte decoding of the whole batch: each id's bytes are gathered from the table of all tokens
            before = np.cumsum(size) - size
            decoded = table[np.repeat(starts[flat] - before, size) + np.arange(int(size.sum()))]
            ends = np.concatenate([[0], np.cumsum(size)])[ids.offsets.to_numpy()]
            if len(decoded) == len(raw) and np.array_equal(ends, offsets):
                wrong = np.add.reduceat(np.append(decoded != raw, False).astype(np.int64), offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
                exact = (wrong == 0) | (np.diff(offsets) == 0)
            else:
                exact = np.array([np.array_equal(decoded[a:b], raw[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids.value_lengths().cast(pa.int32()), ids, pa.array(exact, pa.bool_(), mask=~np.asarray(batch.column(1).is_valid()))], names=schema.names
            )

    return docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
