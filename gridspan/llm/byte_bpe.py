"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary comes from a rank file; the BPE model of the ``tokenizers`` library works on the
byte-to-character alphabet. Decoding reverses the byte table; a character whose bytes lie in several
tokens is put together again before it becomes text. Both directions are narrow: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import byte_bpe

#: Bytes of ids and texts in an output batch.
OUT_BYTES = 16 << 20


def character_offsets(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token, from the tokens' byte lengths.

    A token that holds part of a character counts that character as its own.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return character[starts].astype(np.int32), character[ends - 1].astype(np.int32) + 1


def token_texts(tokens: list[bytes]) -> list[str]:
    """The text of each token; bytes of a character that is not complete wait for the token that completes it."""
    out, held = [], b""
    for token in tokens:
        held += token
        whole = len(held)
        for back in range(1, min(4, len(held)) + 1):
            lead = held[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if lead >> 5 == 0b110 else 3 if lead >> 4 == 0b1110 else 4 if lead >> 3 == 0b11110 else 1
                whole -= back if need > back else 0
                break
        out.append(held[:whole].decode("utf-8", "replace"))
        held = held[whole:]
    if held and out:
        out[-1] += held.decode("utf-8", "replace")
    return out


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row, weight in rows:
        out.append(row)
        size += weight
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers); with ``offsets`` also token_start and token_end in characters.

    Null text is empty text: no ids. Null ids and repeated rows are kept; other columns, whatever their names, are not carried
    along; an empty table gives no rows. Texts of any length are encoded whole, one at a time.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    if offsets:
        fields += [("token_start", pa.list_(pa.int32())), ("token_end", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        lengths = np.array([len(t) for t in bpe.table], np.int64)

        def rows():
            for batch in batches:
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = value.as_py()
                    ids = bpe.encode(text)
                    row = (doc_id, len(ids) // 4, ids)
                    if offsets:
                        row += tuple(x.tolist() for x in character_offsets(text.encode(), lengths[np.frombuffer(ids, "<u4")])) if ids else ([], [])
                    yield row, len(ids) * (3 if offsets else 1) + 64

        yield from _batches(rows(), schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(encode, "doc_id long, n_tokens long, ids binary" + (", token_start array<int>, token_end array<int>" if offsets else ""))


def decode_documents(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, pieces: bool = False) -> DataFrame:
    """doc_id, ids and the decoded bytes; with ``pieces`` also the text of each token.

    Null or empty ids decode to no bytes. A null doc_id and repeated rows are kept; other columns, whatever their names, are not
    carried along; an empty table gives no rows. Ids of any number are decoded whole; an id outside of the table is an error.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    fields = [("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())] + ([("pieces", pa.list_(pa.string()))] if pieces else [])
    schema = pa.schema(fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)

        def rows():
            for batch in batches:
                for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = value.as_py() or b""
                    numbers = np.frombuffer(ids, "<u4").tolist()
                    decoded = bpe.decode(numbers)
                    row = (doc_id, ids, decoded)
                    if pieces:
                        row += (token_texts([bpe.table[i] for i in numbers]),)
                    yield row, len(ids) + 2 * len(decoded) + 64

        yield from _batches(rows(), schema)

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, "doc_id long, ids binary, decoded binary" + (", pieces array<string>" if pieces else ""))
