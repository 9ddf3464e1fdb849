"""Token counts: whole texts, encoded in batches that are balanced by bytes; only lengths leave the worker.

A long text is split at safe boundaries first: before a white-space character that stands alone between two characters
that aren't white space. The pre-tokeniser of a byte-level vocabulary always begins a token there, so the pieces' counts
add up to the text's count. A text without such a place stays whole. Added tokens hold no white space, so none is cut.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes
from graphloom.shipping import shipped

BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 14
#: A space or line feed between characters that aren't white space.
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")
_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a process and used without threads of its own."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded
    return _LOADED[path]


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut where a token begins in any case."""
    at = 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> list[int]:
    """The number of tokens of each text."""
    encode = tokenizer(path).encode_batch_fast
    counts = [0] * len(texts)
    pieces: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        for owner, encoded in zip(owners, encode(pieces, add_special_tokens=False), strict=True):
            counts[owner] += len(encoded)
        pieces.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for piece in safe_pieces(text, piece_chars) if len(text) > piece_chars else (text,):
            pieces.append(piece)
            owners.append(k)
            size += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes:
                flush()
                size = 0
    flush()
    return counts


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` (UTF-8) and ``n_tokens`` of the whole text.

    Null counts as empty, with 0 bytes and tokens. Repeated rows are counted one by one; null ids are kept. Nothing is cut
    off or padded, and special strings inside a text count as the library's default has it. ``vocabulary`` is a file for the
    tokenizers library, at the same path on every executor.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = pa.array(count_tokens(texts, path, batch_bytes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["__id", "n_bytes", "n_tokens"])

    return shipped(source).mapInArrow(count, f"__id {source.schema['__id'].dataType.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("__id", id_col)
