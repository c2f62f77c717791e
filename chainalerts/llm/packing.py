"""Packing by power-of-two decomposition.

A document of n token ids (its end id included) is cut into full sequences of `length` and, of
what remains, one piece for each binary digit, longest first. Each piece is a sequence of its
own whose length is a power of two: pieces of equal length form a bucket and batch without
padding, and no sequence crosses documents.

Ids are those of the named `tokenizers` file. Its vocabulary also exists as ranks, for a library
that encodes several times as fast; the two agree on text below U+0280 (whose letters all Unicode
versions class alike) without special tokens or very long white space, and such texts take the
fast way. All others are encoded by `tokenizers` itself.

Nothing is shuffled. Sequence ids are unique: the task's number in the upper bits, the row's in
the lower; run again on the same files they are the same. `write_buckets` puts each length into a
folder. Defined cases: null or empty text is the end id alone; repeated rows are packed each; an
empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import chunks, table, text_bytes

# Bytes that begin a character from U+0280 on, and those of white space (with bytes that occur in
# longer ones): more than GAP of the latter in a row are left to `tokenizers`.
_OTHER, _BLANK, GAP = 0xCA, np.zeros(256, bool), 200
_BLANK[[*range(0x21), 0x85, 0xA0, 0xC2]] = True


class Encoder:
    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, raw: np.ndarray, text: str) -> bool:
        if not self.fast or len(raw) and raw.max() >= _OTHER or any(t in text for t in self.special):
            return False
        solid = np.flatnonzero(~_BLANK[raw])
        return len(raw) <= GAP or len(solid) > 0 and int(np.diff(solid, prepend=-1, append=len(raw)).max()) <= GAP

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        data, ends = text_bytes(column)
        result: list = [None] * len(column)
        slow = []
        for row, text in enumerate(column.to_pylist()):
            text = text or ""
            if self._plain(data[ends[row]:ends[row + 1]], text):
                result[row] = np.array(self.fast.encode_ordinary(text), np.uint32)
            else:
                slow.append((row, text))
        if slow:
            found = self.tokenizer.encode_batch_fast([t for _, t in slow], add_special_tokens=False)
            for (row, _), ids in zip(slow, found):
                result[row] = np.array(ids.ids, np.uint32)
        return result


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, then binary digits."""
    found = [(i * length, length) for i in range(n // length)]
    start, size = n // length * length, length >> 1
    while start < n:
        if n - start >= size:
            found.append((start, size))
            start += size
        size >>= 1
    return found


def pack(
    documents: DataFrame, tokenizer_path: str, ranks_path: str | None = None, length: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id
    and offset of each piece. `length` is a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError("length is a power of two")
    source = documents.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([
        source.schema["__id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path, ranks_path)
        for batch in batches:
            for part in chunks(batch, "__text"):
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for row, found in enumerate(encoder.encode(part.column("__text"))):
                    raw = np.append(found, np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    for start, size in pieces_of(n, length):
                        rows.append(row)
                        starts.append(start)
                        lengths.append(size)
                        ids.append(raw[4 * start:4 * (start + size)])
                        totals.append(n)
                yield pa.RecordBatch.from_arrays([
                    part.column("__id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64()),
                ], ["__id", "start", "length", "ids", "doc_tokens"])

    return source.mapInArrow(cut, schema).withColumnRenamed("__id", id_col).withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences in a folder for each length; each task writes to its own files."""
    pieces.write.partitionBy("length").parquet(path)


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_binary_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), *tokenizer_files()))
