"""What the operators share: byte views of Arrow text, word and shingle hashes, work folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 4 << 20  # text that a task holds as arrays at a time; one longer document is alone

# A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
LONG_SPAN = 64  # bytes; longer spans are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first, last = int(ends[0]), int(ends[-1])
    return np.frombuffer(data, np.uint8)[first:last], ends - first


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most limit text bytes, or one row."""
    if not batch.num_rows:
        return
    _, ends = text_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(data: np.ndarray, ends: np.ndarray, inside: np.ndarray):
    """Starts and ends of the maximal runs of bytes that `inside` marks, cut at rows, and the
    number of runs before each row (n + 1)."""
    mask = inside[data]
    before, after = np.empty_like(mask), np.empty_like(mask)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(ends), np.int64)
    before[0], before[1:] = False, mask[:-1]
    after[-1], after[:-1] = False, mask[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(mask & ~before)
    stops = np.flatnonzero(mask & ~after) + 1
    return starts, stops, np.searchsorted(starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time, each mixed into what the earlier ones
    gave. A step is a bijection, so spans of up to eight bytes and equal length never meet, and no
    sum or product of bytes makes longer ones meet. The few long spans go one by one."""
    size = stops - starts
    result = mix(size.astype(np.uint64) + _BASE)
    short = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))  # from every byte on
    at, left, value = starts[short], size[short], result[short]
    while len(short):
        last = left < 8
        taken = eight[at]
        taken[last] &= (np.uint64(1) << (left[last] * 8).astype(np.uint64)) - np.uint64(1)
        value = mix((value ^ taken) * _BASE)
        result[short] = value
        more = left > 8
        short, at, left, value = short[more], at[more] + 8, left[more] - 8, value[more]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        result[i] = xxhash.xxh3_64_intdigest(data[starts[i]:stops[i]].tobytes(), LONG_SPAN)
    return result


def shingles(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every `size` consecutive words of each row (the whole row where it has fewer
    words, none without words), and the number of shingles before each row."""
    count = np.diff(firsts)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    rows = np.repeat(np.arange(len(count)), n)
    at = firsts[:-1][rows] + np.arange(out[-1]) - out[:-1][rows]
    width = np.minimum(count, size)[rows]
    result = mix(width.astype(np.uint64) + np.uint64(1))
    for i in range(size):
        more = width > i
        taken = mix(result[more] * _BASE + words[at[more] + i])
        result[more] = taken
    return result, out


def row_key(*columns: Column | str, of: DataFrame | None = None) -> tuple[Column, Column]:
    """128 bits that name a row by these columns. Hashes of Spark pass over nulls, so each column
    goes with a mark of being null. Columns of `of` that are no plain values (maps are not
    hashable, and nulls within arrays would be passed over) go as JSON."""
    parts: list[Column] = []
    for column in columns:
        value = F.col(column) if isinstance(column, str) else column
        if of is not None and isinstance(column, str):
            kind = of.schema[column].dataType
            if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
                value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        parts += [value.isNull(), value]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fenced(df: DataFrame, **columns) -> DataFrame:
    """Add columns that the optimizer won't copy into the expressions which use them: a
    generator stands between, so that each is computed once a row."""
    struct = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(struct)))
