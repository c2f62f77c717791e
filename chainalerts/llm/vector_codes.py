"""Vector compression to one code byte a part, with distances read from value dictionaries.

A vector's components become integers floor(scale * x); vectors are cut into equal consecutive
parts, and each part position has a codebook of at most `entries` entries. Nearest entries are
found without any multiplication by row: rows are stored once in blocks, each with a dictionary of
the distinct integers of every dimension and the rows' codes into it. For a codebook, the squared
differences of every distinct integer to all entries are tabulated per dimension; the distance of
a part is then the sum, over its dimensions, of table rows gathered by code.

Codebooks start as the parts of the vectors with the smallest ids. A round assigns every part to
its nearest entry (ties: lower index) and replaces each entry by the componentwise floor of the
mean of its parts; unused entries stay.

Scale: a block holds at most BLOCK_VALUES components (or one vector), whatever the size of the
table. A round reads the blocks once, in map tasks; a task sends one row per used entry and
dimension, so what is shuffled and gathered does not depend on the number of vectors. The codebook
(entries x dimension integers) is all that travels to the tasks. Blocks are written to the shared
folder and read again by each round; sums are integers, so a task that runs again, or in another
order, gives the same. Equal vectors need no care: nothing is grouped by vector. Errors of labels
are summed in the tasks first and joined back as a table, whose hot keys Spark can split.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped; so
are rows whose vector has another length than that of the smallest kept id (ties: the smaller
vector), or that hold an integer beyond +-LARGEST, whose squares might not fit. A length that is
no multiple of the parts gives parts that differ by one component, the longer ones first; empty
vectors have codes of zeros. Rows with a null id are coded, but start no entry while others do.
Repeated rows count each. With fewer rows than entries there are as many entries as rows. A sum of
errors that does not fit a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_VALUES = 1 << 18  # components of a block: its codes and one gathered part are in memory
LARGEST = 1 << 24


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label columns as they are, ints) of the rows with a whole and finite vector."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < float(LARGEST)))
    # Null where the test fails, so that nothing else is cast.
    ints = F.when(x.isNotNull() & whole, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))
    return vectors.withColumn("__ints", ints).filter(F.col("__ints").isNotNull()).withColumn("__id", F.col(id_col))


def part_ends(length: int, parts: int) -> np.ndarray:
    """The parts + 1 boundaries of the parts of a vector."""
    return np.concatenate([[0], np.cumsum([length // parts + (k < length % parts) for k in range(parts)])])


def _blocks_schema(id_type: T.DataType, label_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.LongType())),
        T.StructField("codes", T.BinaryType()),
    ])


def _encode(length: int):
    """Rows to blocks: per dimension the sorted distinct integers, and each row's place in them."""
    step = max(1, BLOCK_VALUES // max(1, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                ids, labels, ints = (rows.column(i) for i in range(3))
                n = rows.num_rows
                ints = ints.flatten().to_numpy(zero_copy_only=False).reshape(n, length)
                sizes, values, codes = [], [], np.empty((length, n), np.dtype("<u4"))
                for d in range(length):
                    known, codes[d] = np.unique(ints[:, d], return_inverse=True)
                    sizes.append(len(known))
                    values.append(known)
                values = np.concatenate(values) if values else np.zeros(0, np.int64)
                one = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64())),
                    pa.array([codes.tobytes()], pa.binary()),
                ], ["ids", "labels", "sizes", "values", "codes"])

    return run


def _block(row: dict, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's dictionaries by dimension, and its codes (dimension x rows)."""
    values = np.asarray(row["values"], np.int64)
    dictionaries = np.split(values, np.cumsum(row["sizes"])[:-1]) if length else []
    return dictionaries, np.frombuffer(row["codes"], np.dtype("<u4")).reshape(length, len(row["ids"]))


def nearest(dictionaries, codes, codebook: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part (parts x rows); codebook: entries x dimensions."""
    parts, n = len(ends) - 1, codes.shape[1]
    best, error = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for part in range(parts):
        total = np.zeros((n, len(codebook)), np.int64)
        for d in range(ends[part], ends[part + 1]):
            difference = dictionaries[d][:, None] - codebook[None, :, d]
            total += np.take(difference * difference, codes[d], axis=0)
        best[part] = total.argmin(1)  # the first of equal ones
        error[part] = np.take_along_axis(total, best[part][:, None], 1)[:, 0]
    return best, error


def _sums(codebook: np.ndarray, ends: np.ndarray):
    """Blocks to (part, entry, at, n, total): one row per used entry and component of a task."""
    parts, entries = len(ends) - 1, len(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((codebook.shape[1], entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                dictionaries, codes = _block(row, codebook.shape[1])
                best, _ = nearest(dictionaries, codes, codebook, ends)
                for part in range(parts):
                    count[part] += np.bincount(best[part], minlength=entries)
                    order = np.argsort(best[part], kind="stable")
                    first = np.flatnonzero(np.diff(best[part][order], prepend=-1))
                    used = best[part][order][first]
                    for d in range(ends[part], ends[part + 1]):
                        total[d][used] += np.add.reduceat(dictionaries[d][codes[d][order]], first)
        part = np.repeat(np.arange(parts), np.diff(ends))  # of each dimension
        dims, used = np.nonzero(count[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (dims, used, count[part[dims], used], total[dims, used])],
            ["at", "entry", "n", "total"])

    return run


def _coded(codebook: np.ndarray, ends: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                dictionaries, codes = _block(row, codebook.shape[1])
                best, error = nearest(dictionaries, codes, codebook, ends)
                hexes = [x.tobytes().hex() for x in best.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten(),
                    pa.array(hexes, pa.string()), pa.array(error.sum(0), pa.int64())], names)

    return run


class VectorCodes:
    """Codebooks of a table of vectors, and its codes. `entries` is at most 256."""

    def __init__(
        self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
        parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE,
    ):
        if not 1 <= entries <= 256 or parts < 1:
            raise ValueError("1 to 256 entries and at least one part")
        self.names = id_col, label_col
        rows = quantised(vectors.select(id_col, vector_col, label_col), id_col, vector_col, scale)
        ordered = rows.orderBy(F.col("__id").asc_nulls_last(), F.col("__ints"))
        first = ordered.select(F.size("__ints").alias("n")).first()
        self.length = first["n"] if first else 0
        rows = rows.filter(F.size("__ints") == self.length)
        start = rows.orderBy(F.col("__id").asc_nulls_last(), F.col("__ints")).limit(entries)
        start = [r["__ints"] for r in start.select("__ints", "__id").collect()]  # at most `entries` rows
        self.codebook = np.array(start, np.int64).reshape(len(start), self.length)
        self.ends = part_ends(self.length, parts)
        fields = rows.select(id_col, label_col).schema.fields
        self.types = [f.dataType for f in fields]
        blocks = rows.select(id_col, label_col, "__ints").mapInArrow(_encode(self.length), _blocks_schema(*self.types))
        self.blocks = written(blocks, "vector-blocks")

    def round(self) -> None:
        """Assign every part, then move each used entry to the floor of its parts' mean."""
        sums = self.blocks.mapInArrow(_sums(self.codebook, self.ends), "at long, entry long, n long, total long")
        sums = sums.groupBy("at", "entry").agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        moved = self.codebook.copy()
        for row in sums.collect():  # at most entries x dimensions
            moved[row["entry"], row["at"]] = int(row["total"]) // int(row["n"])
        self.codebook = moved

    def codes(self) -> DataFrame:
        """(id, label, code, error) of every kept row, by the codebook as it is now."""
        kept = T.StructType([
            T.StructField(self.names[0], self.types[0]), T.StructField(self.names[1], self.types[1]),
            T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return self.blocks.mapInArrow(_coded(self.codebook, self.ends, kept.names), kept)

    def sha256(self) -> str:
        """Of all entries' components in order of part, entry and place, joined by commas."""
        numbers = [
            str(int(x)) for a, b in zip(self.ends[:-1], self.ends[1:]) for x in self.codebook[:, a:b].ravel()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def with_label_errors(coded: DataFrame, label_col: str) -> DataFrame:
    """Add label_error, the sum of `error` over equal labels (null ones together)."""
    coded = written(coded, "vector-codes")
    sums = coded.groupBy(F.col(label_col).alias("__label")).agg(F.try_sum("error").alias("label_error"))
    sums = written(sums, "vector-labels")
    return coded.join(sums.hint("merge"), F.col(label_col).eqNullSafe(F.col("__label")), "left").drop("__label")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    model = VectorCodes(table(spark, sf_dir, "embeddings"))
    for _ in range(ROUNDS):
        model.round()
    rows = with_label_errors(model.codes(), "label")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL with one common table per step: parts, then assignment and codebook by turns."""
    steps = []
    for turn in range(ROUNDS + 1):
        steps.append(f"""
d{turn} AS (
  SELECT r, p, e, sum((x.v - c.v) * (x.v - c.v)) AS dist FROM x JOIN c{turn} c USING (p, j) GROUP BY ALL),
a{turn} AS (SELECT r, p, arg_min(e, dist * 1000 + e) AS e, min(dist) AS dist FROM d{turn} GROUP BY ALL)""")
        if turn < ROUNDS:
            steps.append(f"""
c{turn + 1} AS (
  SELECT c.p, c.e, c.j, coalesce(m.v, c.v) AS v FROM c{turn} c LEFT JOIN (
    SELECT p, e, j, floor(sum(v) / count(*))::BIGINT AS v FROM x JOIN a{turn} USING (r, p) GROUP BY ALL) m USING (p, e, j))""")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
u AS (
  SELECT r, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS w FROM k),
x AS (SELECT r, i // w AS p, i % w AS j, floor({SCALE} * f::DOUBLE)::BIGINT AS v FROM u),
c0 AS (SELECT p, r - 1 AS e, j, v FROM x WHERE r <= {ENTRIES}),{','.join(steps)},
z AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM c{ROUNDS}) AS codebooks_sha256
FROM z JOIN k USING (r)"""


ORACLE = _oracle()
