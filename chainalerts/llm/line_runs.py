"""Line deduplication by levelled sorted runs of line hashes.

Documents come in batches. A batch's run holds, for every line key in it, the key's 128-bit hash
and the number of its documents, sorted by hash. Runs have levels: a new run is level 0; `fanout`
runs of a level are compacted into one of the next, by adding the numbers of equal hashes, so a
hash is rewritten only as often as there are levels (LSM tree). Compaction closes the keys that
have reached `min_docs` documents: they leave the runs for a table of their own. Each new batch is
anti-joined with the closed keys (and, by `fresh_lines`, with all runs) before it adds its own, so
what is known to be frequent is not counted again. `frequent` merges what is still open and gives
all keys of at least `min_docs` documents; `drop_lines` removes them from the documents.

A run is a Parquet table in the shared folder, range-partitioned and sorted by hash. Which runs
are live is in the store's list on the driver, one entry per run.

Scale: lines are distinct within a document and counted in the map task before the shuffle, so a
line that every document has arrives once per task. Only (document, line number, hash) is joined
with the frequent keys; texts move once, to meet the numbers of their lost lines.

Defined cases: null or empty text is one empty line; an empty key is never dropped; repeated rows
(equal id and text) are documents each and lose the same lines; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainalerts.llm.common import row_key, table, work_folder, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), _UPPER, _UPPER.lower())


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def key_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(h1, h2, n_docs) of the lines of a batch; empty keys are left out."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), line_key))
    rows = documents.select(F.explode(F.filter(keys, lambda k: k != "")).alias("key"))
    return rows.select(_hash(F.col("key")).alias("h")).select("h.*").groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"))


class LineRuns:
    """The store of runs. `fanout` runs of one level become one of the next; keys of `min_docs`
    documents are closed then."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        if fanout < 2 or min_docs < 1:
            raise ValueError("fanout is at least 2, min_docs at least 1")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []
        self.closed: list[str] = []

    def _write(self, run: DataFrame, name: str) -> str:
        path = work_folder(self.spark, name)
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _put(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*paths)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def runs(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def add(self, documents: DataFrame, text_col: str = "text") -> None:
        """Add a batch's run of the keys that are not closed, then compact full levels."""
        run = key_counts(documents, text_col)
        if self.closed:
            run = run.join(self._read(self.closed), ["h1", "h2"], "left_anti")
        self._put(self._write(run, "run-0"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = self._read([self._write(self._merged(self.levels[level]), f"merged-{level}")])
            self.levels[level] = []
            done = F.col("n_docs") >= self.min_docs
            self.closed.append(self._write(merged.filter(done), "closed"))
            self._put(self._write(merged.filter(~done), f"run-{level + 1}"), level + 1)
            level += 1

    def fresh_lines(self, documents: DataFrame, text_col: str = "text") -> DataFrame:
        """(h1, h2, n_docs) of the batch's keys that the store has not seen yet: for a feed that
        keeps the first of equal lines only."""
        batch, seen = key_counts(documents, text_col), self.runs() + self.closed
        return batch.join(self._read(seen), ["h1", "h2"], "left_anti") if seen else batch

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys found in at least min_docs documents of all batches."""
        open_ = self.runs()
        found = self._merged(open_).filter(F.col("n_docs") >= self.min_docs) if open_ else None
        if self.closed:
            closed = self._read(self.closed)
            found = closed if found is None else found.unionAll(closed)
        if found is None:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        # Written, so that a join with them has its own exchange, whose hot keys Spark can split.
        return written(found.select("h1", "h2"), "frequent")


def drop_lines(documents: DataFrame, frequent: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with `text_col` shortened, and n_lines, n_dropped (long), which replace
    columns of that name."""
    documents = documents.drop("n_lines", "n_dropped")
    row = [c.alias(name) for c, name in zip(row_key(id_col, text_col), ("__r1", "__r2"))]
    lines = documents.select(*row, F.posexplode(lines_of(F.col(text_col))).alias("__at", "__line"))
    lines = lines.select("__r1", "__r2", "__at", line_key(F.col("__line")).alias("__key")).filter(F.col("__key") != "")
    lines = lines.select("__r1", "__r2", "__at", _hash(F.col("__key")).alias("h")).select("__r1", "__r2", "__at", "h.*")
    # A frequent key's lines may be a third of all: the join's hot partitions are split by AQE.
    lost = lines.join(frequent, ["h1", "h2"], "left_semi")
    lost = lost.groupBy("__r1", "__r2").agg(F.collect_set("__at").alias("__lost"))
    rows = documents.select("*", *row).join(
        lost.withColumnsRenamed({"__r1": "__l1", "__r2": "__l2"}),
        (F.col("__r1") == F.col("__l1")) & (F.col("__r2") == F.col("__l2")), "left",
    ).drop("__r1", "__r2", "__l1", "__l2")
    return rows.mapInArrow(_shorten(text_col), T.StructType([
        *documents.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def _shorten(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            texts, n_lines, n_dropped = [], [], []
            column = batch.column(names.index(text_col))
            for text, lost in zip(column, batch.column(batch.num_columns - 1)):
                text, lost = text.as_py(), lost.as_py()
                n_lines.append(1 + (text or "").count("\n"))
                n_dropped.append(len(lost or ()))
                if lost:
                    gone = set(lost)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                texts.append(text)
            columns = [pa.array(texts, column.type) if n == text_col else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*names, "n_lines", "n_dropped"])

    return run


def line_dedup(
    documents: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2,
    text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """Feed the documents to a store in batches (by id hash) and drop the frequent lines."""
    store = LineRuns(documents.sparkSession, min_docs, fanout)
    for number in range(batches):
        mine = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(batches)) == number
        store.add(documents if batches == 1 else documents.filter(mine), text_col)
    return drop_lines(documents, store.frequent(), text_col, id_col)


def op2_line_runs(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup(documents, min_docs=10)
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM (SELECT k.*, f.key IS NOT NULL AS lost FROM k LEFT JOIN f ON k.key = f.key) GROUP BY doc_id"""
