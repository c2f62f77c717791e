"""A streaming source whose offsets are block numbers.

    spark.dataSource.register(BlockSource)
    spark.readStream.format("blocks").option("path", landing).load()      # first INT, last INT
    spark.readStream.format("blocks").option("path", landing).option("rows", "operations").load()

A landing is a commit log: every commit adds the final operations of a block range and says up to
which block the chain is irreversible. The stream's latest offset is the last block that is landed
and irreversible; a batch's rows are the landed ranges between two offsets. A query that starts
again goes on by the block in its checkpoint, whatever the files' names and times are. The
operations themselves are read by Spark from the folders of a range; or, with rows "operations",
by the source, a task per file, with one more row of the type RANGE_MARK for each range (op_id:
its first block, block_num: its last).

The commit files are read by pyarrow's file systems (local, HDFS, object stores), as a source's
reader has no session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from chainalerts import schemas
from chainalerts.sources.commits import CommitLog, Entry, Snapshot, commit_name, replay
from chainalerts.sources.op_log import final_ops, scan_ops

RANGES = "first INT, last INT"
RANGE_MARK = -1
LANDING = "landing"
_OPS = [name.split()[0] for name in schemas.OPS.split(", ")]


def publish_range(
    ops: DataFrame, landing: str, first: int, last: int, irreversible_block: int
) -> int:
    """Land the final blocks of ``first..last``; gives the last block that is published.

    The operations may lie in any number of files; they and the range become visible together.
    Ranges are landed in order: one that was landed before is passed over.
    """
    last = min(last, irreversible_block)
    if last < first:
        return first - 1
    log = CommitLog(ops.sparkSession, landing)
    done = log.snapshot().last(LANDING)
    if done is None or done["number"] < last:
        rows = final_ops(scan_ops(ops, first, last), irreversible_block).select(*_OPS)
        # Counted by the tasks that write the files, so nothing is read for it.
        seen = Observation()
        rows = rows.sortWithinPartitions("op_type_id", "block_num", "op_id").observe(
            seen, F.count("*").alias("rows"), F.max("op_id").alias("head_op"),
            F.max_by("ts", F.struct("block_num", "op_id")).cast("string").alias("head_time"))
        added = [replace(e, **seen.get) for e in log.write("ops", rows, blocks=(first, last))]
        log.commit(LANDING, last, added, facts={"irreversible": irreversible_block})
    return last


def landed_ops(spark: SparkSession, landing: str, first: int, last: int) -> DataFrame:
    """The landed operations of a block range; folders of other blocks are not listed."""
    return scan_ops(CommitLog(spark, landing).read("ops", schemas.OPS, blocks=(first, last)), first, last)


def landed_heads(spark: SparkSession, landing: str, first: int, last: int) -> dict | None:
    """Number (``ops``), greatest id (``head_op``) and last time (``time``) of the operations of
    ``first..last``, as observed when they were landed. No operation is read.

    None if these blocks are no whole number of landed ranges.
    """
    held = CommitLog(spark, landing).snapshot().of("ops")
    inside = sorted((e for e in held if first <= e.first and e.last <= last), key=lambda e: e.first)
    ends = [first - 1] + [e.last for e in inside]
    whole = [e.first for e in inside] == [end + 1 for end in ends[:-1]] and ends[-1] == last
    if not whole or any(e.rows is None for e in inside):
        return None
    times = [e.head_time for e in inside if e.head_time is not None]
    heads = [e.head_op for e in inside if e.head_op is not None]
    return {"ops": sum(e.rows for e in inside), "head_op": max(heads, default=None),
            "time": times[-1] if times else None}


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BlockReader(DataSourceStreamReader):
    def __init__(self, path: str, first: int | None):
        self.path, self.first = path, first

    def _located(self) -> tuple[fs.FileSystem, str]:
        system, place = fs.FileSystem.from_uri(self.path)
        return system, place.rstrip("/")

    def _snapshot(self) -> Snapshot:
        system, place = self._located()
        folder = f"{place}/_commits"

        def load(name: str) -> dict:
            with system.open_input_stream(f"{folder}/{name}") as stream:
                return json.loads(stream.read())

        def there(version: int) -> bool:
            return system.get_file_info(f"{folder}/{commit_name(version)}").type == fs.FileType.File

        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return replay([f.base_name for f in found if f.base_name.endswith(".full")], there, load)

    def _landed(self) -> list[Entry]:
        return sorted(self._snapshot().of("ops"), key=lambda e: e.first)

    def initialOffset(self) -> dict:
        """The block before the first one to read: `first`, else the first that is landed."""
        if self.first is not None:
            return {"block": self.first - 1}
        landed = self._landed()
        return {"block": landed[0].first - 1 if landed else -1}

    def latestOffset(self) -> dict:
        """The last irreversible block that is landed."""
        last = self._snapshot().last(LANDING)
        return {"block": min(last["number"], last["irreversible"])} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        after, to = start["block"], end["block"]
        return [
            _Range(max(e.first, after + 1), min(e.last, to)) for e in self._landed()
            if e.last > after and e.first <= to]

    def read(self, partition: _Range) -> Iterator[tuple[int, int]]:
        yield partition.first, partition.last


class _File(_Range):
    def __init__(self, path: str, first: int, last: int):
        super().__init__(first, last)
        self.path = path


class OperationReader(BlockReader):
    """The landed operations of a batch's ranges, and a mark for each of these."""

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        system, place = self._located()
        ranges = super().partitions(start, end)
        parts = list(ranges)
        for e in self._landed():
            for r in ranges:
                if e.first <= r.first and r.last <= e.last:
                    listed = system.get_file_info(fs.FileSelector(f"{place}/{e.path}"))
                    parts += [_File(f.path, r.first, r.last) for f in listed if f.path.endswith(".parquet")]
        return parts

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):
            yield pa.RecordBatch.from_arrays([
                pa.array([partition.first], pa.int64()), pa.array([RANGE_MARK], pa.int16()),
                pa.array([partition.last], pa.int32()), pa.array([None], pa.timestamp("us")),
                pa.array([None], pa.int32()), pa.array([None], pa.string())], _OPS)
            return
        system, _ = self._located()
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=_OPS):
                block = batch.column("block_num")
                yield batch.select(_OPS).filter(pc.and_(
                    pc.greater_equal(block, partition.first), pc.less_equal(block, partition.last)))


class BlockSource(DataSource):
    """Options: path (a landing), first (the block to begin with), rows (ranges or operations)."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def _operations(self) -> bool:
        return self.options.get("rows", "ranges") == "operations"

    def schema(self) -> str:
        return schemas.OPS if self._operations() else RANGES

    def streamReader(self, schema: StructType) -> BlockReader:
        first, reader = self.options.get("first"), OperationReader if self._operations() else BlockReader
        return reader(self.options["path"], None if first is None else int(first))
