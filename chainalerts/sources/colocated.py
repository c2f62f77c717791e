"""Operations and transactions landed alike, so that they are joined where they lie.

Both tables have one directory per block bucket, and in it one file per hash bucket of
(block_num, trx_in_block), sorted by these. A join on the two columns needs no exchange on either
side, and a block range prunes directories on both. The one shuffle is that of the landing.

    log = ColocatedLog(spark, path, buckets=512)
    log.land(ops, transactions)                 # whole directories; landing them again replaces them
    plan = log.alert_plan(first, last)

The number of buckets is the number of tasks that read; it is fixed by the first landing and kept
beside the tables. A bucket of a directory should be a file of 100 MB or more.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chainalerts import schemas
from chainalerts.plans.notifications import AlertPlan
from chainalerts.sources.op_log import BLOCK_BUCKET, in_directories, scan_ops, with_transactions
from chainalerts.sources.sinks import exists, write_text

KEY = "block_num, trx_in_block"
DIRECTORIES = "bucket_first INT, bucket_last INT"


@dataclass
class ColocatedLog:
    """The tables below ``path``; ``buckets`` and ``block_bucket`` count at the first landing only."""

    spark: SparkSession
    path: str
    buckets: int = 512
    block_bucket: int = BLOCK_BUCKET

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        kept = f"{self.path}/layout.json"
        if exists(self.spark, kept):
            layout = json.loads(self.spark.read.text(kept, wholetext=True).first()["value"])
            self.buckets, self.block_bucket = layout["buckets"], layout["block_bucket"]

    def land(self, ops: DataFrame, transactions: DataFrame) -> None:
        """Land whole block buckets. A directory that is landed again is replaced, others stay."""
        write_text(self.spark, f"{self.path}/layout.json", json.dumps(
            {"buckets": self.buckets, "block_bucket": self.block_bucket}))
        for kind, schema, rows in (
            ("ops", schemas.OPS, ops), ("transactions", schemas.TRANSACTIONS, transactions),
        ):
            name = self._table(kind, schema)
            columns = [field.split()[0] for field in f"{schema}, {DIRECTORIES}".split(", ")]
            # A task holds one hash bucket of all directories, so each bucket is one file.
            dealt = in_directories(rows, self.block_bucket).select(*columns).repartition(
                self.buckets, *KEY.split(", "))
            dealt.write.insertInto(name, overwrite=True)

    def ops(self) -> DataFrame:
        return self._read("ops", schemas.OPS)

    def transactions(self) -> DataFrame:
        return self._read("transactions", schemas.TRANSACTIONS)

    def joined(self, first: int, last: int) -> DataFrame:
        """Operations of ``first..last`` with the hashes of their transactions."""
        return with_transactions(*self._range(first, last))

    def alert_plan(self, first: int, last: int, **options) -> AlertPlan:
        """The plan of a block range, with hashes joined before anything is shuffled."""
        ops, transactions = self._range(first, last)
        return AlertPlan(ops, transactions=transactions, hashes_first=True, **options)

    def _range(self, first: int, last: int) -> tuple[DataFrame, DataFrame]:
        # Each side is pruned by its own directories, which are no part of the join.
        picked = [scan_ops(rows, first, last) for rows in (self.ops(), self.transactions())]
        return tuple(rows.drop("bucket_first", "bucket_last") for rows in picked)

    def _read(self, kind: str, schema: str) -> DataFrame:
        name = self._table(kind, schema)
        if exists(self.spark, f"{self.path}/{kind}"):  # directories that another session landed
            self.spark.catalog.recoverPartitions(name)
            self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _table(self, kind: str, schema: str) -> str:
        """The table's name in this session's catalog, which may not know it yet."""
        name = f"{kind}_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            place = f"{self.path}/{kind}".replace("'", "\\'")
            self.spark.sql(f"""CREATE TABLE {name} ({schema}, {DIRECTORIES}) USING parquet
                OPTIONS (compression 'zstd', partitionOverwriteMode 'dynamic') PARTITIONED BY (bucket_first, bucket_last)
                CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{place}'""")
        return name
