"""Following the log: micro-batches of final block ranges around the batch plan.

The source's offsets are block numbers (``chainalerts.sources.block_source``). Each range, or a few
of them, is one commit of the alert store below ``out``: rows, rejects, state and progress become
visible together, so a replay changes nothing. Ranges have to follow each other without a gap. Days older than the retention leave with every batch; staged frames go when a batch
is done, superseded state when it is compacted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chainalerts.constants import RETENTION_DAYS
from chainalerts.operators.hooks import Catalog
from chainalerts.plans.jobs import preload_state
from chainalerts.plans.notifications import AlertPlan
from chainalerts.plans.status import system_status
from chainalerts.plans.store import SECONDS_OF_GRACE, AlertStore, follows
from chainalerts.sources.block_source import BlockSource, landed_heads, landed_ops, publish_range
from chainalerts.sources.op_log import scan_ops

@dataclass
class AlertStream:
    """Follows ``landing`` (see ``publish_range``) into the store ``out``."""

    landing: str
    out: str
    checkpoint: str
    catalog: Catalog = field(default_factory=Catalog.default)
    transactions: DataFrame | None = None
    initial_state: DataFrame | None = None
    semantics: str = "reference"
    ranges_per_batch: int = 1
    compact_every: int = 20
    sync_enabled: bool = True
    preload: bool = False
    retention_days: int = RETENTION_DAYS
    grace_seconds: float = SECONDS_OF_GRACE

    def store(self, spark: SparkSession) -> AlertStore:
        return AlertStore(spark, self.out, self.compact_every, self.retention_days, self.grace_seconds)

    def prepare(self, ops: DataFrame, first: int, last: int) -> None:
        """Preload the account state of ``first..last``; the stream then begins after it."""
        heads = scan_ops(ops, first, last).agg(
            F.max_by("ts", F.struct("block_num", "op_id")).alias("time"), F.count("*").alias("ops")).first()
        self.store(ops.sparkSession).open_with(
            preload_state(ops, self.catalog, first, last), (first, last), heads["time"], heads["ops"])

    def status(self, spark: SparkSession, as_of: str, wanted: tuple[int, int]) -> DataFrame:
        """System status of a stream that has to preload ``wanted`` first."""
        done = self.store(spark).opened()
        processed = spark.createDataFrame(
            [] if done is None else [(done["number"], done["ops"], done["block_time"])],
            "block_num INT, op_id BIGINT, ts STRING",
        ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        return system_status(processed, as_of, wanted, self.sync_enabled)

    def start(self, spark: SparkSession, every: str | None = None) -> StreamingQuery | None:
        """Start following; without ``every`` it stops when it has caught up.

        Resumes after the last completed batch. Does not start while the gate is shut: if
        syncing is off, or if the state it needs has not been preloaded.
        """
        loaded = not self.preload or self.store(spark).opened() is not None
        if not (loaded and self.sync_enabled):
            return None
        spark.dataSource.register(BlockSource)
        source = spark.readStream.format("blocks").option("path", self.landing).load()
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return (
            source.writeStream.foreachBatch(self.follow)
            .option("checkpointLocation", self.checkpoint)
            .trigger(**trigger)
            .start()
        )

    def follow(self, ranges: DataFrame, batch_id: int) -> None:
        """The landed ranges of a micro-batch, ``ranges_per_batch`` of them a commit of the store.

        A range that the store has is a replay, and passed over."""
        spark = ranges.sparkSession
        rows = sorted((row["first"], row["last"]) for row in ranges.collect())
        store = self.store(spark)
        rows = [blocks for blocks in rows if not store.holds(blocks)]
        for at in range(0, len(rows), self.ranges_per_batch):
            taken = rows[at:at + self.ranges_per_batch]
            for (_, last), (first, _) in zip(taken, taken[1:]):
                follows(last, first)
            blocks = taken[0][0], taken[-1][1]
            heads = landed_heads(spark, self.landing, *blocks)
            self.process(landed_ops(spark, self.landing, *blocks), blocks, heads)

    def process(self, ops: DataFrame, blocks: tuple[int, int], heads: dict | None = None) -> bool:
        """Process the operations of the block range ``blocks``; False if it was done before.
        ``heads`` are those observed when they were landed, if they were."""
        transactions = self.transactions and scan_ops(self.transactions, *blocks)
        plan = AlertPlan(
            ops, self.catalog, transactions, snapshot=self.initial_state, semantics=self.semantics)
        return self.store(ops.sparkSession).append(plan, blocks, heads)


def expire(spark: SparkSession, out: str, as_of: str) -> int:
    """Take the days out that lie wholly before the retention; gives their number."""
    return AlertStore(spark, out).expire(as_of)


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    return AlertStore(spark, out).progress()


def read_output(spark: SparkSession, out: str, as_of: str | None = None) -> DataFrame:
    """All notifications of a stream; with ``as_of`` those within the retention then."""
    return AlertStore(spark, out).notifications(as_of)


__all__ = ["AlertStream", "expire", "publish_range", "read_output", "read_progress"]
