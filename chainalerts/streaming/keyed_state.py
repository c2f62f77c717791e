"""Following the log with account state in Spark's state store.

    landed operations -> changes of preferences, and accounts that an alert asks for
      -> keyed by account: the state before the batch goes out, the batch's changes go in
      -> the batch plan with that state -> one commit of the alert store

The state store (RocksDB) holds a value for each account and module that has one: a batch touches the
accounts it names, and a value replaces the one before, so the store's size follows the accounts
and not the number of batches. Asks are made distinct before the shuffle, once per Arrow batch, so
an account with a third of the log arrives as a few rows; its changes pass through an iterator that
keeps the last of each module. What a batch's operations lead to is the batch plan, whose as-of
lookup splits hot accounts. A replayed batch starts from the same version of the state, and the
store passes over a range it has.

With ``ttl_ms`` an account's state expires so long after its last change, and the account is back
at the defaults; without, state stays (as preferences do).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from chainalerts.constants import RETENTION_DAYS
from chainalerts.operators.hooks import Catalog
from chainalerts.operators.preferences import preference_log
from chainalerts.plans.notifications import AlertPlan, candidates, changes_of
from chainalerts.plans.store import SECONDS_OF_GRACE, AlertStore, follows
from chainalerts.sources.block_source import RANGE_MARK, BlockSource, landed_ops
from chainalerts.sources.op_log import scan_ops
from chainalerts.sources.sinks import staging

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPTS = "MAP<STRING,MAP<STRING,STRING>>"
KEYED = "account STRING, module STRING, codes ARRAY<STRING>, opts STRING, block_num INT, op_id BIGINT"
ASK, MARK = None, ""  # the module of an ask; the account of the rows that name a batch's ranges


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], ["account"])


def keyed_rows(ops: DataFrame, catalog: Catalog, semantics: str = "reference") -> DataFrame:
    """Per account: changes of its state, and that it is asked for; under MARK the ranges."""
    columns = [c.split()[0] for c in KEYED.split(", ")]
    own = ops.where(F.col("op_type_id") != RANGE_MARK)
    asked = candidates(own, catalog, semantics, texts=False).where("error IS NULL AND gate_account IS NOT NULL")
    asked = asked.select("gate_account").mapInArrow(_distinct, "account STRING")
    changes = changes_of(preference_log(own, catalog), catalog).withColumn("opts", F.to_json("opts"))
    marks = ops.where(F.col("op_type_id") == RANGE_MARK).select(
        F.lit(MARK).alias("account"), "block_num", "op_id")
    rows = changes.select(*columns)
    for frame in (asked, marks):
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return rows.select(*columns)


class AccountState(StatefulProcessor):
    """Gives out an account's state as it was before the batch, and takes in its changes."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "module STRING", "codes ARRAY<STRING>, opts STRING", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        account, latest = key[0], {}
        for row in rows:
            if account == MARK:
                yield _out(account, None, None, None, row.block_num, row.op_id)
            elif row.module is not ASK:
                place = row.block_num, row.op_id
                for name in ("codes", "opts"):
                    value = getattr(row, name)
                    if value is not None and place >= latest.get((row.module, name), ((-1, -1),))[0]:
                        latest[row.module, name] = place, value
        if account == MARK:
            return
        before = {module[0]: tuple(value) for module, value in self.held.iterator()}
        for module, (codes, opts) in before.items():
            yield _out(account, module, codes, opts, None, None)
        for module in {module for module, _ in latest}:
            codes, opts = before.get(module, (None, None))
            self.held.updateValue((module,), (
                latest.get((module, "codes"), (None, codes))[1], latest.get((module, "opts"), (None, opts))[1]))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.held.updateValue((initialState.module,), (initialState.codes, initialState.opts))

    def close(self) -> None:
        pass


def _out(account, module, codes, opts, block_num, op_id) -> Row:
    return Row(account=account, module=module, codes=codes, opts=opts, block_num=block_num, op_id=op_id)


@dataclass
class KeyedAlertStream:
    """Follows ``landing`` into the store ``out``, with account state in the state store."""

    landing: str
    out: str
    checkpoint: str
    catalog: Catalog = field(default_factory=Catalog.default)
    transactions: DataFrame | None = None
    initial_state: DataFrame | None = None  # account, module, codes, opts: before the first block
    semantics: str = "reference"
    ttl_ms: int | None = None
    sync_enabled: bool = True
    retention_days: int = RETENTION_DAYS
    grace_seconds: float = SECONDS_OF_GRACE

    def store(self, spark: SparkSession) -> AlertStore:
        return AlertStore(spark, self.out, retention_days=self.retention_days,
                          grace_seconds=self.grace_seconds, keep_state=False)

    def start(self, spark: SparkSession, every: str | None = None) -> StreamingQuery | None:
        """Start following; without ``every`` it stops when it has caught up. Resumes by block."""
        if not self.sync_enabled:
            return None
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        spark.dataSource.register(BlockSource)
        ops = spark.readStream.format("blocks").option("path", self.landing).option("rows", "operations").load()
        initial = None
        if self.initial_state is not None:
            initial = self.initial_state.select("account", "module", "codes", F.to_json("opts").alias("opts")).groupBy("account")
        opening = keyed_rows(ops, self.catalog, self.semantics).groupBy("account").transformWithState(
            AccountState(self.ttl_ms), KEYED, "append", "processingTime" if self.ttl_ms else "none", initial)
        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        return (
            opening.writeStream.foreachBatch(self.follow).outputMode("append")
            .option("checkpointLocation", self.checkpoint).trigger(**trigger).start()
        )

    def follow(self, opening: DataFrame, batch_id: int) -> None:
        """One micro-batch: the state its accounts begin with, and the ranges it is about."""
        spark = opening.sparkSession
        with staging(spark) as stage:
            rows = stage(opening, "opening")  # the stateful step runs once
            marks = rows.where(F.col("account") == MARK).select("op_id", "block_num").collect()
            ranges = sorted((int(r["op_id"]), r["block_num"]) for r in marks)
            for (_, last), (first, _) in zip(ranges, ranges[1:]):
                follows(last, first)
            if not ranges:
                return
            first, last = ranges[0][0], ranges[-1][1]
            state = rows.where(F.col("account") != MARK).select(
                "account", "module", "codes", F.from_json("opts", OPTS).alias("opts"))
            transactions = self.transactions and scan_ops(self.transactions, first, last)
            plan = AlertPlan(landed_ops(spark, self.landing, first, last), self.catalog, transactions,
                             snapshot=state, semantics=self.semantics)
            self.store(spark).append(plan, (first, last))
