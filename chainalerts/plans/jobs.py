"""Preload of account state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainalerts.operators.hooks import Catalog
from chainalerts.operators.preferences import preference_log
from chainalerts.plans.notifications import changes_of
from chainalerts.sources.op_log import scan_ops


def latest_state(changes: DataFrame) -> DataFrame:
    """What a set of changes leaves: one row per account and module."""
    pos = F.struct("block_num", "op_id")
    return changes.groupBy("account", "module").agg(
        F.max_by("codes", F.when(F.col("codes").isNotNull(), pos)).alias("codes"),
        F.max_by("opts", F.when(F.col("opts").isNotNull(), pos)).alias("opts"),
    )


def preload_state(ops: DataFrame, catalog: Catalog, first: int, last: int) -> DataFrame:
    """Replay only the preference operations of ``first..last`` (both included)."""
    log = preference_log(scan_ops(ops, first, last), catalog)
    return latest_state(changes_of(log, catalog, preload=True))
