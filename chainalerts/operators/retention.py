"""Rolling retention of notifications and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainalerts.constants import BLOCK_RETENTION, RETENTION_DAYS


def retained_notifications(notifications: DataFrame, as_of: str) -> DataFrame:
    """Notifications younger than 30 days; the date test prunes whole partitions."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")
    return notifications.where(
        (F.col("created_date") >= F.to_date(oldest)) & (F.col("created") > oldest)
    )


def retained_blocks(blocks: DataFrame, irreversible_block: int) -> DataFrame:
    return blocks.where(F.col("num") > irreversible_block - BLOCK_RETENTION)
