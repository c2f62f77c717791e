"""System status, progress and health, from what has been processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainalerts.constants import HEALTH_MAX_BLOCKS, HEALTH_MAX_SECONDS
from chainalerts.functions.text import percent_text


def preload_progress(next_block: Column, first: int, last: int) -> Column:
    """Share of the block range done, in percent; ``next_block`` is the next to read."""
    return (next_block - first) / F.lit(float(last - first)) * 100


def system_status(
    processed: DataFrame, as_of: str, preload_range: tuple[int, int] | None = None,
    sync_enabled: bool = True,
) -> DataFrame:
    """One row over the processed operations (block_num, op_id, ts).

    With a preload range the state counts as preloaded once its last block is done;
    the progress is shown only before that.
    """
    heads = processed.agg(
        F.max("block_num").alias("block_num"),
        F.max_by("ts", F.struct("block_num", "op_id")).alias("block_time"),
        F.max("op_id").alias("latest_op_id"),
    )
    if preload_range is None:
        preloaded, progress = F.lit(True), F.lit(None).cast("double")
    else:
        first, last = preload_range
        preloaded = F.coalesce(F.col("block_num") >= last, F.lit(False))
        done = F.coalesce(preload_progress(F.col("block_num") + 1, first, last), F.lit(0.0))
        progress = F.when(~preloaded, done)
    return heads.select(
        F.coalesce("block_num", F.lit(0)).alias("block_num"),
        "block_time",
        "latest_op_id",
        F.lit(as_of).cast("timestamp_ntz").alias("last_updated"),
        F.lit(sync_enabled).alias("sync_enabled"),
        preloaded.alias("state_preloaded"),
        progress.alias("state_preload_progress"),
    ).withColumn("state_preload_progress_text", F.expr(percent_text("state_preload_progress")))


def sync_allowed(status: DataFrame) -> DataFrame:
    """The sync gate: runs only when preloaded and enabled."""
    return status.select((F.col("state_preloaded") & F.col("sync_enabled")).alias("allowed"))


def _seconds_text(seconds: Column) -> Column:
    """Seconds with a fraction only where there is one, and at least one decimal."""
    return seconds.cast("double").cast("string")


def health(status: DataFrame, head_block: int | Column, now: str | Column) -> DataFrame:
    """Verdict on a status row; the first that applies."""
    behind = F.lit(head_block) - F.col("block_num")
    # The block time is known to the second.
    block_time = F.date_trunc("second", F.col("block_time")).cast("timestamp_ntz")
    elapsed = F.lit(now).cast("timestamp_ntz") - block_time
    seconds = elapsed.cast("interval day to second").cast("interval second").cast("decimal(18,6)")
    return status.withColumn(
        "health",
        F.when(~F.col("state_preloaded"), "BAD - State not preloaded.")
        .when(F.col("block_num") == 0, "BAD - System not ready.")
        .when(behind > HEALTH_MAX_BLOCKS, F.concat(F.lit("BAD - "), behind.cast("string"), F.lit(" blocks behind... ")))
        .when(
            seconds > HEALTH_MAX_SECONDS,
            F.concat(F.lit("BAD - "), _seconds_text(seconds), F.lit(" seconds behind...")),
        )
        .otherwise("GOOD"),
    )


def module_progress(processed: DataFrame, modules: DataFrame) -> DataFrame:
    """State row per module except core: what it processed last, and its flag.

    ``processed`` holds the operations that were dispatched to the module's hooks, whether
    or not an alert came of them.
    """
    latest = processed.groupBy("module").agg(
        F.max("op_id").alias("latest_op_id"), F.max("block_num").alias("latest_block_num")
    )
    return (
        modules.where(F.col("module") != "core")
        .join(latest, "module", "left")
        .select("module", "module_category", "enabled", "latest_op_id", "latest_block_num")
    )
