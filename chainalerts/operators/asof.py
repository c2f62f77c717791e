"""The account state as of a position of the log.

A position is (block_num, op_id, hook_ord). Every candidate row gets the codes and the
options its gate account had just before.

Rows are spread by (account, module, bucket of operation ids), so an account that holds a
third of the log is split over as many groups as the log has buckets, however many
operations a block has. What an earlier bucket left behind is carried in as one row per
group. The way is the same for logs of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_OPS = 20_000
POSITION = "struct(int({0}block_num), bigint({0}op_id), int({0}hook_ord))"


def asof_state(
    rows: DataFrame, changes: DataFrame, bucket_ops: int = BUCKET_OPS,
    places: DataFrame | None = None,
) -> DataFrame:
    """Add ``codes`` and ``opts`` of (gate_account, module) before each row's position.

    Operation ids grow with the position, as the log's order says. ``places`` may give the
    rows' gate_account, module and op_id from a cheaper plan than theirs.
    """
    key = ["gate_account", "module"]
    bucket = F.floor(F.col("op_id") / F.lit(bucket_ops)).alias("bucket")
    asked = (rows if places is None else places).select(*key, bucket)
    rows = rows.select("*", bucket)
    changes = changes.withColumnRenamed("account", "gate_account").select("*", bucket)

    # What each bucket leaves behind, and the groups that need to know it. Both are
    # reduced before the shuffle; a key has at most two rows per bucket here.
    pos = F.expr(POSITION.format(""))
    left_behind = changes.groupBy(*key, "bucket").agg(
        F.max_by("codes", F.when(F.col("codes").isNotNull(), pos)).alias("codes"),
        F.max_by("opts", F.when(F.col("opts").isNotNull(), pos)).alias("opts"),
    )
    groups = asked.distinct()
    earlier = (
        Window.partitionBy(*key).orderBy("bucket", "kind")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        groups.withColumn("kind", F.lit(0))
        .unionByName(left_behind.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .withColumns({
            "codes": F.last("codes", ignorenulls=True).over(earlier),
            "opts": F.last("opts", ignorenulls=True).over(earlier),
        })
        .where((F.col("kind") == 0) & (F.col("codes").isNotNull() | F.col("opts").isNotNull()))
        .select(*key, "bucket", "codes", "opts", F.lit(-1).alias("block_num"),
                F.lit(-1).cast("bigint").alias("op_id"), F.lit(0).alias("hook_ord"))
    )

    # One shuffle of the full rows: state rows and candidates meet in their bucket.
    before = (
        Window.partitionBy(*key, "bucket").orderBy("block_num", "op_id", "hook_ord")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    state = changes.select(*key, "bucket", "codes", "opts", "block_num", "op_id", "hook_ord")
    return (
        rows.withColumn("is_row", F.lit(True))
        .unionByName(state.unionByName(carried), allowMissingColumns=True)
        .withColumns({
            "codes": F.last("codes", ignorenulls=True).over(before),
            "opts": F.last("opts", ignorenulls=True).over(before),
        })
        .where("is_row")
        .drop("is_row", "bucket")
    )
