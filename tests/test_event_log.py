import datetime
import re

from pyspark.sql import functions as F

from chainalerts.plans.notifications import AlertPlan
from chainalerts.sources.event_log import READ_TASKS, event_ops
from chainalerts.sources.op_log import scan_ops
from chainalerts.sources.sinks import staging
from registry.queries import all_queries
from tests.conftest import enabled, transfer

COLUMNS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _events(spark, folder, n):
    kinds = ["signup", "purchase", "click", "view", "error"]
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), i % 37, kinds[i % 5], i / 4,
             f'{{"k": {i % 100}}}') for i in range(n)]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_block_range_of_one_file_is_dealt_to_many_tasks(spark, tmp_path):
    sf_dir = _events(spark, tmp_path, 4_000)
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    assert spark.conf.get(READ_TASKS, None) is None
    before = spark.conf.get(least)
    spark.conf.set(least, "1b")
    try:
        part = scan_ops(event_ops(spark, sf_dir), 100, 199).withColumn("task", F.spark_partition_id())
        counts = [row["count"] for row in part.groupBy("task").count().collect()]
    finally:
        spark.conf.set(least, before)
    assert sum(counts) == 1_000
    assert len(counts) > 1 and max(counts) < 500


def test_queries_that_use_a_plan_twice_read_its_log_once(spark, tmp_path):
    sf_dir = _events(spark, tmp_path, 200)
    rejects = all_queries()["rejects"](spark, sf_dir)
    assert rejects.inputFiles() and not any("events.parquet" in path for path in rejects.inputFiles())


def test_staged_plan_gives_the_same_rows(spark, make_ops):
    ops = make_ops([
        (1, 18, enabled("ann", {"currency": ["trn"]})), (2, 2, transfer("ann")), (3, 2, transfer("x" * 20)),
        (4, 18, enabled("ann", {"currency": []})), (5, 2, transfer("ann")), (6, 18, enabled("ann", 3)),
    ])
    plain = AlertPlan(ops)
    with staging(spark) as stage:
        staged = AlertPlan(ops).staged(stage)
        for frame in ("notifications", "rejects"):
            found = [sorted(map(str, getattr(plan, frame)().collect())) for plan in (plain, staged)]
            assert found[0] and found[0] == found[1]


def test_generated_code_of_the_log_is_short_enough_to_be_compiled(spark, tmp_path):
    """The JIT leaves methods above 8000 bytes interpreted."""
    ops = event_ops(spark, _events(spark, tmp_path, 100))
    ops.collect()  # the final plan is what runs
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "65535")  # Spark's default: long methods are not left out of the plan
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(ops._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set(limit, before)
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) <= 8000
