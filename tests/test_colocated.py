"""Operations and transactions that lie in the same buckets."""

import pytest
from pyspark.sql import functions as F

from chainalerts import schemas
from chainalerts.plans.notifications import AlertPlan
from chainalerts.sources.colocated import ColocatedLog
from chainalerts.sources.op_log import with_transactions
from tests.conftest import transfer


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def joined_by_size(spark):
    """No side is small enough to be sent to all tasks, as at scale."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def logs(spark, make_ops):
    """Six operations a block: two of transaction 0, two of 1, one of 2 (no hash is known), one of none."""
    ops = make_ops([(b, 2, transfer(f"u{k}")) for b in range(1, 61) for k in range(6)])
    place = F.col("op_id") % 6
    ops = ops.withColumn("trx_in_block", F.when(place < 5, F.floor(place / 2)).cast("int"))
    hashes = ops.where("trx_in_block < 2").select("block_num", "trx_in_block").distinct()
    hashes = hashes.withColumn("trx_hash", F.unhex(F.md5(F.concat_ws(":", "block_num", "trx_in_block"))))
    return ops, hashes.select(*[f.split()[0] for f in schemas.TRANSACTIONS.split(", ")])


@pytest.fixture
def log(spark, logs, tmp_path):
    log = ColocatedLog(spark, f"{tmp_path}/log", buckets=3, block_bucket=10)
    log.land(*logs)
    return log


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_join_without_exchange(joined_by_size, log, logs):
    joined = log.joined(8, 33)
    assert "Exchange" not in executed(joined) and "SortMergeJoin" in executed(joined)
    plain = with_transactions(*logs).where("block_num BETWEEN 8 AND 33").select(*joined.columns)
    assert rows(joined) == rows(plain)
    assert joined.where("trx_hash IS NOT NULL").count() == 26 * 4


def test_both_sides_read_only_the_directories_of_the_range(log):
    for side in log._range(12, 25):
        files = side.select(F.input_file_name().alias("f")).distinct().collect()
        found = {r["f"].split("bucket_first=")[1].split("/")[0] for r in files}
        assert found == {"10", "20"}


def test_one_file_a_bucket(log, tmp_path):
    for kind in ("ops", "transactions"):
        for folder in (tmp_path / "log" / kind).glob("*/*"):
            if folder.is_dir():
                assert len(list(folder.glob("*.parquet"))) <= 3


def test_landing_again_replaces_its_directories_only(spark, log, logs, tmp_path):
    before = rows(log.ops())
    part = [side.where("block_num BETWEEN 20 AND 29") for side in logs]
    other = {p: p.stat().st_mtime_ns for p in tmp_path.glob("log/ops/bucket_first=10/*/*.parquet")}
    log.land(*part)
    assert rows(log.ops()) == before
    log.land(*[side.where("block_num BETWEEN 20 AND 24") for side in logs])
    assert len(rows(log.ops())) == len(before) - 5 * 6
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("log/ops/bucket_first=10/*/*.parquet")} == other


def test_another_session_finds_the_layout(spark, log, logs, joined_by_size):
    for kind in ("ops", "transactions"):
        spark.sql(f"DROP TABLE {log._table(kind, getattr(schemas, kind.upper()))}")
    again = ColocatedLog(spark, log.path + "/", buckets=99)
    assert (again.buckets, again.block_bucket) == (3, 10)
    assert rows(again.ops().drop("bucket_first", "bucket_last")) == rows(logs[0])
    assert "Exchange" not in executed(again.joined(1, 60))


def test_empty_landing(spark, logs, tmp_path):
    log = ColocatedLog(spark, f"{tmp_path}/none", buckets=2)
    log.land(*[side.where("false") for side in logs])
    assert log.joined(1, 60).count() == 0


def test_alerts_take_their_hashes_without_an_exchange(joined_by_size, log, logs):
    state = log.spark.createDataFrame(
        [(f"u{k}", "currency", ["*"], None) for k in range(6)],
        "account STRING, module STRING, codes ARRAY<STRING>, opts MAP<STRING,MAP<STRING,STRING>>")
    plan = log.alert_plan(5, 44, snapshot=state)
    ops, hashes = (side.where("block_num BETWEEN 5 AND 44") for side in logs)
    late = AlertPlan(ops, transactions=hashes, snapshot=state)
    assert rows(plan.notifications()) == rows(late.notifications())
    assert plan.notifications().count() == 40 * 6
    by_transaction = "hashpartitioning(block_num"
    assert by_transaction in executed(late.notifications())
    assert by_transaction not in executed(plan.notifications())
