import tempfile

import pytest
from pyspark.sql import functions as F

from chainalerts.plans.notifications import AlertPlan
from chainalerts.plans.status import sync_allowed
from chainalerts.plans.store import AlertStore
from chainalerts.sources.block_source import BlockReader, BlockSource, landed_heads, landed_ops
from chainalerts.sources.sinks import folders
from chainalerts.streaming.sync import (
    AlertStream, expire, publish_range, read_output, read_progress,
)
from tests.conftest import enabled, preference, transfer


@pytest.fixture(scope="module")
def log(make_ops):
    limits = {"currency": {"trn": {"min_hbd": 2}}}
    return make_ops([
        (1, 2, transfer("alice")), (2, 18, enabled("alice", {"currency": []})),
        (2, 2, transfer("alice")), (3, 2, transfer("alice")),
        (4, 18, enabled("alice", {"currency": ["trn"]})),
        (5, 18, preference("bob", [[1, "a"], "options", limits])),
        (6, 2, transfer("alice")), (6, 2, transfer("bob")), (7, 2, transfer("bob", raw="2000")),
        (8, 40, {"delegator": "x"}), (9, 2, transfer("carol")),
    ]).persist()


def keys(frame):
    return sorted(row["notif_key"] for row in frame.select("notif_key").collect())


def follow(spark, log, ranges, **options):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for first, last in ranges:
        publish_range(log, f"{folder}/landing", first, last, 9)
    stream = AlertStream(f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", **options)
    stream.start(spark).awaitTermination()
    return folder, stream


def test_stream_equals_batch(spark, log):
    whole = keys(AlertPlan(log).notifications())
    assert len(whole) == 4
    folder, stream = follow(spark, log, [(1, 2), (3, 4), (5, 6), (7, 9)], compact_every=2)
    assert keys(read_output(spark, f"{folder}/out")) == whole
    assert [r["last_block"] for r in read_progress(spark, f"{folder}/out").orderBy("batch_id").collect()
            ] == [2, 4, 6, 9]
    # A replay of a range changes nothing.
    assert not stream.process(log.where("block_num BETWEEN 5 AND 6"), (5, 6))
    assert keys(read_output(spark, f"{folder}/out")) == whole
    # Restarting with nothing new adds nothing; blocks out of order are refused.
    stream.start(spark).awaitTermination()
    assert read_progress(spark, f"{folder}/out").count() == 4
    with pytest.raises(ValueError, match="after block 9"):
        stream.process(log.where("block_num = 9"), (9, 10))
    with pytest.raises(ValueError, match="blocks 10 to 11 are missing"):
        stream.process(log.where("false"), (12, 13))


def test_progress_of_a_stream_is_what_was_landed(spark, log, monkeypatch):
    """Nothing is read for it: the store gets its heads with each range."""
    given = []
    append = AlertStore.append
    monkeypatch.setattr(AlertStore, "append", lambda store, plan, blocks, heads=None: (
        given.append(heads), append(store, plan, blocks, heads))[1])
    folder, _ = follow(spark, log, [(1, 3), (4, 9)])
    assert [h["ops"] for h in given] == [4, log.count() - 4]
    done = read_progress(spark, f"{folder}/out").orderBy("batch_id").collect()
    want = [log.where(where).agg(F.count("*"), F.max("ts")).first() for where in ("block_num < 4", "block_num > 3")]
    assert [(r["ops"], r["block_time"]) for r in done] == [tuple(w) for w in want]


def test_a_gap_stops_the_stream(spark, log):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for first, last in ((1, 2), (5, 6)):
        publish_range(log, f"{folder}/landing", first, last, 9)
    stream = AlertStream(f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", ranges_per_batch=2)
    with pytest.raises(Exception, match="blocks 3 to 4 are missing"):
        stream.start(spark).awaitTermination()
    assert [r["last_block"] for r in read_progress(spark, f"{folder}/out").collect()] in ([2], [])


def test_empty_ranges_are_no_gap(spark, log):
    quiet = log.where("block_num NOT IN (3, 4, 9)")
    folder, _ = follow(spark, quiet, [(1, 2), (3, 4), (5, 8), (9, 9)])
    rows = read_progress(spark, f"{folder}/out").orderBy("batch_id").collect()
    assert [(r["first_block"], r["last_block"], r["ops"]) for r in rows] == [
        (1, 2, 3), (3, 4, 0), (5, 8, 5), (9, 9, 0)]
    assert keys(read_output(spark, f"{folder}/out")) == keys(AlertPlan(quiet).notifications())


def test_preload_gate_and_resume(spark, log):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    def new(**options):
        return AlertStream(f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint",
                           preload=True, compact_every=2, **options)

    as_of, wanted = "2024-01-01 00:05:00", (1, 3)
    assert new().start(spark) is None
    assert not sync_allowed(new().status(spark, as_of, wanted)).first()["allowed"]
    new().prepare(log, *wanted)
    assert sync_allowed(new().status(spark, as_of, wanted)).first()["allowed"]
    assert not sync_allowed(new(sync_enabled=False).status(spark, as_of, wanted)).first()["allowed"]
    assert new(sync_enabled=False).start(spark) is None
    publish_range(log, f"{folder}/landing", 4, 6, 9)
    new().start(spark).awaitTermination()
    publish_range(log, f"{folder}/landing", 7, 9, 9)
    new().start(spark).awaitTermination()
    whole = [r["notif_key"] for r in AlertPlan(log).notifications().where("block_num > 3").collect()]
    assert keys(read_output(spark, f"{folder}/out")) == sorted(whole)


def test_old_days_are_dropped(spark, log):
    folder, _ = follow(spark, log, [(1, 9)])
    out = f"{folder}/out"
    assert expire(spark, out, "2024-01-31 00:00:00") == 0
    assert len(keys(read_output(spark, out))) == 4
    # Within the oldest day the rows are cut on reading: blocks 1 and 6 to 9, three seconds each.
    assert len(keys(read_output(spark, out, "2024-01-31 00:00:10"))) == 3
    assert expire(spark, out, "2024-02-01 00:00:00") == 1
    assert read_output(spark, out).count() == 0
    assert folders(spark, f"{out}/notifications/commit=*/created_date=*")
    AlertStore(spark, out).log.vacuum(0)
    assert not folders(spark, f"{out}/notifications/commit=*")


def test_one_batch_and_gate(spark, log):
    folder, _ = follow(spark, log, [(1, 4), (5, 9)], ranges_per_batch=2)
    assert keys(read_output(spark, f"{folder}/out")) == keys(AlertPlan(log).notifications())
    shut = AlertStream(f"{folder}/landing", f"{folder}/o2", f"{folder}/c2", sync_enabled=False)
    assert shut.start(spark) is None


def test_only_final_blocks_are_published(spark, log):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    assert publish_range(log, folder, 1, 9, 3) == 3
    assert publish_range(log, folder, 4, 9, 3) == 3
    assert landed_ops(spark, folder, 0, 99).count() == 4


def test_heads_come_from_the_landing(spark, log):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    publish_range(log.repartition(3), folder, 1, 4, 9)
    publish_range(log.where("false"), folder, 5, 5, 9)
    publish_range(log, folder, 6, 9, 9)
    for first, last in [(1, 4), (6, 9), (1, 9), (5, 9)]:
        rows = log.where(F.col("block_num").between(first, last) & (F.col("block_num") != 5))
        want = rows.agg(F.count("*"), F.max("op_id"), F.max("ts").cast("string")).first()
        heads = landed_heads(spark, folder, first, last)
        assert (heads["ops"], heads["head_op"], heads["time"]) == tuple(want)
    assert landed_heads(spark, folder, 5, 5) == {"ops": 0, "head_op": None, "time": None}
    for cut in [(1, 3), (2, 4), (4, 9), (1, 10)]:  # no whole ranges: the operations have to be read
        assert landed_heads(spark, folder, *cut) is None


def test_offsets_are_blocks(spark, log):
    """Ranges landed in files of any time and number; the source goes on by block."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    reader = BlockReader(folder, None)
    assert reader.initialOffset() == reader.latestOffset() == {"block": -1}
    assert reader.partitions({"block": -1}, {"block": -1}) == []
    publish_range(log.repartition(3), folder, 1, 4, 6)
    assert publish_range(log, folder, 1, 4, 6) == 4  # landed before: nothing is doubled
    publish_range(log, folder, 5, 9, 6)
    assert reader.initialOffset() == {"block": 0} and reader.latestOffset() == {"block": 6}
    parts = lambda *ends: [(p.first, p.last) for p in reader.partitions(*[{"block": b} for b in ends])]
    assert parts(0, 6) == [(1, 4), (5, 6)] and parts(2, 5) == [(3, 4), (5, 5)] and parts(6, 6) == []
    assert landed_ops(spark, folder, 1, 99).count() == log.where("block_num <= 6").count()
    assert landed_ops(spark, folder, 5, 6).inputFiles() != landed_ops(spark, folder, 1, 6).inputFiles()
    spark.dataSource.register(BlockSource)
    seen = []
    for _ in range(2):
        source = spark.readStream.format("blocks").option("path", folder).option("first", 2).load()
        query = source.writeStream.foreachBatch(lambda df, n: seen.append(sorted(map(tuple, df.collect())))).option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        publish_range(log, folder, 7, 9, 9)
    assert [x for x in seen if x] == [[(2, 4), (5, 6)], [(7, 9)]]
