"""Commits, the alert store on them, stored verdicts, kept counts, upkeep."""

import datetime
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from chainalerts import schemas
from chainalerts.operators.verification import pending_verifications
from chainalerts.plans.account_queries import unread_counts
from chainalerts.plans.notifications import AlertPlan
from chainalerts.plans.store import AlertStore, run_batch, unseen
from chainalerts.sources.commits import CommitLog, Conflict, Entry
from chainalerts.sources.op_log import scan_ops
from chainalerts.sources.sinks import folders, shared_folder
from tests.conftest import enabled, transfer

ROW = "a INT, created_date DATE"


def new_folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def log(spark):
    return CommitLog(spark, new_folder())


def rows(spark, *values, day="2024-01-01"):
    return spark.createDataFrame([(v, datetime.date.fromisoformat(day)) for v in values], ROW)


def read(log, **options):
    return sorted(r["a"] for r in log.read("t", ROW, **options).collect())


def test_commits_are_whole_and_once(spark, log):
    assert read(log) == [] and log.snapshot().last("w") is None
    add = log.write("t", rows(spark, 1, 2), by_day=True) + log.write("u", rows(spark, 9))
    assert read(log) == []  # written, not committed
    assert log.commit("w", 5, add, facts={"x": 1})
    assert read(log) == [1, 2] and log.snapshot().last("w") == {"number": 5, "x": 1}
    for number in (5, 4):
        assert not log.commit("w", number, log.write("t", rows(spark, 7), by_day=True))
    assert log.commit("v", 1, log.write("t", rows(spark, 3, day="2024-01-02"), by_day=True))
    assert read(log) == [1, 2, 3] and read(log, days=["2024-01-02"]) == [3] and read(log, days=["2023-01-02"]) == []
    entry = log.snapshot().of("t", ["2024-01-01"])
    assert log.commit("w", 6, log.write("t", rows(spark, 4), by_day=True), remove=entry) and read(log) == [3, 4]
    with pytest.raises(Conflict):
        log.commit("w", 7, remove=entry)
    assert log.history().count() == 3


def test_two_writers_at_once(spark, log, monkeypatch):
    """A commit whose version was taken meanwhile goes on with the next, or finds itself done."""
    other = CommitLog(spark, log.path)
    publish, done = CommitLog._publish, []

    def late(self, path, text):
        if self is log and not done:
            done.append(1)
            assert other.commit(json.loads(text)["writer"] if len(done) > 9 else "other", 1, other.write("t", rows(spark, 1)))
        return publish(self, path, text)

    monkeypatch.setattr(CommitLog, "_publish", late)
    assert log.commit("w", 1, log.write("t", rows(spark, 2)))
    assert read(log) == [1, 2] and log.snapshot().version == 1
    done.clear()
    monkeypatch.setattr(CommitLog, "_publish", lambda self, path, text: (
        late(self, path, text) if self is not log or done else (
            done.append(1), other.commit("w", 2, other.write("t", rows(spark, 3))), publish(self, path, text))[2]))
    assert not log.commit("w", 2, log.write("t", rows(spark, 4)))
    assert read(log) == [1, 2, 3]


def test_full_files_and_vacuum(spark, log):
    for n in range(45):
        now = log.snapshot()
        log.commit("w", n, log.write("t", rows(spark, n).coalesce(1)), remove=now.of("t")[:-2])
    assert len(folders(spark, f"{log.path}/_commits/*.full")) == 2
    fresh = CommitLog(spark, log.path)
    assert read(fresh) == [42, 43, 44] and fresh.snapshot().version == 44
    log.write("t", rows(spark, 99))  # an attempt that died
    assert log.vacuum(3600) == 0
    assert log.vacuum(0) == 43 and read(log) == [42, 43, 44]
    assert len(folders(spark, f"{log.path}/t/*")) == 3
    assert fresh.snapshot() == CommitLog(spark, log.path).snapshot()
    assert len(folders(spark, f"{log.path}/_commits/*.json")) < 45
    assert not [f for f in os.listdir(f"{log.path}/_commits") if f.startswith(".") and not f.endswith(".crc")]


def token(sender, to, qty="3"):
    inner = json.dumps({"to": to, "qty": qty, "token": "DEC"})
    return {"required_auths": [sender], "required_posting_auths": [], "id": "sm_token_transfer", "json": inner}


@pytest.fixture(scope="module")
def ops(make_ops):
    """Four days; alice gets the most, splinterlands is on for her and bob."""
    day = 28_800
    made = [(0, 18, enabled(a, {"splinterlands": ["trn"], "currency": ["trn"]})) for a in ("alice", "bob")]
    for n in range(4):
        made += [(n * day + k + 1, 2, transfer("alice" if k % 3 else f"user{n}")) for k in range(6)]
        made += [(n * day + 9, 18, token("carol", "alice")), (n * day + 9, 18, token("carol", "bob"))]
    return make_ops(made).persist()


def ranges(days):
    return [(0 if n == 0 else n * 28_800, (n + 1) * 28_800 - 1) for n in range(days)]


def keys(frame):
    return sorted((r["notif_key"], r["verified"]) for r in frame.collect())


def test_ranges_once_whatever_dies(spark, ops, monkeypatch):
    store = AlertStore(spark, new_folder())
    whole = AlertPlan(ops)
    write, failed, staged = CommitLog.write, [], folders(spark, f"{shared_folder(spark)}/staged-*")

    def dies(self, table, frame, **options):
        if table in ("rejects", "state") and len(failed) < 2:
            failed.append(table)
            raise RuntimeError("killed")
        return write(self, table, frame, **options)

    monkeypatch.setattr(CommitLog, "write", dies)
    for blocks in ranges(4):
        for _ in range(3):
            try:
                store.append(AlertPlan(scan_ops(ops, *blocks)), blocks)
            except RuntimeError:
                pass
    assert failed == ["rejects", "rejects"]
    assert keys(store.notifications()) == keys(whole.notifications()) != []
    assert folders(spark, f"{shared_folder(spark)}/staged-*") == staged
    with pytest.raises(ValueError, match="are missing"):
        store.append(AlertPlan(ops), (400_000, 400_001))
    with pytest.raises(ValueError, match="comes after"):
        store.append(AlertPlan(ops), (1, 300_000))
    assert [(r["first_block"], r["last_block"], r["ops"]) for r in store.progress().orderBy("last_block").collect()][:2] == [
        (0, 28_799, 10), (28_800, 57_599, 8)]


def test_run_batch_of_an_empty_log(spark, make_ops):
    assert not run_batch(AlertPlan(make_ops([])), new_folder())


def files(spark, store, day):
    return sorted(f for e in store.log.snapshot().of("notifications", [day]) for f in folders(
        spark, f"{store.log.path}/{e.path}/part-*"))


def test_verdicts_change_stored_rows(spark, ops):
    store = AlertStore(spark, new_folder())
    for blocks in ranges(4):
        store.append(AlertPlan(scan_ops(ops, *blocks)), blocks)
    pending = [r["notif_key"] for r in pending_verifications(store.notifications()).collect()]
    pending.sort(key=lambda k: (int(k.split(":")[0]), k))
    assert len(pending) == 8
    answer = lambda *pairs: spark.createDataFrame(list(pairs), "notif_key string, answer boolean")
    first = [k for k in pending if int(k.split(":")[0]) < 28_800]
    untouched = files(spark, store, "2024-01-04")
    assert store.settle(answer((first[0], True), (first[1], True), (first[1], False), (pending[-1], None), ("x", True)), 1)
    assert not store.settle(answer((first[0], False)), 1)  # the same round again
    shown = dict(keys(store.notifications()))
    assert (shown[first[0]], shown[first[1]], shown[pending[-1]]) == (True, False, None)
    plan = store.notifications()._jdf.queryExecution().toString()
    assert "LeftOuter" in plan
    before = keys(store.notifications())
    assert store.compact() == ["2024-01-01"]
    assert keys(store.notifications()) == before and store.compact() == []
    assert files(spark, store, "2024-01-04") == untouched
    # A later round takes what is still pending; a verdict stays.
    assert store.settle(answer((first[0], False), (pending[-1], True)), 2)
    shown = dict(keys(store.notifications()))
    assert shown[first[0]] is True and shown[pending[-1]] is True
    assert store.notifications().count() == AlertPlan(ops).notifications().count()


def test_counts_read_one_day_of_notifications(spark, ops):
    store = AlertStore(spark, new_folder())
    for blocks in ranges(4):
        store.append(AlertPlan(scan_ops(ops, *blocks)), blocks)
    accounts = store.accounts()
    assert {r["account"] for r in accounts.collect()} == {"alice", "bob", *[f"user{n}" for n in range(4)]}
    for text in ("2023-12-01", "2024-01-03 00:00:09", "2024-01-03 00:00:27", "2025-01-01"):
        limit = F.lit(text).cast("timestamp_ntz")
        plain = accounts.select("account", F.create_map(F.lit("all"), limit.cast("string")).alias("last_reads"))
        want = sorted(map(tuple, unread_counts(store.notifications(), plain).collect()))
        assert sorted(map(tuple, store.unread_counts(accounts, limit).collect())) == want
    own = F.when(F.col("account") == "alice", F.lit("2024-01-03 00:00:03")).otherwise("2024-01-01 00:00:03").cast("timestamp_ntz")
    got = {r["account"]: r["unread"] for r in store.unread_counts(accounts, own).collect()}
    assert got["alice"] == 5 + 5 and got["bob"] == 4 and got["user0"] == 1
    store.compact()
    assert {r["account"]: r["unread"] for r in store.unread_counts(accounts, own).collect()} == got
    # Expired days leave notifications and counts alike.
    assert store.expire("2024-02-02 00:00:00") == 2
    assert {r["account"]: r["unread"] for r in store.unread_counts(accounts, own).collect()}["bob"] == 2


def scanned(frame):
    """Rows that the file scan of a plan gave out, before any filter on them."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    while plan.children().nonEmpty() or "Adaptive" in plan.nodeName():
        plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_one_account_reads_its_row_groups(spark, make_ops):
    """Every day's file spans all names: only the filters in the files tell who is in it."""
    store = AlertStore(spark, new_folder())
    ops = make_ops([(n * 28_800, 2, transfer(who)) for n in range(4) for who in ("aaa", f"mmm{n}", "zzz")])
    store.append(AlertPlan(ops), (0, 4 * 28_800))
    rows = store.notifications().select("account", "remark")
    assert scanned(rows) == 12
    assert scanned(rows.where("account = 'mmm2'")) == 3 and rows.where("account = 'mmm2'").count() == 1
    assert scanned(rows.where("account = 'mmm7'")) == 0


def test_folders_stay_as_many(spark, make_ops):
    """Over many batches: staged frames, state, accounts and old days all go."""
    store = AlertStore(spark, new_folder(), compact_every=3, retention_days=1, grace_seconds=0)
    sizes, staged = [], folders(spark, f"{shared_folder(spark)}/staged-*")
    for n in range(9):
        block = n * 14_400
        part = make_ops([(block, 2, transfer("alice")), (block + 1, 2, transfer(f"user{n % 4}"))], first_id=2 * n)
        assert store.append(AlertPlan(part), (block, block + 14_399))
        assert not store.append(AlertPlan(part), (block, block + 14_399))
        sizes.append(len(folders(spark, f"{store.log.path}/*/commit=*")) + len(folders(spark, f"{store.log.path}/*/*/created_date=*")))
    assert max(sizes[6:]) <= max(sizes[3:6])
    assert folders(spark, f"{shared_folder(spark)}/staged-*") == staged
    assert store.accounts().count() == 5
    assert {str(r["d"]) for r in store.notifications().select(F.col("created_date").alias("d")).distinct().collect()} == {
        "2024-01-04", "2024-01-05"}


def test_schema_of_an_empty_store(spark):
    store = AlertStore(spark, new_folder())
    assert store.notifications().columns == spark.createDataFrame([], schemas.NOTIFICATIONS).columns
    assert store.unread_counts(store.accounts(), F.current_timestamp()).count() == 0
    assert store.expire("2024-01-01 00:00:00") == 0 and store.compact() == []
    assert Entry("t", "p").day is None


@pytest.mark.parametrize("threshold", ["64k", "-1"])
def test_known_accounts_stay_where_they_lie(spark, tmp_path, threshold):
    """A batch's accounts go to the known ones, which are not shuffled; a large batch is joined by shuffles."""
    spark.range(200_000).selectExpr("concat('u', id) AS account").write.parquet(f"{tmp_path}/known")
    spark.range(199_990, 200_010).selectExpr("concat('u', id) AS account", "id AS n").write.parquet(f"{tmp_path}/found")
    known, found = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("known", "found"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        fresh = unseen(found, known)
        assert {r["n"] for r in fresh.collect()} == set(range(200_000, 200_010))
        tree = fresh._jdf.queryExecution().optimizedPlan().toString()
        plan = fresh._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join LeftSemi" in tree and "Join LeftAnti" in tree
    assert ("LeftSemi, BuildRight" in plan) == (threshold == "64k")
