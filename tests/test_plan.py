import json
import tempfile

import pytest
from pyspark.sql import functions as F

from chainalerts import schemas
from chainalerts.operators.accounts import current_accounts, discover
from chainalerts.operators.hooks import Catalog, category_catalog, module_catalog
from chainalerts.operators.preferences import preference_log
from chainalerts.operators.retention import retained_blocks, retained_notifications
from chainalerts.operators.verification import apply_verifications, pending_verifications
from chainalerts.plans import account_queries as ask
from chainalerts.plans.jobs import preload_state
from chainalerts.plans.notifications import AlertPlan, candidates
from chainalerts.plans.status import health, sync_allowed, system_status
from chainalerts.sources import op_log
from chainalerts.sources.event_log import event_ops, event_transactions
from chainalerts.plans.store import AlertStore, run_batch
from tests.conftest import enabled, preference, transfer

SF = "/root/testdata/sf0.001"


def test_catalog():
    catalog = Catalog.default()
    assert len(catalog.hooks) == 11 and catalog.module_list() == ["currency", "social", "splinterlands"]
    off = catalog.set_enabled("social", False)
    assert off.is_enabled("social") is False and off.is_enabled("nosuch") is None
    assert len(off.enabled_hooks()) == 8 and off.codes() == catalog.codes()
    updated = catalog.register({"currency": {
        "enabled": False, "module_category": "Changed",
        "deleg": {"op_id": 40, "description": "D", "function": "core_deleg", "notif_code": "del"}}})
    assert len(updated.hooks) == 11 and updated.modules["currency"] == ("Currency", False)
    assert {h.description for h in updated.hooks if h.notif_code == "trn"} == {
        "Hive/HBD transfers", "DEC transfers"}
    with pytest.raises(ValueError):
        catalog.register({"Bad1": {"enabled": True, "module_category": "x"}})
    with pytest.raises(ValueError):
        catalog.pairs_of_category("nosuch")


def test_catalog_files(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    import os
    for name in ("apps", "Bad1"):
        os.makedirs(f"{folder}/{name}")
        with open(f"{folder}/{name}/hooks.json", "w") as file:
            json.dump({"enabled": True, "module_category": "Apps",
                       "one": {"op_id": 17, "description": "One", "function": "apps.one",
                               "notif_code": "one", "filter": "", "options": {"n": "number"}}}, file)
    catalog = Catalog.read(spark, folder)
    assert [(h.module, h.funct, h.options) for h in catalog.hooks] == [("apps", "one", {"n": "number"})]
    hooks, modules = catalog.hooks_frame(spark), catalog.modules_frame(spark)
    assert module_catalog(hooks, modules).first()["entries"][0]["notif_code"] == "one"
    assert category_catalog(hooks, modules).first()["pairs"] == {"One": "apps:one"}


def test_no_enabled_module_sends_nothing(make_ops):
    catalog = Catalog.default()
    for module in catalog.modules:
        catalog = catalog.set_enabled(module, False)
    assert AlertPlan(make_ops([(1, 2, transfer("alice"))]), catalog).notifications().count() == 0


def test_core_module_off_ignores_preferences(make_ops):
    ops = make_ops([(1, 18, enabled("alice", {"currency": []})), (2, 2, transfer("alice"))])
    off = Catalog.default().set_enabled("core", False)
    assert AlertPlan(ops).notifications().count() == 0
    assert AlertPlan(ops, off).notifications().count() == 1
    # A preload replays preferences whatever the flag; current accounts follow the alerts.
    assert preload_state(ops, off, 1, 2).count() == 1
    log = preference_log(ops, off)
    for catalog, codes in ((Catalog.default(), []), (off, ["trn"])):
        row = current_accounts(discover(candidates(ops, catalog), log), log, catalog).first()
        assert row["prefs"]["currency"] == codes


def test_escaped_preference_id(make_ops):
    body = json.dumps({"type": "x", "value": enabled("alice", {"currency": []})})
    assert '"gns"' in body
    ops = make_ops([(1, 18, body.replace('"gns"', '"\\u0067ns"')), (2, 2, transfer("alice"))])
    assert preference_log(ops, Catalog.default()).count() == 1
    assert AlertPlan(ops).notifications().count() == 0


def test_landed_log_is_pruned(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    op_log.write_ops(event_ops(spark, SF), folder, bucket=10)
    ops = op_log.read_ops(spark, folder)
    part = op_log.scan_ops(ops, 15, 34)
    assert part.count() == 200 and op_log.scan_ops(ops, 0, 99).count() == 1000
    assert preload_state(ops, Catalog.default(), 0, 99).count() == 53
    plan = part.where("op_type_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "bucket_last" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "IsNotNull(op_type_id)" in plan.split("PushedFilters:")[1]


def test_every_documented_type_parses(make_ops, spark):
    assert len(schemas.OPERATIONS) == 37
    ops = make_ops([
        (1, 9, {"fee": {"amount": "3000", "precision": 3, "nai": "@@000000021"}, "creator": "w",
                "new_account_name": "ouchi", "owner": {"weight_threshold": 1, "account_auths": [],
                "key_auths": [["STM", 1]]}}),
        (1, 45, {"voter": "leo", "proposal_ids": [174], "approve": True, "extensions": []}),
        (1, 6, "broken"),
    ])
    created = op_log.typed_ops(ops, 9).first()
    assert created["fee"]["amount"] == "3000" and created["owner"]["key_auths"] == [["STM", "1"]]
    assert op_log.typed_ops(ops, 45).first()["proposal_ids"] == [174]
    assert op_log.typed_ops(ops, 6).first()["owner"] is None
    for op_type in schemas.OPERATIONS:
        assert "op_name" in op_log.typed_ops(ops, op_type).columns


def test_range_split(spark):
    def split(first, last, size):
        ranges = op_log.block_ranges(spark, first, last, size).orderBy("range_first")
        blocks = spark.range(first, last + 1).select(
            op_log.range_of_block(F.col("id"), first, size).alias("r")).distinct()
        found = [tuple(r) for r in ranges.collect()]
        assert sorted(r["r"] for r in blocks.collect()) == [a for a, _ in found]
        return found

    assert split(0, 10, 4) == [(0, 4), (5, 8), (9, 10)]
    assert split(0, 8, 4) == [(0, 4), (5, 8)]
    assert split(3, 5, 10) == [(3, 5)]


def test_batch_job_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for way in ("new", "again"):
        plan = AlertPlan(event_ops(spark, SF), transactions=event_transactions(spark, SF))
        run_batch(plan, f"{folder}/{way}")
        written = AlertStore(spark, f"{folder}/{way}").notifications()
        files = written.withColumn("file", F.input_file_name()).groupBy("created_date").agg(
            F.count_distinct("file").alias("n"))
        assert {r["n"] for r in files.collect()} == {1}
        assert written.count() == 640
        assert written.where("trx_id IS NULL").select("notif_code").distinct().count() > 0
        plan_text = retained_notifications(written, "2024-02-10 00:00:00")._jdf.queryExecution()
        assert "created_date" in plan_text.executedPlan().toString().split("PartitionFilters:")[1]


def test_preload_equals_state_at_that_block(spark, make_ops):
    ops = make_ops([
        (1, 18, enabled("alice", {"currency": []})), (2, 18, enabled("alice", {"social": ["vot"]})),
        (3, 18, preference("alice", [[1, "a"], "options", {"currency": {"trn": {"min_hbd": 2}}}])),
        (4, 18, enabled("alice", {"currency": ["trn"]})), (9, 2, transfer("alice")),
        (9, 2, transfer("alice", raw="5000")),
    ])
    state = preload_state(ops, Catalog.default(), 1, 3)
    rest = op_log.scan_ops(ops, 4, 9)
    whole = AlertPlan(ops).notifications().select("notif_key").collect()
    parts = AlertPlan(rest, snapshot=state).notifications().select("notif_key").collect()
    assert sorted(whole) == sorted(parts) and len(whole) == 1


def test_verification(spark, make_ops):
    rows = spark.createDataFrame(
        [("a", None, None), ("b", None, None), ("c", None, True), ("d", None, None)],
        "notif_key string, trx_id binary, verified boolean")
    answers = spark.createDataFrame(
        [("a", True), ("a", True), ("b", None), ("c", False), ("d", True), ("d", False)],
        "notif_key string, answer boolean")
    assert pending_verifications(rows).count() == 3
    answered = apply_verifications(rows, answers).collect()
    assert len(answered) == 4
    assert {r["notif_key"]: r["verified"] for r in answered} == {
        "a": True, "b": None, "c": True, "d": False}


def test_retention(spark):
    blocks = spark.createDataFrame([(1,), (50,), (51,)], schemas.BLOCKS)
    assert [r[0] for r in retained_blocks(blocks, 864_050).collect()] == [51]


def test_status_and_health(spark, make_ops):
    ops = make_ops([(100, 2, transfer("alice"))])
    now = "2024-01-01 00:05:00"
    status = system_status(ops, now)
    verdict = lambda *args: health(*args).first()["health"]
    assert verdict(status, 130, "2024-01-01 00:06:00") == "GOOD"
    assert verdict(status, 131, now) == "BAD - 31 blocks behind... "
    assert verdict(status, 130, "2024-01-01 00:06:01") == "BAD - 61.0 seconds behind..."
    assert verdict(system_status(ops.where("false"), now), 5, now) == "BAD - System not ready."
    loading = system_status(ops, now, preload_range=(1, 201))
    assert verdict(loading, 130, now) == "BAD - State not preloaded."
    assert loading.first()["state_preload_progress"] == 50.0
    assert loading.first()["state_preload_progress_text"] == "50.00%"
    assert not sync_allowed(loading).first()["allowed"] and sync_allowed(status).first()["allowed"]
    assert op_log.start_block(1_000_000) == 798_400


def test_request_checks():
    catalog = Catalog.default()
    assert ask.check_account("@alice") == "alice" and ask.check_limit(900) == 50
    assert ask.check_date("2024-01-01T00:00:00") == "2024-01-01 00:00:00"
    for bad in (lambda: ask.check_account("alice"), lambda: ask.check_account("@a"),
                lambda: ask.check_module(catalog, "core"), lambda: ask.check_code("abcd"),
                lambda: ask.check_currency("EUR"), lambda: ask.check_limit("5"),
                lambda: ask.pairs_from_text(["currency"])):
        with pytest.raises(ValueError):
            bad()


def test_account_questions(spark, make_ops):
    ops = make_ops([(block, 2, transfer("alice", "bobby", str(1000 * block))) for block in range(1, 9)])
    notes = AlertPlan(ops).notifications()
    newest = ask.latest_notifications(notes, "alice", limit=2).orderBy("rank").collect()
    assert [r["remark"].split()[3] for r in newest] == ["8", "7"]
    assert ask.latest_notifications(notes, "alice", limit=0, op_data=True).count() == 8
    assert "payload" in ask.latest_notifications(notes, op_data=True).columns
    assert ask.notifications_of_pairs(notes, []).count() == 0
    accounts = spark.createDataFrame(
        [("alice", {"all": "2024-01-01 00:00:12"})], "account string, last_reads map<string,string>")
    as_of = "2024-01-02 00:00:00"
    assert ask.unread_counts(notes, accounts).first()["unread"] == 4
    pick = lambda **how: ask.transfers(notes, accounts, as_of, **how).count()
    assert pick() == 8 and pick(limit=0) == 0 and pick(sender="bobby") == 8 and pick(sender="nobody") == 0
    assert pick(currency="HIVE") == 0 and pick(min_amount=2000, max_amount=3000) == 2
    assert pick(min_amount=0) == 8 and pick(min_date="2024-01-01 00:00:24") == 1
    # Every question checks what it is asked.
    assert pick(limit=900) == 8 and ask.latest_notifications(notes, "@alice", limit=900).count() == 8
    for bad in (lambda: pick(limit="5"), lambda: pick(sender="Bob"), lambda: pick(currency="EUR"),
                lambda: pick(account="x"), lambda: ask.latest_notifications(notes, "@x"),
                lambda: ask.latest_notifications(notes, module="core"),
                lambda: ask.latest_notifications(notes, code="abcd"),
                lambda: ask.votes(notes, accounts, as_of, account="UPPER"),
                lambda: ask.token_transfers(notes, accounts, as_of, limit=None),
                lambda: ask.preferences(accounts, "no"), lambda: ask.options(accounts, "no"),
                lambda: ask.enabled_pairs(accounts, "@"), lambda: ask.unread_count(notes, accounts, "")):
        with pytest.raises(ValueError):
            bad()
    # The window over accounts is cut to the limit before its shuffle.
    plan = ask.latest_notifications(notes, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert notes.where(F.col("trx_id").isNotNull()).count() == 0
