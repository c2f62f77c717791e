"""Every operator as a query over the given tables (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from chainalerts import schemas
from chainalerts.functions.text import (
    amount_text, float_text, mentioned_names, percent_text, text, timestamp_text,
    valid_account_name,
)
from chainalerts.operators import hooks as rules
from chainalerts.operators.accounts import (
    current_accounts, discover, read_marks, with_read_marks,
)
from chainalerts.operators.handlers import (
    only_if, profile_link, recipient, register_handler,
)
from chainalerts.operators.hooks import Catalog, dispatch
from chainalerts.operators.preferences import (
    OPTION_DOCUMENT, option_history, pref_history, preference_log,
)
from chainalerts.operators.retention import retained_blocks, retained_notifications
from chainalerts.operators.verification import apply_verifications, pending_verifications
from chainalerts.plans import account_queries as ask
from chainalerts.plans import status as state
from chainalerts.plans.jobs import preload_state
from chainalerts.plans.notifications import AlertPlan, candidates
from chainalerts.plans.store import AlertStore, run_batch
from chainalerts.sources import block_source, op_log
from chainalerts.sources.colocated import ColocatedLog
from chainalerts.sources.event_log import (
    blocks_from_events, documented_ops_from_events, event_ops, event_transactions, events,
    read_mark_ops,
)
from chainalerts.sources.shredded import read_shredded, write_shredded
from chainalerts.sources.sinks import Staging, shared_folder, staging, write_text
from chainalerts.streaming.keyed_state import KeyedAlertStream
from chainalerts.streaming.sync import AlertStream, expire, publish_range, read_output

LAST_BLOCK = 2**31 - 1
AMOUNT_TYPE = "struct<amount:string,precision:int,nai:string>"
AS_OF = "2024-02-10 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(name: str):
    def add(function: Query) -> Query:
        _queries[name] = function
        return function

    return add


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def _joined(codes) -> F.Column:
    return F.array_join(F.array_sort(codes), ",")


def _colocated(spark, sf_dir) -> ColocatedLog:
    """The log and its transactions, landed in the same buckets."""
    log = ColocatedLog(spark, f"{shared_folder(spark)}/colocated-{uuid.uuid4().hex}", buckets=8, block_bucket=2000)
    log.land(event_ops(spark, sf_dir), event_transactions(spark, sf_dir))
    return log


def _shredded(spark, ops: DataFrame) -> DataFrame:
    """A log landed as shredded VARIANT, read back."""
    path = f"{shared_folder(spark)}/shredded-{uuid.uuid4().hex}"
    write_shredded(ops, path, bucket=2000)
    return read_shredded(spark, path)


def _long(*names: str) -> list:
    return [F.col(name).cast("bigint").alias(name) for name in names]


def _plan(spark, sf_dir, **options) -> AlertPlan:
    return AlertPlan(
        event_ops(spark, sf_dir), transactions=event_transactions(spark, sf_dir), **options
    )


def _staged(plan: AlertPlan) -> AlertPlan:
    """The plan over candidates and preference operations that are in the shared folder."""
    return plan.staged(Staging(plan.ops.sparkSession))


def _all_codes_state(spark, sf_dir, module: str) -> DataFrame:
    """Accounts that switched a module on before the log begins."""
    users = events(spark, sf_dir).select(
        F.concat(F.lit("u"), (F.col("user_id") + 1000).cast("string")).alias("account")
    ).distinct()
    return users.select(
        "account", F.lit(module).alias("module"), F.array(F.lit("*")).alias("codes"),
        F.lit(None).cast("map<string,map<string,string>>").alias("opts"),
    )


def _token_plan(spark, sf_dir) -> AlertPlan:
    chosen = [item for item in Catalog.default().notifying_hooks()
              if item[1].funct == "sm_token_transfer"]
    return _plan(spark, sf_dir, hooks=chosen, snapshot=_all_codes_state(spark, sf_dir, "splinterlands"))


def _shown(notifications: DataFrame) -> DataFrame:
    return notifications.select(
        "notif_key", *_long("block_num", "op_id", "hook_ord"),
        F.lower(F.hex("trx_id")).alias("trx_id"), "account", "module_name", "notif_code",
        "created", "remark", "link", "verified",
    )


def _accounts(spark, sf_dir, created_at=None) -> DataFrame:
    ops, catalog = event_ops(spark, sf_dir), Catalog.default()
    log = preference_log(ops, catalog)
    named = discover(candidates(ops, catalog, texts=False), log)
    return current_accounts(named, log, catalog, created_at)


# Log ----------------------------------------------------------------------------------

@query("ops_range")
def ops_range(spark, sf_dir):
    ops = op_log.final_ops(op_log.scan_ops(event_ops(spark, sf_dir), 0, LAST_BLOCK), LAST_BLOCK)
    return ops.select(
        *_long("op_id", "op_type_id", "block_num", "trx_in_block"), F.col("ts").alias("created"),
        op_log.operation_family(F.col("op_type_id")).alias("family"),
    )


@query("ops_by_type")
def ops_by_type(spark, sf_dir):
    wanted = sorted({hook.op_id for hook in Catalog.default().hooks})
    picked = op_log.ops_of_types(event_ops(spark, sf_dir), wanted, 0, 2**62)
    return picked.groupBy(*_long("op_type_id")).agg(
        F.count("*").alias("ops"), F.min("op_id").alias("first_op_id"),
        F.max("op_id").alias("last_op_id"),
    )


@query("head_markers")
def head_markers(spark, sf_dir):
    heads = op_log.log_heads(event_ops(spark, sf_dir))
    return heads.select(
        *_long("head_block", "head_op_id"),
        op_log.start_block(F.col("head_block")).cast("bigint").alias("start_block"),
    )


@query("first_ops_of_blocks")
def first_ops_of_blocks(spark, sf_dir):
    return op_log.first_op_of_blocks(event_ops(spark, sf_dir)).select(
        *_long("block_num", "first_op_id")
    )


@query("typed_ops")
def typed_ops(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    fields = {
        1: ("author", None), 2: ("to", "amount"), 18: ("id", None),
        40: ("delegatee", "vesting_shares"), 50: ("owner", "amount_in"),
        51: ("author", "vesting_payout"), 52: ("curator", "reward"),
        63: ("benefactor", "hbd_payout"), 72: ("voter", "pending_payout"),
    }
    return op_log.documented_ops(ops, fields).select("op_id", "op_name", "actor", "amount")


@query("typed_ops_documented")
def typed_ops_documented(spark, sf_dir):
    """Every documented operation type, in one scan."""
    return _documented(documented_ops_from_events(events(spark, sf_dir)))


@query("typed_ops_shredded")
def typed_ops_shredded(spark, sf_dir):
    """The same of a log whose bodies are landed as shredded VARIANT."""
    return _documented(_shredded(spark, documented_ops_from_events(events(spark, sf_dir))))


def _documented(ops: DataFrame) -> DataFrame:
    shown = {
        op: (next((f.name for f in fields if f.dataType == StringType()), fields.names[0]),
             next((f.name for f in fields if f.dataType.simpleString() == AMOUNT_TYPE), None))
        for op, fields in (
            (op, StructType.fromDDL(ddl)) for op, (_, ddl) in schemas.OPERATIONS.items())
    }
    return op_log.documented_ops(ops, shown).select("op_id", "op_name", "n_fields", "actor", "amount")


@query("landed_range")
def landed_range(spark, sf_dir):
    """A middle range of a log landed in buckets far smaller than the default."""
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    op_log.write_ops(event_ops(spark, sf_dir), folder, bucket=37)
    picked = op_log.scan_ops(op_log.read_ops(spark, folder), 20, 61)
    return picked.select(*_long("op_id", "block_num"), F.col("ts").alias("created"))


@query("ops_with_trx")
def ops_with_trx(spark, sf_dir):
    joined = op_log.with_transactions(
        event_ops(spark, sf_dir).drop("body"), event_transactions(spark, sf_dir)
    )
    return joined.select(
        *_long("op_id", "block_num"), F.lower(F.hex("trx_hash")).alias("trx_hash")
    )


@query("ops_with_trx_colocated")
def ops_with_trx_colocated(spark, sf_dir):
    """A block range of both logs, joined bucket by bucket."""
    joined = _colocated(spark, sf_dir).joined(20, 61)
    return joined.select(*_long("op_id", "block_num"), F.lower(F.hex("trx_hash")).alias("trx_hash"))


@query("range_split")
def range_split(spark, sf_dir):
    """Block ranges of the whole log with the operations each of them holds."""
    return _range_split(event_ops(spark, sf_dir))


@query("range_split_late")
def range_split_late(spark, sf_dir):
    """The same of a log that begins at block 57."""
    return _range_split(op_log.scan_ops(event_ops(spark, sf_dir), 57, LAST_BLOCK))


def _range_split(ops: DataFrame, size: int = 100) -> DataFrame:
    ops = ops.select("block_num")
    first, last = ops.agg(F.min("block_num"), F.max("block_num")).first()
    ranges = op_log.block_ranges(ops.sparkSession, first, last, size)
    # A block's range follows from its number, so the counts need no range join.
    counts = ops.groupBy(
        op_log.range_of_block(F.col("block_num"), first, size).alias("range_first")
    ).agg(F.count("*").alias("ops"))
    return ranges.join(counts, "range_first", "left").select(
        "range_first", "range_last", F.coalesce("ops", F.lit(0).cast("bigint")).alias("ops")
    )


# Rules --------------------------------------------------------------------------------

def _dispatched(spark, sf_dir, catalog) -> DataFrame:
    values = op_log.parse_values(event_ops(spark, sf_dir))
    return dispatch(values, catalog, catalog.enabled_hooks())


@query("hook_registry")
def hook_registry(spark, sf_dir):
    """Stored hooks after an update of one, with the operations of each hook's type."""
    catalog = Catalog.default()
    update = catalog.register({"currency": {
        "enabled": True, "module_category": "Other",
        "deleg": {"op_id": 40, "description": "Delegations to you", "function": "core_deleg",
                  "notif_code": "del", "filter": "", "options": {}},
    }})
    stored = rules.upsert_hooks(
        catalog.hooks_frame(spark),
        update.hooks_frame(spark).where(F.col("notif_name") == "deleg"),
    )
    counts = event_ops(spark, sf_dir).groupBy("op_type_id").agg(F.count("*").alias("ops"))
    return (
        rules.hooks_with_category(stored, update.modules_frame(spark))
        .join(counts, F.col("op_id") == F.col("op_type_id"), "left")
        .select("module", "notif_name", "notif_code", "description", "module_category",
                *_long("op_id", "ops"))
    )


@query("hook_dispatch")
def hook_dispatch(spark, sf_dir):
    return _dispatched(spark, sf_dir, Catalog.default()).select(
        *_long("op_id", "hook_ord"), "module", "notif_name", "notif_code"
    )


@query("hooks_from_files")
def hooks_from_files(spark, sf_dir):
    """Dispatch by a catalog read from rule files, one per module."""
    folder = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    for module, entries in rules.RULES.items():
        write_text(spark, f"{folder}/{module}/hooks.json", json.dumps(entries))
    write_text(spark, f"{folder}/Not-A-Module/hooks.json", "{}")
    return _dispatched(spark, sf_dir, Catalog.read(spark, folder)).select(
        *_long("op_id", "hook_ord"), "module", "notif_name", "notif_code"
    )


@query("hook_dispatch_disabled")
def hook_dispatch_disabled(spark, sf_dir):
    catalog = Catalog.default().set_enabled("social", False)
    return _dispatched(spark, sf_dir, catalog).select(
        *_long("op_id", "hook_ord"), "module", "notif_name", "notif_code"
    )


@query("hook_filter")
def hook_filter(spark, sf_dir):
    filtered = {}
    for module, entries in rules.RULES.items():
        filtered[module] = {
            name: entry | {"filter": {
                "gns": {"id": "gns"}, "vote": {"weight": "50", "total_vote_weight": "100"},
                "sm_token_transfer": {"id": "sm_token_transfer"},
            }.get(name, "")} if isinstance(entry, dict) else entry
            for name, entry in entries.items()
        }
    return _dispatched(spark, sf_dir, Catalog.default().register(filtered)).select(
        *_long("op_id"), "module", "notif_name"
    )


@query("hook_filter_many")
def hook_filter_many(spark, sf_dir):
    """Ten thousand filtered hooks: one for each recipient, every other of them for one sender."""
    entries = {
        f"to_{n:05d}": {
            "op_id": 2, "description": "Transfers to one", "function": "core_transfer",
            "notif_code": "one", "options": {},
            "filter": {"to": f"u{1000 + n}"} | ({"from": f"u{1001 + n + n % 100}"} if n % 2 else {}),
        } for n in range(10_000)
    }
    wide = {"wide": {"enabled": True, "module_category": "Wide"} | entries}
    return _dispatched(spark, sf_dir, Catalog.default().register(wide)).where(
        F.col("op_type_id") == 2).select(*_long("op_id"), "module", "notif_name")


@query("field_filter")
def field_filter(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    by_id = op_log.filter_operations(ops, 0, LAST_BLOCK, {"id": "gns"})
    by_sender = op_log.filter_operations(ops, 0, LAST_BLOCK, {"to": "u1005"})
    return by_id.select("op_id", F.lit("id").alias("kind")).unionByName(
        by_sender.select("op_id", F.lit("to").alias("kind"))
    )


@query("module_catalog")
def module_catalog(spark, sf_dir):
    """Catalog entries per module with the operations its hooks match."""
    catalog = Catalog.default()
    counts = _dispatched(spark, sf_dir, catalog).groupBy("module").agg(
        F.count("*").alias("matches")
    )
    entries = rules.module_catalog(catalog.hooks_frame(spark), catalog.modules_frame(spark))
    text = F.transform("entries", lambda e: F.concat_ws(
        "|", e["module_category"], e["description"], e["module"], e["notif_code"]))
    return entries.join(counts, "module", "left").select(
        "module", F.array_join(F.array_sort(text), ";").alias("entries"), "matches"
    )


@query("category_catalog")
def category_catalog(spark, sf_dir):
    """Pairs per category and description with the operations each of them matches."""
    catalog = Catalog.default()
    counts = (
        _dispatched(spark, sf_dir, catalog)
        .groupBy(F.concat_ws(":", "module", "notif_code").alias("pair"))
        .agg(F.count("*").alias("matches"))
    )
    pairs = rules.category_catalog(
        catalog.hooks_frame(spark), catalog.modules_frame(spark)
    ).select("module_category", F.explode("pairs").alias("description", "pair"))
    return pairs.join(counts, "pair", "left").select(
        "module_category", "description", "pair", "matches"
    )


@query("hook_options")
def hook_options(spark, sf_dir):
    """Declared options of a hook, and how often accounts set each of them."""
    catalog = Catalog.default()
    declared = rules.hook_options(catalog.hooks_frame(spark), "currency", "trn").select(
        F.explode("options").alias("option_name", "option_type")
    )
    log = preference_log(event_ops(spark, sf_dir), catalog)
    used = (
        option_history(log)
        .select(F.explode(F.from_json("options", OPTION_DOCUMENT)["currency"]["trn"])
                .alias("option_name", "value"))
        .groupBy("option_name").agg(F.count("*").alias("times_set"))
    )
    return declared.join(used, "option_name", "left").select(
        "option_name", "option_type", "times_set"
    )


# Account state ------------------------------------------------------------------------

@query("pref_ops_valid")
def pref_ops_valid(spark, sf_dir):
    log = preference_log(event_ops(spark, sf_dir), Catalog.default())
    return log.select(*_long("op_id"), "account", "op_name", "valid", "effective", "outcome")


@query("pref_history")
def pref_history_query(spark, sf_dir):
    log = preference_log(event_ops(spark, sf_dir), Catalog.default())
    return pref_history(log).select(
        "account", "module", _joined("codes").alias("codes"), "created",
        *_long("block_num", "op_id"),
    )


@query("option_history")
def option_history_query(spark, sf_dir):
    log = preference_log(event_ops(spark, sf_dir), Catalog.default())
    limits = F.from_json("options", OPTION_DOCUMENT)["currency"]["trn"]
    return option_history(log).select(
        "account", limits["min_hbd"].cast("decimal(10,1)").alias("min_hbd"),
        limits["min_hive"].cast("decimal(10,1)").alias("min_hive"), "created",
        *_long("block_num", "op_id"),
    )


@query("accounts_discovered")
def accounts_discovered(spark, sf_dir):
    ops, catalog = event_ops(spark, sf_dir), Catalog.default()
    found = discover(candidates(ops, catalog, texts=False), preference_log(ops, catalog))
    return found.select("account", "first_seen", *_long("first_block", "first_op_id"))


@query("accounts_current")
def accounts_current(spark, sf_dir):
    shown = F.transform(
        F.array_sort(F.map_entries("prefs")),
        lambda e: F.concat(e["key"], F.lit(":"), _joined(e["value"])),
    )
    limits = F.from_json("options", OPTION_DOCUMENT)["currency"]["trn"]
    return _accounts(spark, sf_dir).select(
        "account", F.col("last_reads")["all"].cast("timestamp_ntz").alias("read_all"),
        F.array_join(shown, ";").alias("prefs"),
        limits["min_hbd"].cast("decimal(10,1)").alias("min_hbd"),
        "prefs_updated", "options_updated",
    )


@query("state_preload")
def state_preload(spark, sf_dir):
    return _preloaded(event_ops(spark, sf_dir), Catalog.default())


@query("preload_core_off")
def preload_core_off(spark, sf_dir):
    """A preload does not look at the flag of the module whose hook it replays."""
    return _preloaded(event_ops(spark, sf_dir), Catalog.default().set_enabled("core", False))


@query("state_preload_escaped")
def state_preload_escaped(spark, sf_dir):
    """The same log with the preference id written with an escape in every other body."""
    escaped = F.regexp_replace("body", '"gns"', r'"\\u0067ns"')
    ops = event_ops(spark, sf_dir).withColumn(
        "body", F.when(F.col("op_id") % 2 == 0, escaped).otherwise(F.col("body"))
    )
    return _preloaded(ops, Catalog.default())


def _preloaded(ops: DataFrame, catalog: Catalog) -> DataFrame:
    left = preload_state(ops, catalog, 0, LAST_BLOCK)
    return left.select(
        "account", "module", _joined("codes").alias("codes"),
        F.col("opts").isNotNull().alias("has_options"),
        F.col("opts")["trn"]["min_hbd"].cast("decimal(10,1)").alias("min_hbd"),
    )


@query("asof_prefs")
def asof_prefs(spark, sf_dir):
    """The state every candidate met, by the shuffled as-of lookup."""
    resolved = _plan(spark, sf_dir).resolved()
    return resolved.select(
        *_long("op_id", "hook_ord"), "account", "gate_account", "subscribed",
        F.col("opts")["trn"]["min_hbd"].cast("decimal(10,1)").alias("min_hbd"), "passes",
    )


# Notifications ------------------------------------------------------------------------

def _handler_query(name: str, function: str) -> None:
    @query(name)
    def run(spark, sf_dir):
        chosen = [item for item in Catalog.default().notifying_hooks()
                  if item[1].funct == function]
        return _shown(_plan(spark, sf_dir, hooks=chosen).notifications())


for _name, _function in {
    "notif_transfer": "core_transfer", "notif_delegation": "core_deleg",
    "notif_author_reward": "core_author_reward",
    "notif_benefactor_reward": "core_comment_benefactor_reward",
    "notif_curation_reward": "core_curation_reward",
    "notif_convert": "core_fill_convert_request", "notif_vote": "core_vote",
    "notif_comment": "core_comment", "notif_mention": "core_mention",
}.items():
    _handler_query(_name, _function)


@query("notif_token_transfer")
def notif_token_transfer(spark, sf_dir):
    return _shown(_token_plan(spark, sf_dir).notifications())


@query("notifications_all")
def notifications_all(spark, sf_dir):
    return _shown(_plan(spark, sf_dir).notifications())


@query("notifications_shuffled")
def notifications_shuffled(spark, sf_dir):
    """The same rows with small buckets of the as-of lookup, so that much is carried."""
    return _shown(_staged(_plan(spark, sf_dir, bucket_ops=500)).notifications())


@query("notifications_written")
def notifications_written(spark, sf_dir):
    """The batch job's output, read back from its day directories."""
    folder = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    run_batch(_plan(spark, sf_dir), folder)
    return _shown(AlertStore(spark, folder).notifications())


def _stored(spark, ops: DataFrame, ranges: int = 2, **options) -> AlertStore:
    """A store to which the log was committed in block ranges, each of them run twice, after
    an attempt that wrote its notifications and died."""
    store = AlertStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    last = _last_block(ops)
    for n in range(ranges):
        blocks = (last * n // ranges + (n > 0), last * (n + 1) // ranges)
        part = op_log.scan_ops(ops, *blocks)
        with staging(spark) as stage:
            dead = AlertPlan(part, **options).staged(stage).notifications()
            store.log.write("notifications", dead, by_day=True)
        for _ in range(2):
            run_batch(AlertPlan(part, **options), store.log.path, blocks)
    return store


@query("notifications_replayed")
def notifications_replayed(spark, sf_dir):
    """Ranges that ran again, and attempts that died between their writes, leave each row once."""
    ops, hashes = event_ops(spark, sf_dir), event_transactions(spark, sf_dir)
    return _shown(_stored(spark, ops, transactions=hashes).notifications())


@query("rejects_replayed")
def rejects_replayed(spark, sf_dir):
    """Rejects are committed with their range."""
    found = _stored(spark, faulty_ops(event_ops(spark, sf_dir))).rejects()
    return found.select(*_long("block_num", "op_id"), "notif_name", "account", "reason")


@query("accounts_stored")
def accounts_stored(spark, sf_dir):
    """The account set, to which each range adds those that it refers to first."""
    found = _stored(spark, event_ops(spark, sf_dir), ranges=3).accounts()
    return found.select("account", "first_seen", *_long("first_block", "first_op_id"))


@query("unread_counts_stored")
def unread_counts_stored(spark, sf_dir):
    """Unread counts from the kept counts of days and one day of notifications per account."""
    store = _stored(spark, event_ops(spark, sf_dir))
    store.compact()
    oldest = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return store.unread_counts(store.accounts(), oldest)


def faulty_ops(ops: DataFrame) -> DataFrame:
    """A log in which some recipients are too long and some preference payloads broken."""
    long_name = F.regexp_replace("body", '"to":"u', '"to":"' + "u" * 20)
    broken = F.regexp_replace("body", r'"json":"\[\[', '"json":"[[[')
    return ops.withColumn(
        "body", F.when((F.col("op_type_id") == 2) & (F.col("op_id") % 7 == 3), long_name)
        .when((F.col("op_type_id") == 18) & (F.col("op_id") % 10 == 0), broken)
        .otherwise(F.col("body"))
    )


@query("rejects")
def rejects(spark, sf_dir):
    plan = _staged(AlertPlan(faulty_ops(event_ops(spark, sf_dir))))
    return plan.rejects().select(*_long("block_num", "op_id"), "notif_name", "account", "reason")


def strong_vote(semantics: str) -> str:
    """A handler of a user's own: the voter, for weights from 90 on, by the author's gate."""
    row = recipient(
        "v['voter']", text("'you voted with '", "v['weight']"), profile_link("v['author']"),
        gate_account="v['author']",
    )
    return only_if("coalesce(try_cast(v['weight'] AS INT) >= 90, false)", row)


@query("custom_handler")
def custom_handler(spark, sf_dir):
    register_handler("strong_vote", strong_vote)
    catalog = Catalog.default().register({"custom": {
        "enabled": True, "module_category": "Custom",
        "strong": {"op_id": 72, "description": "Strong votes", "function": "custom.strong_vote",
                   "notif_code": "str", "filter": "", "options": {}},
    }})
    chosen = [item for item in catalog.notifying_hooks() if item[1].module == "custom"]
    plan = _plan(spark, sf_dir, catalog=catalog, hooks=chosen,
                 snapshot=_all_codes_state(spark, sf_dir, "custom"))
    return _shown(plan.notifications())


STRONG_VOTE = {
    "enabled": True, "module_category": "Custom",
    "strong": {"op_id": 72, "description": "Strong votes", "function": "custom.strong_vote",
               "notif_code": "str", "filter": "", "options": {}},
}


def _of_rule_file(spark, sf_dir, module: str, rule: dict) -> DataFrame:
    """What the hooks of a rule file lead to, for accounts that have its module on."""
    folder = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    write_text(spark, f"{folder}/{module}/hooks.json", json.dumps(rule))
    catalog = Catalog.default().merged(Catalog.read(spark, folder))
    chosen = [item for item in catalog.notifying_hooks() if item[1].module == module]
    plan = _plan(spark, sf_dir, catalog=catalog, hooks=chosen,
                 snapshot=_all_codes_state(spark, sf_dir, module))
    return _shown(plan.notifications())


@query("handler_sql_file")
def handler_sql_file(spark, sf_dir):
    """A rule file whose hook brings its handler along as SQL."""
    sql = {
        "where": "try_cast(v['weight'] AS INT) >= 90", "account": "v['voter']", "gate_account": "v['author']",
        "remark": "concat('you voted with ', v['weight'])", "link": "concat('https://hive.blog/@', v['author'])",
    }
    return _of_rule_file(spark, sf_dir, "custom", STRONG_VOTE | {"strong": STRONG_VOTE["strong"] | {"sql": sql}})


@query("handler_sql_function")
def handler_sql_function(spark, sf_dir):
    """A rule file whose hook names an SQL function: voter and author of a strong vote."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION strong_vote_ends(v MAP<STRING,STRING>)
        RETURNS ARRAY<STRUCT<account: STRING, remark: STRING, link: STRING>>
        RETURN IF(try_cast(v['weight'] AS INT) >= 90, array(
            named_struct('account', v['voter'], 'remark', concat('given to ', v['author']), 'link', v['weight']),
            named_struct('account', v['author'], 'remark', concat('got from ', v['voter']), 'link', v['weight'])), NULL)""")
    hook = STRONG_VOTE["strong"] | {"function": "custom.strong_vote_ends"}
    return _of_rule_file(spark, sf_dir, "custom", STRONG_VOTE | {"strong": hook})


@query("notifications_colocated")
def notifications_colocated(spark, sf_dir):
    """A log that lies in the same buckets as its transactions: hashes are joined in place."""
    return _shown(_staged(_colocated(spark, sf_dir).alert_plan(0, LAST_BLOCK)).notifications())


@query("notifications_shredded")
def notifications_shredded(spark, sf_dir):
    """A log whose bodies are landed as shredded VARIANT: the plan reads columns of the fields its rules name."""
    ops = _shredded(spark, event_ops(spark, sf_dir))
    return _shown(_staged(AlertPlan(ops, transactions=event_transactions(spark, sf_dir))).notifications())


@query("notifications_fixed")
def notifications_fixed(spark, sf_dir):
    """Corrected semantics: conversion labels and the recipient of a reply."""
    return _shown(_plan(spark, sf_dir, semantics="fixed").notifications())


@query("mentions_documents")
def mentions_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", F.explode(F.expr(mentioned_names("text"))).alias("name"))


@query("notif_retained")
def notif_retained(spark, sf_dir):
    return _shown(retained_notifications(_plan(spark, sf_dir).notifications(), AS_OF))


@query("blocks_retained")
def blocks_retained(spark, sf_dir):
    kept = retained_blocks(blocks_from_events(events(spark, sf_dir)), 864_000 + 50)
    return kept.select(*_long("num"))


@query("verification_pending")
def verification_pending(spark, sf_dir):
    return pending_verifications(_token_plan(spark, sf_dir).notifications()).select(
        "notif_key", F.lower(F.hex("trx_id")).alias("trx_id")
    )


@query("verification_applied")
def verification_applied(spark, sf_dir):
    rows = _token_plan(spark, sf_dir).notifications()
    rest = F.col("op_id") % 3
    answers = pending_verifications(rows).withColumn(
        "op_id", F.split("notif_key", ":")[1].cast("bigint")
    ).select("notif_key", F.when(rest < 2, rest == 0).alias("answer"))
    return apply_verifications(rows, answers).select("notif_key", "account", "verified")


@query("verification_stored")
def verification_stored(spark, sf_dir):
    """Answers that change stored rows: a round merged on reading, written into its days, and
    one more round after that; a round that comes again changes nothing."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    run_batch(_token_plan(spark, sf_dir), folder)
    store = AlertStore(spark, folder)
    rest = F.split("notif_key", ":")[1].cast("bigint") % 3
    for number in (0, 1):
        pending = pending_verifications(store.notifications())
        answers = pending.select("notif_key", F.when(rest == number, rest == 0).alias("answer"))
        store.settle(answers, number)
        store.settle(pending.select("notif_key", F.lit(False).alias("answer")), number)
        if number == 0:
            store.compact()
    return store.notifications().select("notif_key", "account", "verified")


@query("verification_repeated")
def verification_repeated(spark, sf_dir):
    """Answers that come several times: equal ones, and ones that disagree."""
    rows = _token_plan(spark, sf_dir).notifications()
    rest = F.split("notif_key", ":")[1].cast("bigint") % 3
    pending = pending_verifications(rows)
    answers = pending.select("notif_key", F.explode(
        F.when(rest == 0, F.array(F.lit(True), F.lit(True)))
        .when(rest == 1, F.array(F.lit(True), F.lit(False)))
        .otherwise(F.array(F.lit(None).cast("boolean"), F.lit(True)))
    ).alias("answer"))
    return apply_verifications(rows, answers).select("notif_key", "account", "verified")


# Account questions --------------------------------------------------------------------

def _answers(plan: AlertPlan, created_at=None) -> tuple[DataFrame, DataFrame]:
    """Notifications and accounts of a log that is read twice: once for the candidates, once for
    the preference operations. What follows reads those from the shared folder."""
    stage = Staging(plan.ops.sparkSession)
    plan.staged(stage)
    everyone = stage(candidates(plan.ops, plan.catalog, texts=False), "everyone") if plan.hooks else plan.candidates()
    found = discover(everyone, plan.preference_log())
    return plan.notifications(), current_accounts(found, plan.preference_log(), plan.catalog, created_at)


def _ranked(frame: DataFrame) -> DataFrame:
    return frame.select(*_long("rank"), "account", "created", "remark", "link")


@query("latest_notifications")
def latest_notifications(spark, sf_dir):
    return _ranked(ask.latest_notifications(_plan(spark, sf_dir).notifications()))


@query("notifications_by_pairs")
def notifications_by_pairs(spark, sf_dir):
    pairs = ask.pairs_from_text(["currency:trn", "social:com"])
    return _ranked(ask.notifications_of_pairs(_plan(spark, sf_dir).notifications(), pairs))


@query("notifications_by_category")
def notifications_by_category(spark, sf_dir):
    return _ranked(ask.notifications_of_category(
        _plan(spark, sf_dir).notifications(), Catalog.default(), "Social", limit=5
    ))


@query("transfers_filtered")
def transfers_filtered(spark, sf_dir):
    return _ranked(ask.transfers(
        *_answers(_plan(spark, sf_dir)), AS_OF,
        currency="HBD", min_amount=5_000, max_amount=400_000,
        min_date="2024-01-05 00:00:00", max_date="2024-01-29 00:00:00",
    ))


@query("votes_filtered")
def votes_filtered(spark, sf_dir):
    return _ranked(ask.votes(
        *_answers(_plan(spark, sf_dir)), AS_OF,
        min_date="2024-01-12 00:00:00", max_date="2024-01-28 12:00:00",
    ))


@query("token_transfers_filtered")
def token_transfers_filtered(spark, sf_dir):
    return _ranked(ask.token_transfers(
        *_answers(_token_plan(spark, sf_dir)), AS_OF,
        token="DEC", min_amount=5.0, max_amount=100.0,
    ))


@query("unread_counts")
def unread_counts(spark, sf_dir):
    return ask.unread_counts(*_answers(_plan(spark, sf_dir), AS_OF))


def _marked_answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    marks = read_marks(read_mark_ops(events(spark, sf_dir)), Catalog.default())
    notifications, accounts = _answers(_plan(spark, sf_dir), AS_OF)
    return notifications, with_read_marks(accounts, marks)


@query("read_marks")
def read_marks_query(spark, sf_dir):
    found = read_marks(read_mark_ops(events(spark, sf_dir)), Catalog.default())
    return found.select("account", "pair", "read_at")


@query("transfers_unread_by_code")
def transfers_unread_by_code(spark, sf_dir):
    """Transfers after the account's own read mark of that code, where it has one."""
    return _ranked(ask.transfers(*_marked_answers(spark, sf_dir), AS_OF))


@query("unread_counts_marked")
def unread_counts_marked(spark, sf_dir):
    """Unread counts where some accounts have marked all as read."""
    return ask.unread_counts(*_marked_answers(spark, sf_dir))


@query("preferences_module_absent")
def preferences_module_absent(spark, sf_dir):
    """A module that most accounts do not have: all of their preferences instead."""
    own = ask.preferences(_accounts(spark, sf_dir), module="splinterlands")
    shown = F.transform(
        F.array_sort(F.map_entries("all_prefs")),
        lambda e: F.concat(e["key"], F.lit(":"), _joined(e["value"])),
    )
    return own.select("account", _joined("prefs").alias("prefs"), F.array_join(shown, ";").alias("all_prefs"))


@query("preferences")
def preferences(spark, sf_dir):
    own = ask.preferences(_accounts(spark, sf_dir), module="currency")
    return own.select("account", _joined("prefs").alias("prefs"), "prefs_updated")


@query("options")
def options(spark, sf_dir):
    own = ask.options(_accounts(spark, sf_dir), module="currency")
    limits = F.from_json("options", "map<string,map<string,string>>")["trn"]
    return own.select(
        "account", limits["min_hbd"].cast("decimal(10,1)").alias("min_hbd"),
        limits["min_hive"].cast("decimal(10,1)").alias("min_hive"), "options_updated",
    )


@query("enabled_pairs")
def enabled_pairs(spark, sf_dir):
    return ask.enabled_pairs(_accounts(spark, sf_dir))


# Status -------------------------------------------------------------------------------

@query("module_progress")
def module_progress(spark, sf_dir):
    """Progress by the operations each module's hooks were called for."""
    catalog = Catalog.default()
    return state.module_progress(
        _dispatched(spark, sf_dir, catalog), catalog.modules_frame(spark)
    ).select("module", "module_category", "enabled", *_long("latest_op_id", "latest_block_num"))


@query("system_status")
def system_status(spark, sf_dir):
    ops = event_ops(spark, sf_dir)
    status = state.system_status(ops, AS_OF, preload_range=(0, 16_384_000))
    return status.select(
        *_long("block_num", "latest_op_id"), "block_time", "last_updated", "sync_enabled",
        "state_preloaded",
        (F.col("state_preload_progress") * 163_840).cast("decimal(18,4)").alias("progress"),
        F.expr(timestamp_text("block_time")).alias("block_time_text"),
    )


@query("health")
def health(spark, sf_dir):
    status = state.system_status(event_ops(spark, sf_dir), AS_OF)
    # Blocks and seconds behind, and whether the state is loaded, of each case.
    cases = {"preloading": (0, 0, False), "behind": (31, 0, True), "late": (30, 61, True),
             "good": (30, 60, True)}
    status = status.withColumn("given", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(blocks).alias("blocks"),
                 F.lit(seconds).alias("seconds"), F.lit(loaded).alias("loaded"))
        for name, (blocks, seconds, loaded) in cases.items()
    ]))).withColumn("state_preloaded", F.col("given.loaded"))
    time = F.date_trunc("second", "block_time").cast("timestamp_ntz")
    judged = state.health(
        status, F.col("block_num") + F.col("given.blocks"),
        time + F.make_dt_interval(secs=F.col("given.seconds")),
    )
    return judged.select(F.col("given.name").alias("case"), *_long("block_num"), "health")


# Scalar functions ---------------------------------------------------------------------

@query("account_name_valid")
def account_name_valid(spark, sf_dir):
    user = F.concat(F.lit("u"), (F.col("user_id") + 1000).cast("string"))
    forms = F.array(
        user, F.substring(user, 1, 3), F.upper(user), F.concat(F.lit("1"), user),
        F.concat(user, F.lit(".a-b")), F.rpad(user, 17, "x"), F.rpad(user, 18, "x"),
    )
    names = events(spark, sf_dir).select(F.explode(forms).alias("name"))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mentioned = documents.select(F.explode(F.expr(mentioned_names("text"))).alias("name"))
    return names.unionByName(mentioned).distinct().select(
        "name", F.expr(valid_account_name("name")).alias("valid")
    )


@query("formatted_columns")
def formatted_columns(spark, sf_dir):
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("bigint")
    oldest = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return events(spark, sf_dir).withColumn("cents", cents.cast("string")).select(
        "event_id",
        F.expr(timestamp_text("ts")).alias("ts_text"),
        F.expr(percent_text("value")).alias("percent_text"),
        F.expr(amount_text("cents", "1000")).alias("thousandths"),
        F.expr(amount_text("cents", "1000000")).alias("millionths"),
        F.expr(float_text("value")).alias("value_text"),
        F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("ts")), oldest).alias("read_until"),
    )


# Streaming ----------------------------------------------------------------------------

def _stream(spark, sf_dir, folder: str, **options) -> AlertStream:
    return AlertStream(
        f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint",
        transactions=event_transactions(spark, sf_dir), **options,
    )


def _last_block(ops: DataFrame) -> int:
    return ops.agg(F.max("block_num")).first()[0]


@query("stream_notifications")
def stream_notifications(spark, sf_dir):
    """The whole log published in four block ranges and followed as a stream."""
    ops = event_ops(spark, sf_dir)
    last = _last_block(ops)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    size = last // 4 + 1
    for first in range(0, last + 1, size):
        publish_range(ops, f"{folder}/landing", first, first + size - 1, last)
    _stream(spark, sf_dir, folder).start(spark).awaitTermination()
    return _shown(read_output(spark, f"{folder}/out"))


@query("landed_heads")
def landed_heads(spark, sf_dir):
    """Heads of ranges of the log, observed by the write that landed them."""
    ops = event_ops(spark, sf_dir)
    last = _last_block(ops)
    landing, size = f"{shared_folder(spark)}/heads-{uuid.uuid4().hex}", last // 4 + 1
    starts = range(0, last + 1, size)
    for first in starts:
        publish_range(ops, landing, first, first + size - 1, last)
    ends = [(first, min(first + size - 1, last)) for first in starts] + [(0, last)]
    found = [block_source.landed_heads(spark, landing, *blocks) for blocks in ends]
    return spark.createDataFrame(
        [(*blocks, heads["ops"], heads["head_op"], heads["time"]) for blocks, heads in zip(ends, found)],
        "first_block BIGINT, last_block BIGINT, ops BIGINT, head_op_id BIGINT, block_time STRING",
    ).withColumn("block_time", F.col("block_time").cast("timestamp_ntz"))


@query("stream_keyed_state")
def stream_keyed_state(spark, sf_dir):
    """The log followed in three queries that share a checkpoint, with account state in the
    state store; the last blocks are landed while it is off."""
    ops = event_ops(spark, sf_dir)
    last = _last_block(ops)
    folder = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    stream = KeyedAlertStream(f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint",
                              transactions=event_transactions(spark, sf_dir))
    ends = [0, last // 3, last // 2, last]
    for first, end in zip(ends, ends[1:]):
        publish_range(ops, f"{folder}/landing", first + (first > 0), end, last)
        stream.start(spark).awaitTermination()
    return _shown(read_output(spark, f"{folder}/out"))


@query("stream_resumed")
def stream_resumed(spark, sf_dir):
    """Preload, follow, stop, replay a batch, go on with another stream object; blocks that
    are not final yet are never published."""
    ops = event_ops(spark, sf_dir)
    last = _last_block(ops)
    final, loaded = last - 7, last // 3
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = _stream(spark, sf_dir, folder, preload=True, compact_every=2)
    if stream.start(spark) is not None:
        raise RuntimeError("the gate is open before the preload")
    stream.prepare(ops, 0, loaded)
    half = (loaded + last) // 2
    publish_range(ops, f"{folder}/landing", loaded + 1, half, final)
    stream.start(spark).awaitTermination()
    if stream.process(op_log.scan_ops(ops, loaded + 1, half), (loaded + 1, half)):
        raise RuntimeError("a replay was taken for a new range")
    publish_range(ops, f"{folder}/landing", half + 1, last, final)
    again = _stream(spark, sf_dir, folder, preload=True, compact_every=2)
    again.start(spark).awaitTermination()
    return _shown(read_output(spark, f"{folder}/out"))


@query("stream_retained")
def stream_retained(spark, sf_dir):
    """A stream's output after expiry: old days are gone, the oldest day is cut on reading."""
    ops = event_ops(spark, sf_dir)
    last = _last_block(ops)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    publish_range(ops, f"{folder}/landing", 0, last, last)
    _stream(spark, sf_dir, folder).start(spark).awaitTermination()
    expire(spark, f"{folder}/out", AS_OF)
    return _shown(read_output(spark, f"{folder}/out", AS_OF))
