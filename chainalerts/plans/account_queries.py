"""Questions over notifications and accounts.

Every question is asked for all accounts at once; one account is a filter on top. Top-k
is a row number per account, which Spark cuts to k rows before the shuffle, so a hot
account costs no more than any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainalerts.constants import (
    ACCOUNT_PATTERN, ASSET_IDS, MAX_LIMIT, RETENTION_DAYS,
)
from chainalerts.functions.json_values import fenced, first_element, node, value_map
from chainalerts.operators.hooks import Catalog


# Request checks -----------------------------------------------------------------------

def check_account(account: str) -> str:
    """``@name`` -> ``name``."""
    if "@" not in account:
        raise ValueError(f"an account is asked for as @name, not as {account}")
    return check_name(account.replace("@", ""))


def check_name(name: str) -> str:
    if not re.match(ACCOUNT_PATTERN, name):
        raise ValueError(f"invalid account name: {name}")
    return name


def check_module(catalog: Catalog, module: str | None) -> str | None:
    if module and module not in catalog.module_list():
        raise ValueError(f"unknown module: {module}; known: {catalog.module_list()}")
    return module


def check_code(code: str | None) -> str | None:
    if code and len(code) != 3:
        raise ValueError(f"a notification code has three characters, unlike {code}")
    return code


def check_limit(limit: int) -> int:
    if not isinstance(limit, int):
        raise ValueError("limit must be an integer")
    return min(limit, MAX_LIMIT)


def check_currency(currency: str | None) -> str | None:
    if currency and currency not in ASSET_IDS:
        raise ValueError(f"currency invalid; valid options are {sorted(ASSET_IDS)}")
    return currency


def check_sender(sender: str | None) -> str | None:
    return check_name(sender) if sender else sender


def check_date(date: str | None) -> str | None:
    return date.replace("T", " ") if date else date


def _asked(account: str | None, limit: int = MAX_LIMIT) -> tuple[str | None, int]:
    """The account (``@name`` or ``name``) and the limit of a request, checked."""
    if account is not None:
        account = check_account(account) if "@" in account else check_name(account)
    return account, check_limit(limit)


# Shapes -------------------------------------------------------------------------------

def _columns(op_data: bool) -> list[str]:
    return ["account", "created", "remark", "link"] + (["payload"] if op_data else [])


def newest(notifications: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` rows of every account, with their rank."""
    by_account = Window.partitionBy("account").orderBy(
        F.desc("block_num"), F.desc("op_id"), F.desc("hook_ord")
    )
    return notifications.withColumn("rank", F.row_number().over(by_account)).where(
        F.col("rank") <= limit
    )


def _of(frame: DataFrame, account: str | None) -> DataFrame:
    return frame if account is None else frame.where(F.col("account") == account)


def latest_notifications(
    notifications: DataFrame, account: str | None = None, module: str | None = None,
    code: str | None = None, limit: int = MAX_LIMIT, op_data: bool = False,
    catalog: Catalog | None = None,
) -> DataFrame:
    """Newest notifications; ``limit`` 0 gives all of them in no order."""
    account, limit = _asked(account, limit)
    check_module(catalog or Catalog.default(), module)
    check_code(code)
    picked = _of(notifications, account)
    if module:
        picked = picked.where(F.col("module_name") == module)
    if code:
        picked = picked.where(F.col("notif_code") == code)
    if not limit:
        return picked.select(*_columns(op_data))
    return newest(picked, limit).select("rank", *_columns(op_data))


def notifications_of_pairs(
    notifications: DataFrame, pairs: list[tuple[str, str]], account: str | None = None,
    limit: int = MAX_LIMIT, op_data: bool = False,
) -> DataFrame:
    """Newest notifications of the given (module, code) pairs; no pairs, no rows."""
    wanted = F.lit(False)
    for module, code in pairs:
        wanted = wanted | ((F.col("module_name") == module) & (F.col("notif_code") == code))
    return latest_notifications(
        notifications.where(wanted), account, limit=limit, op_data=op_data
    )


def pairs_from_text(pairings: list[str]) -> list[tuple[str, str]]:
    """``module:code`` texts as pairs."""
    split = [pairing.split(":") for pairing in pairings]
    if any(len(parts) < 2 for parts in split):
        raise ValueError("pairings must be an array of module:code texts")
    return [(parts[0], parts[1]) for parts in split]


def notifications_of_category(
    notifications: DataFrame, catalog: Catalog, category: str, **options
) -> DataFrame:
    return notifications_of_pairs(
        notifications, catalog.pairs_of_category(category), **options
    )


def created_after_read(
    notifications: DataFrame, accounts: DataFrame, threshold: Column
) -> DataFrame:
    """Rows created after a per-account threshold; accounts without one have no rows."""
    # Dealt anew, the accounts' side has an exchange of its own: then Spark splits an
    # account that is hot on the other side into as many tasks as its rows need.
    limits = accounts.select("account", threshold.alias("read_until")).hint("rebalance")
    return notifications.join(limits, "account").where(
        F.col("created") > F.col("read_until")
    ).drop("read_until")


def read_threshold(module: str, code: str, as_of: str) -> Column:
    """Last read mark of a code, else 30 days before ``as_of``."""
    oldest = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")
    return F.coalesce(
        F.col("last_reads")[f"{module}.{code}"].try_cast("timestamp_ntz"), oldest
    )


def _unread_of_code(
    notifications, accounts, module, code, as_of, account, min_date, max_date
) -> DataFrame:
    min_date, max_date = check_date(min_date), check_date(max_date)
    picked = _of(notifications, account).where(
        (F.col("module_name") == module) & (F.col("notif_code") == code)
    )
    if min_date:
        picked = picked.where(F.col("created") >= F.lit(min_date).cast("timestamp_ntz"))
    if max_date:
        picked = picked.where(F.col("created") <= F.lit(max_date).cast("timestamp_ntz"))
    return created_after_read(
        picked, _of(accounts, account), read_threshold(module, code, as_of)
    )


def _between(frame: DataFrame, value: Column, low, high) -> DataFrame:
    """Bounds are inclusive; 0 or None means no bound."""
    if low:
        frame = frame.where(value >= low)
    if high:
        frame = frame.where(value <= high)
    return frame


def transfers(
    notifications: DataFrame, accounts: DataFrame, as_of: str, account: str | None = None,
    limit: int = MAX_LIMIT, currency: str | None = None, sender: str | None = None,
    min_amount: int | None = None, max_amount: int | None = None,
    min_date: str | None = None, max_date: str | None = None, op_data: bool = False,
) -> DataFrame:
    """Unread transfers. Amounts are compared raw, before any scaling."""
    account, limit = _asked(account, limit)
    check_currency(currency)
    check_sender(sender)
    picked = _unread_of_code(
        notifications, accounts, "currency", "trn", as_of, account, min_date, max_date
    )
    if currency or sender or min_amount or max_amount:
        picked = fenced(picked, paid=value_map("payload"))
    if currency:
        picked = picked.where(F.expr(node("paid['amount']", "nai")) == ASSET_IDS[currency])
    if sender:
        picked = picked.where(F.col("paid")["from"] == sender)
    raw = F.expr(node("paid['amount']", "amount")).try_cast("bigint")
    picked = _between(picked, raw, min_amount, max_amount)
    return newest(picked, limit).select("rank", *_columns(op_data))


def votes(
    notifications: DataFrame, accounts: DataFrame, as_of: str, account: str | None = None,
    limit: int = MAX_LIMIT, min_date: str | None = None, max_date: str | None = None,
    op_data: bool = False,
) -> DataFrame:
    account, limit = _asked(account, limit)
    picked = _unread_of_code(
        notifications, accounts, "social", "vot", as_of, account, min_date, max_date
    )
    return newest(picked, limit).select("rank", *_columns(op_data))


def token_transfers(
    notifications: DataFrame, accounts: DataFrame, as_of: str, account: str | None = None,
    limit: int = MAX_LIMIT, token: str | None = None, sender: str | None = None,
    min_amount: float | None = None, max_amount: float | None = None,
    min_date: str | None = None, max_date: str | None = None, op_data: bool = False,
) -> DataFrame:
    account, limit = _asked(account, limit)
    check_sender(sender)
    picked = _unread_of_code(
        notifications, accounts, "splinterlands", "trn", as_of, account, min_date, max_date
    )
    if token or sender or min_amount or max_amount:
        picked = fenced(picked, paid=value_map("payload"))
    if token:
        picked = picked.where(F.expr(node("paid['json']", "token")) == token)
    if sender:
        picked = picked.where(F.expr(first_element("paid['required_auths']")) == sender)
    qty = F.expr(node("paid['json']", "qty")).try_cast("double")
    picked = _between(picked, qty, min_amount, max_amount)
    return newest(picked, limit).select("rank", *_columns(op_data))


def unread_counts(notifications: DataFrame, accounts: DataFrame) -> DataFrame:
    """Count of notifications after ``last_reads.all``, 0 for accounts without any."""
    narrow = notifications.select("account", "created", "block_num", "op_id", "hook_ord")
    threshold = F.col("last_reads")["all"].try_cast("timestamp_ntz")
    counts = (
        created_after_read(narrow, accounts, threshold)
        .groupBy("account")
        .agg(F.count("*").alias("unread"))
    )
    return accounts.select("account").join(counts, "account", "left").select(
        "account", F.coalesce("unread", F.lit(0).cast("bigint")).alias("unread")
    )


def unread_count(notifications: DataFrame, accounts: DataFrame, account: str) -> DataFrame:
    """One row for one account; an unknown account counts 0."""
    account, _ = _asked(account)
    counted = unread_counts(_of(notifications, account), _of(accounts, account))
    return counted.agg(F.coalesce(F.sum("unread"), F.lit(0).cast("bigint")).alias("unread"))


def preferences(
    accounts: DataFrame, account: str | None = None, module: str | None = None
) -> DataFrame:
    """prefs and prefs_updated. With a module, ``prefs`` is its list; an account that does
    not have it gets all of its preferences in ``all_prefs`` instead."""
    picked = _of(accounts, _asked(account)[0])
    if module is None:
        return picked.select("account", "prefs", "prefs_updated")
    own = F.col("prefs")[module]
    return picked.select(
        "account", own.alias("prefs"), "prefs_updated",
        F.when(~F.map_contains_key("prefs", F.lit(module)), F.col("prefs")).alias("all_prefs"),
    )


def options(
    accounts: DataFrame, account: str | None = None, module: str | None = None
) -> DataFrame:
    """options and options_updated; with a module, that part of the document."""
    picked = _of(accounts, _asked(account)[0])
    if module is None:
        return picked.select("account", "options", "options_updated")
    part = F.from_json("options", "map<string,string>")[module]
    return picked.select("account", part.alias("options"), "options_updated")


def enabled_pairs(accounts: DataFrame, account: str | None = None) -> DataFrame:
    """One row per enabled ``module:code``."""
    return (
        _of(accounts, _asked(account)[0])
        .select("account", F.explode("prefs").alias("module", "codes"))
        .select("account", "module", F.explode("codes").alias("code"))
        .select("account", F.concat_ws(":", "module", "code").alias("pair"))
    )
