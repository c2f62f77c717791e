"""Accounts: who was ever referenced, and what their preferences are now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainalerts.constants import DEFAULT_PREFS, PREFERENCE_ID, RETENTION_DAYS
from chainalerts.functions.json_values import fenced, first_element
from chainalerts.operators.hooks import Catalog, literal
from chainalerts.sources.op_log import preference_ops


DEFAULTS = literal(DEFAULT_PREFS, "map<string,array<string>>")


def discover(candidates: DataFrame, preference_log: DataFrame) -> DataFrame:
    """Every account an operation refers to, with its first reference.

    A preference operation refers to its signer even if its data is rejected later. The
    candidates may be those without texts: only their names and places are read.
    """
    when = ["ts", "block_num", "op_id"]
    named = candidates.where(F.col("error").isNull()).select(
        F.explode(F.array_distinct(F.array("account", "gate_account"))).alias("account"), *when
    )
    signers = preference_log.where(F.col("effective") & F.col("reason").isNull()).select(
        "account", *when
    )
    return (
        named.unionByName(signers)
        .groupBy("account")
        .agg(
            F.min("ts").alias("first_seen"),
            F.min(F.struct("block_num", "op_id")).alias("first"),
        )
        .select("account", "first_seen", F.col("first.block_num").alias("first_block"),
                F.col("first.op_id").alias("first_op_id"))
    )


def current_accounts(
    discovered: DataFrame, preference_log: DataFrame, catalog: Catalog,
    created_at: str | None = None,
) -> DataFrame:
    """The accounts table: last_reads, prefs, options and when they were updated.

    As in the alerts, preferences do not apply while the preference hook is off, and of the
    modules an account names those of the catalog count: a row holds no more than these.
    ``last_reads.all`` starts 30 days before the account's row was made: at its first
    reference, or at ``created_at`` when a log is replayed later.
    """
    pos = F.struct("block_num", "op_id")
    accepted = preference_log.where(F.col("outcome") == "accepted")
    if catalog.preference_order() is None:
        accepted = accepted.where(F.lit(False))
    enabled = accepted.where(F.col("op_name") == "enabled")
    latest = (
        enabled.select("account", F.explode("enabled").alias("e"), pos.alias("pos"))
        .where(F.col("e.module").isin(sorted(catalog.modules)))
        .groupBy("account", "e.module")
        .agg(F.max_by("e.codes", "pos").alias("codes"))
        .groupBy("account")
        .agg(F.map_from_entries(F.collect_list(F.struct("module", "codes"))).alias("own"))
    )
    updates = accepted.groupBy("account").agg(
        F.max_by("ts", F.when(F.col("op_name") == "enabled", pos)).alias("prefs_updated"),
        F.max_by("ts", F.when(F.col("op_name") == "options", pos)).alias("options_updated"),
        F.max_by("options", F.when(F.col("op_name") == "options", pos)).alias("options"),
    )
    made = F.col("first_seen") if created_at is None else F.lit(created_at).cast("timestamp_ntz")
    own = "coalesce(own, CAST(map() AS MAP<STRING,ARRAY<STRING>>))"
    kept = f"map_filter({DEFAULTS}, (module, _) -> NOT map_contains_key({own}, module))"
    return (
        discovered.join(latest, "account", "left")
        .join(updates, "account", "left")
        .select(
            "account",
            F.create_map(
                F.lit("all"),
                (made - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")).cast("string"),
            ).alias("last_reads"),
            F.expr(f"map_concat({kept}, {own})").alias("prefs"),
            F.coalesce("options", F.lit("{}")).alias("options"),
            "prefs_updated", "options_updated",
        )
    )


def read_marks(ops: DataFrame, catalog: Catalog) -> DataFrame:
    """Latest ``read`` mark per account and ``module.code``, or per account and ``all``.

    Taken from payloads [..., "read", ["module.code", ...]], with or without a header.
    Pairs that no hook has, and NULL, are passed over: an account's marks are at most as
    many as there are hooks.
    """
    known = sorted({f"{hook.module}.{hook.notif_code}" for hook in catalog.hooks} | {"all"})
    parsed = fenced(
        preference_ops(ops, PREFERENCE_ID),
        doc="try_variant_get(try_parse_json(v['json']), '$', 'array<variant>')",
        account=first_element("v['required_posting_auths']"),
    )
    named = fenced(
        parsed,
        op_name="try_variant_get(try_element_at(doc, -2), '$', 'string')",
        marks="try_variant_get(try_element_at(doc, -1), '$', 'array<string>')",
    )
    return (
        named.where((F.col("op_name") == "read") & F.col("account").isNotNull())
        .select("account", F.explode("marks").alias("pair"), "ts")
        .where(F.col("pair").isin(known))
        .groupBy("account", "pair")
        .agg(F.max("ts").alias("read_at"))
    )


def with_read_marks(accounts: DataFrame, marks: DataFrame) -> DataFrame:
    """Put read marks into ``last_reads``; a mark replaces the entry of its key."""
    by_account = marks.groupBy("account").agg(
        F.map_from_entries(
            F.collect_list(F.struct("pair", F.col("read_at").cast("string").alias("at")))
        ).alias("marks")
    )
    marks = F.coalesce("marks", F.create_map().cast("map<string,string>"))
    others = F.map_filter("last_reads", lambda key, _: ~F.map_contains_key(marks, key))
    return accounts.join(by_account, "account", "left").withColumn(
        "last_reads", F.map_concat(others, marks)
    ).drop("marks")
