"""From the operation log to notifications and rejects, as one declarative plan.

    ops -> parse once -> x hooks -> recipients -> as-of state -> gates -> x transactions

The transactions are joined last: only rows that became notifications need a hash. Where both
logs lie in the same buckets (``chainalerts.sources.colocated``) they are joined first: that takes
no exchange, and spares the notifications theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainalerts.constants import (
    ALL_CODES, DEFAULT_PREFS, MAX_ACCOUNT, MAX_TEXT, PREFERENCE_ID,
)
from chainalerts.operators.asof import BUCKET_OPS, asof_state
from chainalerts.operators.handlers import fields_read, parse_declared, recipients, shapes_read
from chainalerts.operators.hooks import Catalog, dispatch, filter_keys, literal
from chainalerts.operators.preferences import preference_log, state_changes
from chainalerts.sources.op_log import parse_values, with_transactions

NOTIF_COLUMNS = [
    "notif_key", "block_num", "op_id", "hook_ord", "trx_id", "account", "module_name",
    "notif_code", "created", "remark", "payload", "link", "verified", "created_date",
]


def candidates(
    ops: DataFrame, catalog: Catalog, semantics: str = "reference", hooks=None,
    texts: bool = True,
) -> DataFrame:
    """(operation, hook, recipient) rows before preferences are looked at.

    Without ``texts`` they tell who is referred to, and carry no remarks and links.
    """
    chosen = catalog.notifying_hooks() if hooks is None else hooks
    functions = [hook.funct for _, hook in chosen]
    fields = shapes = None
    if "val" in ops.columns:  # landed as VARIANT: what the rules name is read
        fields, shapes = fields_read(functions, semantics), shapes_read(functions)
        if fields is not None:
            fields |= {key for asked in filter_keys(chosen).values() for key in asked}
    values = parse_values(ops, fields, shapes)
    matched = parse_declared(dispatch(values, catalog, chosen), functions)
    names = ["block_num", "op_id", "hook_ord", "module", "notif_name", "notif_code", "ts",
             "trx_in_block", "body", *(["trx_hash"] if "trx_hash" in ops.columns else [])]
    rows = (
        matched.select(*names, recipients(functions, semantics, texts).alias("who"))
        # The outer form keeps the optimizer from testing the array's size below the
        # generator, which would build it twice. ``gate`` is NULL only for no recipient.
        .select(*names, F.inline_outer("who"))
        .where(F.col("gate").isNotNull())
    )
    return rows.withColumn("error", F.expr(f"""coalesce(error,
        IF(account IS NULL, 'account is null', NULL),
        IF(length(account) > {MAX_ACCOUNT}, 'account is longer than {MAX_ACCOUNT}', NULL))"""))


def changes_of(log: DataFrame, catalog: Catalog, preload: bool = False) -> DataFrame:
    """State changes of a preference log, of the catalog's modules.

    A sync applies none while the preference hook is off. A preload does not look at the
    flag: it calls the preference handler whatever it says.
    """
    changes = state_changes(log, sorted(catalog.modules))
    changes = changes.where(F.col("module").isin(sorted(catalog.modules)))
    order = catalog.preference_order()
    if order is None and not preload:
        return changes.withColumn("hook_ord", F.lit(0)).where(F.lit(False))
    return changes.withColumn("hook_ord", F.lit(order or 0))


def opening_state(snapshot: DataFrame) -> DataFrame:
    """A state snapshot (what earlier block ranges left) as changes before any block."""
    return snapshot.select(
        "account", "module", "codes", "opts", F.lit(-1).alias("block_num"),
        F.lit(-1).cast("bigint").alias("op_id"), F.lit(0).alias("hook_ord"),
    )


def with_gates(rows: DataFrame) -> DataFrame:
    """Add ``subscribed`` (preferences), ``passes`` (all gates) from the as-of state."""
    defaults = literal(DEFAULT_PREFS, "map<string,array<string>>")
    codes = f"coalesce(codes, {defaults}[module])"
    limit = "try_cast(opts[notif_code][limit_key] AS DOUBLE)"
    return rows.selectExpr(
        "*",
        f"coalesce(arrays_overlap({codes}, array('{ALL_CODES}', notif_code)), false) AS subscribed",
    ).selectExpr(
        "*",
        "error IS NULL AND gate AND subscribed "
        f"AND NOT coalesce(limit_value < {limit}, false) AS passes",
    ).selectExpr(
        "*",
        f"""coalesce(error, IF(passes, coalesce(error_if_sent,
            IF(length(remark) > {MAX_TEXT}, 'remark is longer than {MAX_TEXT}', NULL),
            IF(length(link) > {MAX_TEXT}, 'link is longer than {MAX_TEXT}', NULL)), NULL)) AS reason""",
    )


# One operation gives an account at most one row per hook.
NOTIFICATION_KEY = "concat_ws(':', block_num, op_id, hook_ord, account)"


@dataclass
class AlertPlan:
    """The frames of one run over a log. Nothing is computed until one is used."""

    ops: DataFrame
    catalog: Catalog = field(default_factory=Catalog.default)
    transactions: DataFrame | None = None
    snapshot: DataFrame | None = None
    semantics: str = "reference"
    bucket_ops: int = BUCKET_OPS
    hooks: list | None = None
    hashes_first: bool = False

    def __post_init__(self):
        self._candidates: DataFrame | None = None
        self._log: DataFrame | None = None

    def use(self, candidates_frame: DataFrame, log: DataFrame) -> None:
        """Use candidates and a preference log kept earlier, so ops are parsed only once."""
        self._candidates, self._log = candidates_frame, log

    def staged(self, stage: Callable[[DataFrame, str], DataFrame]) -> AlertPlan:
        """Compute the candidates and the preference log now, once, by ``stage`` (see
        ``chainalerts.sources.sinks``). Otherwise each frame of the plan makes them twice."""
        self.use(stage(self.candidates(), "candidates"), stage(self.preference_log(), "preferences"))
        return self

    def candidates(self) -> DataFrame:
        if self._candidates is not None:
            return self._candidates
        ops = self.ops
        if self.hashes_first and self.transactions is not None:
            ops = with_transactions(ops, self.transactions)
        return candidates(ops, self.catalog, self.semantics, self.hooks)

    def places(self) -> DataFrame:
        """Whose state is asked for and where: the candidates without their texts."""
        if self._candidates is not None:
            return self._candidates
        return candidates(self.ops, self.catalog, self.semantics, self.hooks, texts=False)

    def preference_log(self) -> DataFrame:
        return self._log if self._log is not None else preference_log(self.ops, self.catalog)

    def own_changes(self) -> DataFrame:
        """State changes made by the operations of this plan."""
        return changes_of(self.preference_log(), self.catalog)

    def changes(self) -> DataFrame:
        own = self.own_changes()
        if self.snapshot is None:
            return own
        return own.unionByName(opening_state(self.snapshot))

    def resolved(self) -> DataFrame:
        """Candidates with the state they met and the verdict of every gate."""
        return with_gates(
            asof_state(self.candidates(), self.changes(), self.bucket_ops, self.places())
        )

    def notifications(self, resolved: DataFrame | None = None) -> DataFrame:
        rows = self.resolved() if resolved is None else resolved
        sent = rows.where("passes AND reason IS NULL").selectExpr(
            f"{NOTIFICATION_KEY} AS notif_key", "block_num", "op_id", "hook_ord",
            "trx_in_block", "account", "module AS module_name", "notif_code", "ts AS created",
            "remark", "body AS payload", "link", "verified", "to_date(ts) AS created_date",
            *(["trx_hash AS trx_id"] if "trx_hash" in rows.columns else []),
        )
        if "trx_id" in sent.columns:
            return sent.select(*NOTIF_COLUMNS)
        if self.transactions is None:
            sent = sent.withColumn("trx_id", F.lit(None).cast("binary"))
        else:
            hashes = self.transactions.withColumnRenamed("trx_hash", "trx_id")
            sent = sent.join(hashes, ["block_num", "trx_in_block"], "left")
        return sent.select(*NOTIF_COLUMNS)

    def rejects(self, resolved: DataFrame | None = None) -> DataFrame:
        """Rows an error keeps out, with the reason, instead of aborting the run."""
        rows = self.resolved() if resolved is None else resolved
        columns = ["block_num", "op_id", "notif_name", "account", "reason"]
        handled = rows.where("reason IS NOT NULL").select(*columns)
        preferences = (
            self.preference_log().where("reason IS NOT NULL")
            .withColumn("notif_name", F.lit(PREFERENCE_ID)).select(*columns)
        )
        return handled.unionByName(preferences)

    def fail_on_rejects(self) -> None:
        """Strict mode: raise on the first reject."""
        bad = self.rejects().first()
        if bad is not None:
            raise ValueError(f"operation {bad['op_id']} in block {bad['block_num']}: {bad['reason']}")
