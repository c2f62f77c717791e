"""The stored alerts: what every range of the log left, committed together with its progress.

Tables of the store, each a set of committed folders:
  notifications   by day, sorted by account within files, with Bloom filters of accounts
  verdicts        answers for stored pending notifications, by the notification's day
  account_days    notifications of each account and day, counted when they were written
  accounts        accounts with their first reference, one row each
  state           account state that a range changed; all of it where it was compacted
  rejects         with the day of the range's last block

A range's rows, rejects, counts, accounts, state and progress are one commit: a range that runs
again, or died half-way, leaves each row once. Verdicts are small tables of their own, merged in
when notifications are read and written into the touched days by `compact`; other days keep their
files. Days beyond the retention leave with every commit.
"""

from __future__ import annotations

import datetime
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainalerts import schemas
from chainalerts.constants import RETENTION_DAYS
from chainalerts.operators.accounts import discover
from chainalerts.operators.retention import retained_notifications
from chainalerts.operators.verification import agreed_answers
from chainalerts.plans.jobs import latest_state
from chainalerts.plans.notifications import AlertPlan, opening_state
from chainalerts.sources.commits import CommitLog, Entry, Snapshot
from chainalerts.sources.sinks import by_day_and_account, staging

STATE_ROWS = schemas.STATE + ", written BIGINT"
ACCOUNTS = "account STRING, first_seen TIMESTAMP_NTZ, first_block INT, first_op_id BIGINT"
ACCOUNT_DAYS = "account STRING, n BIGINT, created_date DATE"
VERDICTS = "notif_key STRING, answer BOOLEAN, created_date DATE"
LOG, OPENING, VERDICT_WRITER, UPKEEP = "log", "opening", "verdicts", "upkeep"
SECONDS_OF_GRACE = 3600.0


def follows(last: int, first: int) -> None:
    """Ranges of blocks have to follow each other without a gap."""
    if first <= last:
        raise ValueError(f"block {first} comes after block {last} was processed")
    if first > last + 1:
        raise ValueError(f"blocks {last + 1} to {first - 1} are missing")


class AlertStore:
    def __init__(
        self, spark: SparkSession, path: str, compact_every: int = 20, retention_days: int = RETENTION_DAYS,
        grace_seconds: float = SECONDS_OF_GRACE, keep_state: bool = True,
    ):
        """Without ``keep_state`` account state is kept elsewhere, and comes with every plan."""
        self.spark, self.log = spark, CommitLog(spark, path)
        self.compact_every, self.retention_days, self.grace_seconds = compact_every, retention_days, grace_seconds
        self.keep_state = keep_state

    # Writing --------------------------------------------------------------------------

    def open_with(self, state: DataFrame, blocks: tuple[int, int], block_time, ops: int) -> None:
        """Commit the state that a preload of ``blocks`` left; the log then goes on after it."""
        rows = state.select("account", "module", "codes", "opts", F.lit(blocks[1]).cast("bigint").alias("written"))
        self.log.commit(
            OPENING, blocks[1], self.log.write("state", rows), facts=_facts(blocks, block_time, ops))

    def opened(self) -> dict | None:
        return self.log.snapshot().last(OPENING)

    def holds(self, blocks: tuple[int, int]) -> bool:
        """Whether the log up to the range's last block is committed."""
        last = self.log.snapshot().last(LOG)
        return last is not None and blocks[1] <= last["number"]

    def append(self, plan: AlertPlan, blocks: tuple[int, int], heads: dict | None = None) -> bool:
        """Commit what the operations of ``blocks`` lead to; False if they were committed before.

        The log is parsed once: candidates and preference operations are staged, and every later
        step (and every retry after a lost executor) reads those. ``plan.snapshot`` is what
        was before the store's first range. Other ranges have to go on where the log ended.
        ``heads`` gives the number of operations (``ops``) and the last one's ``time`` where they are
        known from the landing; otherwise these two columns are read."""
        now = self.log.snapshot()
        last = now.last(LOG)
        if last is not None and blocks[1] <= last["number"]:
            return False
        before = last or now.last(OPENING)
        if before is not None:
            follows(before["number"], blocks[0])
        if heads is None:
            heads = plan.ops.agg(
                F.max_by("ts", F.struct("block_num", "op_id")).alias("time"), F.count("*").alias("ops")).first()
        time = heads["time"] or (before or {}).get("block_time")
        earlier = self._earlier(now, plan.snapshot) if self.keep_state else None
        log = self.log
        with staging(self.spark) as stage:
            plan.staged(stage)
            found = stage(discover(plan.candidates(), plan.preference_log()), "accounts")
            if earlier is not None:
                # Only what the range's accounts left behind takes part in it. They are a table,
                # so Spark knows its size and spreads them where it can.
                plan.snapshot = latest_state(earlier.join(found.select("account"), "account", "left_semi"))
            resolved = stage(plan.resolved().where("passes OR reason IS NOT NULL"), "resolved")
            add = log.write(
                "notifications", by_day_and_account(plan.notifications(resolved)), by_day=True, looked_up=["account"])
            written = log.read("notifications", schemas.NOTIFICATIONS, Snapshot(entries={e.path: e for e in add}))
            add += log.write("account_days", _counted(written, F.lit(1)), by_day=True)
            add += log.write("rejects", plan.rejects(resolved), day=None if time is None else str(time)[:10])
            add, remove = self._accounts(now, found, add)
            if self.keep_state:
                add, remove = self._state(now, plan, earlier, blocks[1], add, remove)
            remove += self._expired(now, None if time is None else str(time))
            done = log.commit(LOG, blocks[1], add, remove, _facts(blocks, time, heads["ops"]))
        if len(now.of("accounts")) + 1 >= self.compact_every:
            log.vacuum(self.grace_seconds)
        return done

    def _accounts(self, now: Snapshot, found: DataFrame, add: list[Entry]) -> tuple[list[Entry], list[Entry]]:
        """Accounts that no earlier range referred to; now and then all of them as one folder."""
        known, held = self.log.read("accounts", ACCOUNTS, now), now.of("accounts")
        fresh = unseen(found, known).select(*known.columns)
        if len(held) + 1 < self.compact_every:
            return add + self.log.write("accounts", fresh), []
        return add + self.log.write("accounts", known.unionByName(fresh)), held

    def _state(self, now, plan, earlier, block, add, remove) -> tuple[list[Entry], list[Entry]]:
        state, held = plan.own_changes(), now.of("state")
        if len(held) + 1 >= self.compact_every and earlier is not None:
            state, remove = state.unionByName(opening_state(latest_state(earlier))), remove + held
        rows = latest_state(state).withColumn("written", F.lit(block).cast("bigint"))
        return add + self.log.write("state", rows), remove

    def _earlier(self, now: Snapshot, initial: DataFrame | None) -> DataFrame | None:
        """Account states that earlier ranges wrote, as changes at the block they went up to."""
        columns = ["account", "module", "codes", "opts"]
        at = [F.col("written").cast("int").alias("block_num"), F.lit(0).cast("bigint").alias("op_id")]
        parts = []
        if now.of("state"):
            parts.append(self.log.read("state", STATE_ROWS, now).select(*columns, *at))
        if initial is not None:
            parts.append(initial.select(*columns, F.lit(-1).alias("block_num"), at[1]))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def settle(self, answers: DataFrame, number: int) -> bool:
        """Store answers (notif_key, answer) for pending notifications, as their round ``number``.
        Answers for rows that have a verdict, or that are not stored, change nothing."""
        now = self.log.snapshot()
        last = now.last(VERDICT_WRITER)
        if last is not None and number <= last["number"]:
            return False
        pending = self._merged(now).where(F.col("verified").isNull()).select("notif_key", "created_date")
        rows = pending.join(agreed_answers(answers), "notif_key").select("notif_key", "answer", "created_date")
        add = self.log.write("verdicts", rows.hint("rebalance", "created_date"), by_day=True)
        return self.log.commit(VERDICT_WRITER, number, add)

    def compact(self) -> list[str]:
        """Rewrite the days that have verdicts, or lie in several folders; gives them. Verdicts
        become columns of their rows; other days keep their files."""
        now = self.log.snapshot()
        several = Counter(e.day for e in now.of("notifications"))
        days = sorted({e.day for e in now.of("verdicts")} | {day for day, n in several.items() if n > 1})
        if not days:
            return []
        add = self.log.write(
            "notifications", by_day_and_account(self._merged(now, days)), by_day=True, looked_up=["account"])
        counts = self.log.read("account_days", ACCOUNT_DAYS, now, days)
        add += self.log.write("account_days", _counted(counts, F.col("n")), by_day=True)
        gone = [e for table in ("notifications", "account_days", "verdicts") for e in now.of(table, days)]
        self.log.commit(UPKEEP, now.version + 1, add, gone)
        return days

    def _expired(self, now: Snapshot, as_of: str | None) -> list[Entry]:
        if as_of is None:
            return []
        oldest = datetime.datetime.fromisoformat(as_of) - datetime.timedelta(days=self.retention_days)
        return [e for e in now.entries.values() if e.day is not None and e.day < str(oldest.date())]

    def expire(self, as_of: str) -> int:
        """Take out the days that lie wholly before the retention; gives their number. Their files
        go with the next `vacuum`."""
        now = self.log.snapshot()
        gone = self._expired(now, as_of)
        if gone:
            self.log.commit(UPKEEP, now.version + 1, remove=gone)
        return len({e.day for e in gone if e.table == "notifications"})

    # Reading --------------------------------------------------------------------------

    def _merged(self, now: Snapshot, days=None) -> DataFrame:
        rows = self.log.read("notifications", schemas.NOTIFICATIONS, now, days)
        judged = sorted({e.day for e in now.of("verdicts", days)})
        if not judged:
            return rows
        # Rows of other days, and those that are settled, do not meet the verdicts.
        verdicts = self.log.read("verdicts", VERDICTS, now, judged)
        asked = F.col("created_date").isin([datetime.date.fromisoformat(d) for d in judged])
        asked &= F.col("verified").isNull()
        answered = rows.where(asked).join(verdicts, ["created_date", "notif_key"], "left")
        return rows.where(~asked).unionByName(
            answered.withColumn("verified", F.col("answer")).select(*rows.columns))

    def notifications(self, as_of: str | None = None) -> DataFrame:
        """All notifications with their verdicts; with ``as_of`` those within the retention then."""
        rows = self._merged(self.log.snapshot())
        return rows if as_of is None else retained_notifications(rows, as_of)

    def rejects(self) -> DataFrame:
        return self.log.read("rejects", schemas.REJECTS)

    def accounts(self) -> DataFrame:
        """Accounts that were ever referred to, with their first reference."""
        return self.log.read("accounts", ACCOUNTS)

    def unread_counts(self, accounts: DataFrame, threshold: Column) -> DataFrame:
        """Notifications of each of ``accounts`` that were created after its ``threshold``, 0 for
        accounts without any. Whole days are read from the counts that were kept; of
        notifications only the day is read that an account's threshold lies in."""
        now = self.log.snapshot()
        limits = accounts.select("account", threshold.alias("read_until"))
        limits = limits.withColumn("edge", F.to_date("read_until"))
        # Dealt anew, the accounts' side has an exchange of its own: then Spark splits an account
        # that is hot on the other side.
        counts = self.log.read("account_days", ACCOUNT_DAYS, now)
        days = counts.join(limits.hint("rebalance"), "account").where(
            F.col("created_date") > F.col("edge")).select("account", "n")
        rows = self.log.read("notifications", schemas.NOTIFICATIONS, now).select(
            "account", "created", "created_date")
        edge = rows.join(limits.hint("rebalance"), (rows["account"] == limits["account"]) & (rows["created_date"] == limits["edge"]))
        edge = edge.where(F.col("created") > F.col("read_until")).select(rows["account"], F.lit(1).cast("bigint").alias("n"))
        total = days.unionByName(edge).groupBy("account").agg(F.sum("n").alias("unread"))
        return accounts.select("account").join(total, "account", "left").select(
            "account", F.coalesce("unread", F.lit(0).cast("bigint")).alias("unread"))

    def progress(self) -> DataFrame:
        """The ranges whose commit files are there, by their commit's version."""
        facts = F.col("facts")
        return self.log.history().where(F.col("writer") == LOG).select(
            facts["first_block"].cast("int").alias("first_block"), F.col("number").cast("int").alias("last_block"),
            facts["block_time"].cast("timestamp_ntz").alias("block_time"), facts["ops"].cast("bigint").alias("ops"),
            F.col("version").alias("batch_id"))


def unseen(found: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``found`` whose account is not among the ``known``, where few meet many.

    First what is known of those that were found: found accounts are a table of known size, which Spark sends
    to where the known ones lie, as long as it is small. These are then shuffled no more, and the
    anti-join meets at most as many rows as were found.
    """
    seen = known.select("account").join(found.select("account"), "account", "left_semi")
    return found.join(seen, "account", "left_anti")


def _facts(blocks: tuple[int, int], block_time, ops: int) -> dict:
    return {"first_block": blocks[0], "block_time": None if block_time is None else str(block_time), "ops": ops}


def _counted(rows: DataFrame, n: Column) -> DataFrame:
    counts = rows.groupBy("account", "created_date").agg(F.sum(n).cast("bigint").alias("n"))
    return counts.hint("rebalance", "created_date").sortWithinPartitions("created_date", "account")


def run_batch(plan: AlertPlan, path: str, blocks: tuple[int, int] | None = None) -> bool:
    """Commit notifications and rejects of a log, or of its ``blocks``, to the store below
    ``path``. False if they were committed before: a job that runs again changes nothing."""
    if blocks is None:
        ends = plan.ops.agg(F.min("block_num"), F.max("block_num")).first()
        if ends[0] is None:
            return False
        blocks = tuple(ends)
    return AlertStore(plan.ops.sparkSession, path).append(plan, blocks)
