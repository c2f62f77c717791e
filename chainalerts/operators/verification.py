"""Notifications that wait for an answer from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_verifications(notifications: DataFrame) -> DataFrame:
    return notifications.where(F.col("verified").isNull()).select("notif_key", "trx_id")


def agreed_answers(answers: DataFrame) -> DataFrame:
    """One answer per notification: of several all have to agree that it is true."""
    return answers.where(F.col("answer").isNotNull()).groupBy("notif_key").agg(
        F.min("answer").alias("answer")
    )


def apply_verifications(notifications: DataFrame, answers: DataFrame) -> DataFrame:
    """Set ``verified`` of pending rows from ``answers(notif_key, answer)``.

    A NULL answer leaves the row pending; rows with a verdict keep it and are not joined.
    Of several answers for a key all have to agree that it is true.
    """
    pending = notifications.where(F.col("verified").isNull())
    answered = pending.join(agreed_answers(answers), "notif_key", "left").withColumn("verified", F.col("answer"))
    settled = notifications.where(F.col("verified").isNotNull())
    return settled.unionByName(answered.drop("answer").select(*notifications.columns))
