"""Conversations as ordered events: identifiers, de-duplication, context, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talespark.functions.text import normalize_text, redact, secret_hits


def messages(conversations: DataFrame) -> DataFrame:
    """Events of (conv_id, turn, role, text) in source order."""
    return conversations.select(F.col("conv_id").alias("thread"), F.format_string("L%06d", F.col("turn") + 1).alias("local_id"), F.col("turn").alias("ord"), "role", "text")


def dedupe_messages(events: DataFrame) -> DataFrame:
    """The first of messages with equal role and normalised text in a thread. The key
    holds a digest in place of the text, so sorted rows stay short."""
    keyed = events.withColumn("_key", F.sha2(normalize_text(F.col("text")), 256))
    w = Window.partitionBy("thread", "role", "_key").orderBy("ord", "local_id")
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key")


def thread_summary(events: DataFrame, title_chars: int = 100) -> DataFrame:
    """One row per thread, in one aggregation: counts, secret hits, title, status."""
    user = F.col("role") == "user"
    clean = normalize_text(F.col("text"))
    out = events.groupBy("thread").agg(
        F.count("*").alias("events"),
        F.count_if(user).alias("user_messages"),
        F.count_if(F.size(secret_hits(F.col("text"))) > 0).alias("with_secrets"),
        F.sum(F.length(redact(F.col("text")))).alias("redacted_chars"),
        F.min_by(F.substring(clean, 1, title_chars), F.when(user, F.col("ord"))).alias("title"),
    )
    return out.withColumn("title", F.coalesce("title", F.lit("Untitled"))).withColumn("status", F.when(F.col("user_messages") > 0, "pending").otherwise("without-user-message"))


def messages_of(messages: DataFrame, role: str) -> DataFrame:
    """The view of one role's messages, whatever other columns they have; a null role is none."""
    return messages.filter(F.col("role") == role)


def messages_by_role(events: DataFrame) -> DataFrame:
    """(thread, role, messages, characters): a thread's messages of each role; a null
    role is empty, a null text has no characters."""
    return events.groupBy("thread", F.coalesce("role", F.lit("")).alias("role")).agg(F.count("*").alias("messages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))


def fill_context(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last value given so far, in order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(f"{value}_filled", F.last(value, True).over(w))


def idle_sessions(events: DataFrame, key: str, time: str, minutes: int = 30) -> DataFrame:
    """Stretches of activity that end after ``minutes`` without an event."""
    return events.groupBy(key, F.session_window(time, f"{minutes} minutes").alias("s")).agg(F.count("*").alias("events"), F.min(time).alias("first_at"), F.max(time).alias("last_at")).drop("s")
