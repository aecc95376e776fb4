"""Conversations as Markdown documents, the one changed last first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: who speaks.
SPEAKERS = {"user": "Người dùng", "assistant": "Trợ lý"}


def turns(messages: DataFrame) -> DataFrame:
    """conversation_id, place, markdown of every message (conversation_id, title, place, role, content): a heading for the
    speaker and the text; the first of a conversation (place 0) after its title. A document is its rows in order of place:
    no conversation is gathered into one value, so one of any length can be written as text, sorted."""
    name = F.coalesce(*(F.when(F.col("role") == k, v) for k, v in SPEAKERS.items()), F.col("role"))
    head: Column = F.when(F.col("place") == 0, F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"))).otherwise("")
    return messages.select("conversation_id", "place", F.concat(head, F.lit("## "), name, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("markdown"))


def write(messages: DataFrame, path: str) -> None:
    """A folder for each conversation, its messages in order in one text file."""
    rows = turns(messages).repartition("conversation_id").sortWithinPartitions("conversation_id", "place")
    rows.select("conversation_id", "markdown").write.partitionBy("conversation_id").text(path)


def by_last_change(conversations: DataFrame) -> DataFrame:
    """Conversations (conversation_id, updated_at), the one changed last first; equal times by id."""
    return conversations.orderBy(F.desc_nulls_last("updated_at"), "conversation_id")
