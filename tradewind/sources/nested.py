"""Nested records: conversation stores and answers of social interfaces, as JSON with whatever fields they happen to have.

Lines are parsed to variants, so that no schema is inferred and a field of another type spoils nothing: each field is read
with its type or takes its default. Records that can't be read at all go to a lane of their own with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze

#: Fixed: what a conversation without a title is called.
UNTITLED = "Cuộc trò chuyện mới"
#: Fixed: names of items without a title of their own, the name of a page's posts, and the length of a headline.
NO_VIDEO_TITLE, NO_CHANNEL, NO_POST, OWN_PAGE, NO_TIKTOK, HEADLINE = "Video không có tiêu đề", "Không rõ kênh", "Bài viết không có nội dung", "Facebook Page đã cấp quyền", "Video TikTok", 110


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _text(v: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(default))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines (value, and any columns): those that hold an object, as v; and the rest, with reason. Blank lines are none."""
    rows = lines.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    reason = F.when(F.col("v").isNull(), "not_json").when(~_object(F.col("v")), "not_an_object")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason", "value"), rows.filter("reason is not null").drop("v")


def rejected(lines: DataFrame) -> DataFrame:
    """reason, records: how many lines of a store can't be read, and why."""
    return parsed(lines)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def conversations(lines: DataFrame) -> DataFrame:
    """One row for each message of a store with a conversation on each line: its conversation (id, title, topic), place,
    role, content and what else is kept with it. What isn't a message object is left out, and places count what is left."""
    good, _ = parsed(lines)
    v = F.col("v")
    c = good.select(
        F.try_variant_get(v, "$.id", "string").alias("conversation_id"), _text(v, "title", UNTITLED).alias("title"), _text(v, "memory.active_topic").alias("active_topic"),
        F.try_variant_get(v, "$.created_at", "string").alias("created_at"), F.coalesce(F.try_variant_get(v, "$.updated_at", "string"), F.try_variant_get(v, "$.created_at", "string")).alias("updated_at"),
        F.filter(_list(v, "messages"), lambda m: _object(m)).alias("messages"),
    )
    m = F.col("m")
    each = c.select("conversation_id", "title", "active_topic", "created_at", "updated_at", F.posexplode("messages").alias("place", "m"))
    own_id = F.sha2(F.concat_ws("|", "conversation_id", F.col("place").cast("string")), 256)
    return each.select(
        "conversation_id", "title", "active_topic", "created_at", "updated_at", "place", F.coalesce(F.try_variant_get(m, "$.id", "string"), own_id).alias("id"),
        _text(m, "role", "assistant").alias("role"), _text(m, "content").alias("content"), _text(m, "time").alias("time"), _text(m, "feedback").alias("feedback"),
        F.try_variant_get(m, "$.confidence", "double").alias("confidence"), _text(m, "confidence_label").alias("confidence_label"), _text(m, "data_status").alias("data_status"),
        F.size(F.filter(_list(m, "citations"), lambda x: _object(x))).alias("citations"), _text(m, "metrics.mode").alias("mode"),
        F.coalesce(F.try_variant_get(m, "$.metrics.elapsed", "double"), F.lit(0.0)).alias("elapsed"),
    )


def _headline(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(HEADLINE)), F.when(F.length(text) > HEADLINE, "…").otherwise(""))


def videos(lines: DataFrame) -> DataFrame:
    """title, creator, published_at, url of a video search's items, one row each; items without a video's id are dropped."""
    good, _ = parsed(lines)
    i = F.col("i")
    return good.select(F.explode(_list(F.col("v"), "items")).alias("i")).withColumn("video", F.try_variant_get(i, "$.id.videoId", "string")).filter("video <> ''").select(
        _text(i, "snippet.title", NO_VIDEO_TITLE).alias("title"), _text(i, "snippet.channelTitle", NO_CHANNEL).alias("creator"),
        F.left(_text(i, "snippet.publishedAt"), F.lit(10)).alias("published_at"), F.concat(F.lit("https://www.youtube.com/watch?v="), "video").alias("url"),
    )


def posts(lines: DataFrame) -> DataFrame:
    """title, creator, published_at, url of a page's posts, one row each; messages become headlines."""
    good, _ = parsed(lines)
    i = F.col("i")
    return good.select(F.explode(_list(F.col("v"), "data")).alias("i")).select(
        _headline(squeeze(_text(i, "message", NO_POST))).alias("title"), F.lit(OWN_PAGE).alias("creator"), F.left(_text(i, "created_time"), F.lit(10)).alias("published_at"), _text(i, "permalink_url").alias("url"),
    )


def research(lines: DataFrame) -> DataFrame:
    """title, creator (views and likes), published_at, url of a research interface's videos, one row each."""
    good, _ = parsed(lines)
    i = F.col("i")
    count = lambda path: F.format_number(F.coalesce(F.try_variant_get(i, f"$.{path}", "long"), F.lit(0).cast("long")), 0)
    return good.select(F.explode(_list(F.col("v"), "data.videos")).alias("i")).select(
        _headline(_text(i, "video_description", NO_TIKTOK)).alias("title"), F.concat(count("view_count"), F.lit(" lượt xem · "), count("like_count"), F.lit(" lượt thích")).alias("creator"),
        F.left(_text(i, "create_time"), F.lit(10)).alias("published_at"), F.lit("").alias("url"),
    )
