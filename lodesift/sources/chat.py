"""Messages and attachments of a chat export as chunks.

messages: (channel, channel_name, user, ts, thread_ts, text), ts being seconds as text; optionally files, an array of
structs (id, name, mimetype). contents: (id, data) of attached files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.operators import paths

#: Types of attachments that hold text, beside all of text/.
TEXT_TYPES = (
    "application/json", "application/ld+json", "application/xml", "application/x-yaml",
    "application/yaml", "application/toml", "application/javascript", "application/x-sh",
)
#: Percent of a text's characters that may be unprintable.
UNPRINTABLE = 5

_ABOUT = ("channel", "channel_name", "message_user", "message_ts", "thread_ts")


def text_type(mimetype: Column) -> Column:
    """Whether a type, without its parameters, is one of text; an unknown type may be."""
    bare = F.lower(F.trim(F.split_part(F.coalesce(mimetype, F.lit("")), F.lit(";"), F.lit(1))))
    return (bare == "") | bare.startswith("text/") | bare.isin(*TEXT_TYPES)


def probably_text(data: Column) -> Column:
    """Bytes that aren't empty, are UTF-8 without a NUL, and have few unprintable characters. Of what separates
    text the plain space, the tabulator and line ends count as printable."""
    text = F.try_validate_utf8(data.cast("string"))
    odd = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \t\r\n]]"))
    return F.coalesce((F.length(text) > 0) & ~text.contains("\x00") & (odd * 100 <= F.char_length(text) * UNPRINTABLE), F.lit(False))


def chosen(messages: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), since: float | None = None) -> DataFrame:
    """Messages of the channels named (all if none is), but none of those excluded, from a time on."""
    named, without = list(include), list(exclude)
    kept = messages.where(F.col("channel_name").isin(*named)) if named else messages
    kept = kept.where(~F.coalesce(F.col("channel_name").isin(*without), F.lit(False))) if without else kept
    return kept if since is None else kept.where(F.col("ts").cast("decimal(20,6)") >= F.lit(since).cast("decimal(20,6)"))


def _about(messages: DataFrame, *more: Column | str) -> DataFrame:
    return messages.select("channel", "channel_name", F.col("user").alias("message_user"), F.col("ts").alias("message_ts"), "thread_ts", *more)


def texts(messages: DataFrame) -> DataFrame:
    """A chunk for each message with a text."""
    kept = _about(messages.where(F.length("text") > 0), F.col("text").cast("binary").alias("data"))
    return kept.withColumn("file_path", F.lit("")).withColumn("source_type", F.lit("slack"))


def attachments(messages: DataFrame, contents: DataFrame, largest: int = paths.LARGEST) -> DataFrame:
    """A chunk for each attached text file, once: at the first message that has it, by time and channel."""
    each = _about(messages, "ts", F.explode("files").alias("f")).where(text_type(F.col("f.mimetype")) & F.col("f.id").isNotNull())
    rank = F.struct(F.col("ts").cast("decimal(20,6)"), "channel")
    first = each.groupBy(F.col("f.id").alias("id")).agg(F.min_by(F.struct(*_ABOUT, F.col("f.name").alias("file_path")), rank).alias("m"))
    kept = contents.where((F.length("data") <= largest) & probably_text(F.col("data")))
    return first.join(kept, "id").select(*[F.col(f"m.{c}") for c in (*_ABOUT, "file_path")], "data", F.lit("slack").alias("source_type"))


def chat(messages: DataFrame, contents: DataFrame | None = None, include: Iterable[str] = (), exclude: Iterable[str] = (), since: float | None = None) -> DataFrame:
    """Chunks of messages, and of attachments if contents are given. An empty table gives no rows."""
    kept = chosen(messages, include, exclude, since)
    return texts(kept) if contents is None else texts(kept).unionByName(attachments(kept, contents))
