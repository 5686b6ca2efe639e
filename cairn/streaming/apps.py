"""Two applications: room occupancy from position events, and queries over a stream of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.arrays import string_split
from cairn.functions.codecs import Int, String, json_decode, record
from cairn.streaming.changelog import group_updates, running_counts, stream_group_updates
from cairn.streaming.incremental import Aggregate, Producer

POSITION = record(visitor=String, room=String, timestamp=Int)


def decode_positions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of well-formed position messages; others vanish."""
    return lines.select(*[c for c in lines.columns if c != column], F.explode(json_decode(POSITION, F.col(column))).alias("p")).select("*", "p.*").drop("p")


def encode_move(sign: Column, visitor: Column, room: Column) -> Column:
    """'+ {visitor,room}' or '- {visitor,room}'."""
    return F.concat(F.when(sign > 0, "+").otherwise("-"), F.lit(" {"), visitor, F.lit(","), room, F.lit("}"))


def decode_move(text: Column) -> Column:
    """(sign, visitor, room), null if it isn't a move."""
    parts = r"^([+-]) \{([^,]*),([^}]*)\}$"
    sign = F.when(F.regexp_extract(text, parts, 1) == "+", 1).otherwise(-1)
    made = F.struct(sign.alias("sign"), F.regexp_extract(text, parts, 2).alias("visitor"), F.regexp_extract(text, parts, 3).alias("room"))
    return F.when(text.rlike(parts), made)


def room_moves(positions: DataFrame, pos: str) -> DataFrame:
    """The current room of each visitor as a changelog."""
    return group_updates(positions, "visitor", pos, lambda: F.last("room"))


def room_moves_stream(positions: DataFrame, pos: str) -> DataFrame:
    return stream_group_updates(positions, "visitor", pos, None, lambda _, r: r.room, lambda s: s, "string", "string")


def room_counts(moves: DataFrame) -> DataFrame:
    return running_counts(moves)


def encode_count(room: Column, count: Column) -> Column:
    return F.concat(F.lit('{ "room": '), F.to_json(F.struct(room.alias("r"))).substr(F.lit(6), F.length(room) + 2), F.lit(', "count": '), count.cast("string"), F.lit(" }"))


# -- queries over messages (a stream with column value) ---------------------------------------


def message_words(messages: Producer) -> Producer:
    return messages.flat_map(string_split(F.col("value"), "[ \t]+"), "word")


def word_counts(messages: Producer) -> Aggregate:
    return message_words(messages).group(["word"], F.count("*").alias("n"))


def top_words(messages: Producer, n: int = 10) -> Aggregate:
    return word_counts(messages).view(lambda df: df.orderBy(F.col("n").desc(), "word").limit(n))


def unique_count(messages: Producer) -> Aggregate:
    return messages.group(["value"], F.count("*").alias("n")).view(lambda df: df.agg(F.count("*").alias("n")))


def without_spam(messages: Producer) -> Producer:
    """Messages of x only are spam."""
    return messages.filter(~F.col("value").rlike("^[xX]+$"))


def new_words(messages: Producer) -> Producer:
    return message_words(messages).unique("word")
