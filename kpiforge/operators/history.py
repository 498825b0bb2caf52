"""Conversation windows (R7, R8) over ``conversations(conv_id, turn, role, text)``.

The reference keeps one user's chat in memory; here every conversation of a
table is processed at once.  ``row_number() <= n`` per conversation is planned
with a partial WindowGroupLimit before the shuffle, so even a conversation
holding a third of all rows sends only ``n`` rows per task; the summary is a
``collect_list`` over at most ``summary_messages`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.text import truncate

# fixed values: the reference's window sizes and cut
MAX_TURNS = 8                 # kept messages = 2 * MAX_TURNS
SUMMARY_TURNS = 5             # summarised messages = 2 * SUMMARY_TURNS
SUMMARY_CHARS = 200


def history_window(conv: DataFrame, max_messages: int = 2 * MAX_TURNS) -> DataFrame:
    """The last ``max_messages`` messages of each conversation (rows kept)."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return (conv.withColumn("_r", F.row_number().over(w))
                .filter(F.col("_r") <= max_messages).drop("_r"))


def history_summary(conv: DataFrame, max_messages: int = 2 * MAX_TURNS,
                    summary_messages: int = 2 * SUMMARY_TURNS, max_chars: int = SUMMARY_CHARS) -> DataFrame:
    """Per conversation the kept-window size and the summary text.

    Summary: the last ``summary_messages`` messages, oldest first, each
    ``User: <text>`` or ``Bot: <text>`` (any non-user role), text cut to
    ``max_chars`` characters plus ``...`` when longer, joined by newlines.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = conv.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_messages)
    label = F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Bot"))
    line = F.concat(label, F.lit(": "), truncate(F.coalesce(F.col("text"), F.lit("")), max_chars))
    item = F.when(F.col("_r") <= summary_messages, F.struct(F.col("turn").alias("t"), line.alias("l")))
    return last.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("kept_messages"),
        F.min("turn").alias("first_kept_turn"),
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["l"]), "\n").alias("summary"))


def followup_query(conv: DataFrame) -> DataFrame:
    """Per conversation the last question, the last answer and ``question answer``.

    ``max_by`` is a partial aggregate, safe for a very long conversation.
    """
    is_user, is_bot = F.col("role") == "user", F.col("role") == "assistant"
    g = conv.groupBy("conv_id").agg(
        F.max_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("last_question"),
        F.max_by(F.when(is_bot, F.col("text")), F.when(is_bot, F.col("turn"))).alias("last_answer"))
    return (g.filter(F.col("last_question").isNotNull() & F.col("last_answer").isNotNull())
             .withColumn("query", F.concat(F.col("last_question"), F.lit(" "), F.col("last_answer"))))
