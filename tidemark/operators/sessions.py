"""Sessions and bounded histories over turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

#: Turns kept, tokens a context holds, the share of them that calls for a summary, idle minutes.
HISTORY = 10
CONTEXT_TOKENS = 2048
SUMMARY_SHARE = 0.7
KEPT_TURNS = 5
IDLE = "30 minutes"


def sessionise(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = IDLE) -> DataFrame:
    """(key, session_start, session_end, n): events of a key with gaps of at
    most ``gap``; session_end is the last event. Spark merges per partition
    before the shuffle, so a busy key is no group to gather."""
    out = events.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
    return out.select(key, "session_start", "session_end", "n")


def last_turns(turns: DataFrame, n: int = HISTORY, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def history_before(turns: DataFrame, n: int = HISTORY, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each turn with the texts of the ``n`` before it, as "role: text" lines:
    context is read before the turn is added."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    lines = F.collect_list(F.concat_ws(": ", "role", "text")).over(w)
    return turns.select(key, order, F.array_join(lines, "\n").alias("history"), F.size(lines).alias("n_history"))


def token_budget(turns: DataFrame, n: int = HISTORY, limit: int = CONTEXT_TOKENS, share: float = SUMMARY_SHARE, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Running token estimate over the last ``n`` turns, and whether it passes
    the share of the context that calls for a summary."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    total = F.sum(text.rough_tokens(F.col("text"))).over(w)
    # an empty summary counts one token
    return turns.select(key, order, (total + 1).alias("tokens"), (total + 1 > limit * share).alias("over"))


def split_history(turns: DataFrame, keep: int = KEPT_TURNS, n: int = HISTORY, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of a conversation as the part to summarise and the
    part kept word for word."""
    bands = last_turns(turns, n, key, order).withColumn("kept", F.col("back") <= keep)
    return bands.groupBy(key).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_summarised"))
