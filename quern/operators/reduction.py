"""Many texts into one by a model that reads a bounded number of characters at a time: a tree of calls, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.distill import numbered
from quern.state import cut

#: Characters that one call reads, and of a reply those that the next level reads.
READ, REPLY = 80_000, 10_000


def reduced(items: DataFrame, combine: Callable[[list[str], bool], str], order: str, text: str = "text", each: int = 200, read: int = READ, reply: int = REPLY) -> str | None:
    """One text from ``items``, in their order; None from none.

    ``combine(texts, last)`` makes one text of some that stand together, in order; ``last`` tells that no other is left. It runs on executors. Of an item
    ``each`` characters are read, of what ``combine`` made ``reply``; a call gets as many as fit into ``read``, so the tree has few levels and no task and
    no driver holds more than one call's texts. Where a call fails the texts themselves stand in for it, cut to the room there is.
    """
    def level(fan: int, width: int, last: bool):
        def call(frame):
            import pandas as pd

            texts = [t[:width] for t in frame.sort_values("place")["text"]]
            try:
                made = combine(texts, last)
            except Exception:  # noqa: BLE001  what cannot be put into words is handed on
                made = "\n".join(texts)
            return pd.DataFrame({"place": [int(frame["place"].iloc[0]) // fan], "text": [made]})

        return call

    fan, width = max(2, read // each), each
    now = cut(numbered(items.select(F.col(order).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text")), 1, "ord", "_b").select(F.col("_place").cast("bigint").alias("place"), "text"), "items")
    n = now.count()
    while n:
        groups = -(-n // fan)
        now = cut(now.groupBy(F.floor(F.col("place") / fan).alias("_g")).applyInPandas(level(fan, width, groups == 1), "place bigint, text string"), "reduced")
        n, fan, width = groups, max(2, read // reply), reply
        if n == 1:
            return now.first()["text"]
    return None
