"""Rows of a long table that fall inside each anchor's own time window.

The window is cut into fixed chunks and both sides meet on (key, chunk), so a hot key is spread
over its chunks and no anchor is compared with rows far from it. The sides are shuffled and merged:
an anchor is one row per chunk there, of which planning knows nothing, and it would broadcast a
table of small anchors after it has grown many times over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_window(
    anchors: DataFrame,
    rows: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    ts: str,
    chunk_ms: int = 6 * 3_600_000,
) -> DataFrame:
    """Inner join of anchors and rows with start <= ts <= end. Other column names must not clash."""
    chunks = F.sequence(
        F.floor(F.col(start) / chunk_ms).cast("bigint"), F.floor(F.col(end) / chunk_ms).cast("bigint")
    )
    left = anchors.where(F.col(start) <= F.col(end)).withColumn("_chunk", F.explode(chunks))
    right = rows.withColumn("_chunk", F.floor(F.col(ts) / chunk_ms).cast("bigint"))
    return (
        left.join(right.hint("merge"), [*keys, "_chunk"])
        .where((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end)))
        .drop("_chunk")
    )
