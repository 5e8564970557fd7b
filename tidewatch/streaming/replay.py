"""Recorded polls as a file stream, and streams driven to the end of what has landed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One observation as a poll records it. Numbers are read as text because a whole number written
# 500.0 would silently become null under an integer type.
FIELDS = ("poll_id", "pos", "chain", "contract", "observed_at_ms", "mcap_usd", "holder_count", "txns_24h", "volume_24h_usd", "boost_total")
WHOLE = ("poll_id", "pos", "observed_at_ms", "holder_count", "txns_24h")
DECIMAL = ("mcap_usd", "volume_24h_usd", "boost_total")


def polls(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Observations of recorded polls; malformed lines are left out, unknown keys dropped, and a file
    that cannot be read is an empty poll.

    One poll must land in one file: the file, never the micro-batch, is the unit of a universe.
    """
    text = ", ".join(f"{f} string" for f in FIELDS)
    raw = (
        spark.readStream.schema(f"{text}, _bad string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("columnNameOfCorruptRecord", "_bad")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .json(path)
    )
    typed = {
        **{c: F.col(c).try_cast("decimal(38,6)").try_cast("bigint") for c in WHOLE},
        **{c: F.col(c).try_cast("double") for c in DECIMAL},
    }
    return raw.where("_bad is null").select(*FIELDS).withColumns(typed).where("contract is not null")


#: Columns that ``landed`` adds to an observation.
LANDED = ("_file", "_line", "_refused", "_unread")


def landed(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Every line of recorded polls that is not blank, with what became of it.

    Observations as in ``polls``, and ``_file``, ``_line`` (the text), ``_refused`` (why the line is
    no observation: ``malformed`` or ``no contract``; null if it is one) and ``_unread`` (names of the
    fields whose value is there but does not parse; such a value is null). A file that cannot be read
    is an empty poll.
    """
    text = ", ".join(f"{f} string" for f in FIELDS)
    lines = (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_line"))
        .where(r"_line rlike '\\S'")
    )
    row = F.from_json("_line", f"{text}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    read = lines.withColumn("_row", row).select("_file", "_line", "_row.*")
    typed = {
        **{c: F.col(c).try_cast("decimal(38,6)").try_cast("bigint") for c in WHOLE},
        **{c: F.col(c).try_cast("double") for c in DECIMAL},
    }
    unread = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in typed.items()]))
    refused = F.when(F.col("_bad").isNotNull(), "malformed").when(F.col("contract").isNull(), "no contract")
    checked = read.withColumns({"_refused": refused, "_unread": unread})
    return checked.withColumns(typed).select(*FIELDS, *LANDED)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> int:
    """Process everything landed so far in micro-batches, then stop. Returns the last batch id."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    progress = query.lastProgress
    return progress["batchId"] if progress else -1


def windowed_bars(observations: DataFrame, width: str = "4 hours", lateness: str = "20 minutes") -> DataFrame:
    """Candles from an observation stream: tumbling windows that close after the lateness."""
    at = F.timestamp_millis("observed_at_ms")
    order = F.struct("observed_at_ms", "pos")
    bars = (
        observations.withColumn("_at", at)
        .withWatermark("_at", lateness)
        .groupBy("contract", F.window("_at", width).alias("_w"))
        .agg(
            F.min_by("mcap_usd", order).alias("o"),
            F.max("mcap_usd").alias("h"),
            F.min("mcap_usd").alias("l"),
            F.max_by("mcap_usd", order).alias("c"),
            F.count("*").alias("v"),
        )
    )
    return bars.select("contract", F.unix_millis("_w.start").alias("t"), "o", "h", "l", "c", "v")
