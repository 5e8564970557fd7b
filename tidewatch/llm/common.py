"""What the operators of this package share: words, row ids, stored tables, Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.session import scratch_table

#: Fixed value: what separates words.
SPACES = r"[\x20\x09-\x0D]+"

#: Narrow rows that one task takes on easily.
TASK_ROWS = 250_000
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def pin_scans(spark: SparkSession) -> None:
    """Fix how the session cuts files into partitions, unless it is set already.

    Otherwise the cut follows the cores registered when a scan is planned, and an executor that
    comes or goes between two scans of a table changes the numbers of its rows.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", int(cores))


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows of a stored table; the same scan gives the same numbers each time it is read."""
    pin_scans(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once to the shared folder and read it back.

    Readers then share one set of rows, and a lost executor costs a file read, not a recomputation.
    """
    spark, path = df.sparkSession, scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized_for(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as ``rows`` rows need, where that is fewer than it has.

    Rounds over a small table then start a few tasks each, and over a large one as many as before.
    """
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_of(rows: DataFrame, key: str = "_rid", chunk_bytes: int = 16 << 20) -> Column:
    """A number for the rows that one task reads of the same bounded piece of a stored table.

    The same scan gives a row the same chunk each time it is read.
    """
    pin_scans(rows.sparkSession)
    named = rows.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    digits = named.rstrip("kmgt")
    read = int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[named[len(digits) :]]
    pieces = max(1, -(-read // chunk_bytes))
    return (F.spark_partition_id() * pieces + F.pmod(F.xxhash64(key), F.lit(pieces))).cast("long")


def in_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches small enough for several Python workers beside an executor's heap."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow form of a schema."""
    of = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(of)
