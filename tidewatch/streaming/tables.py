"""Append-only parquet tables under one folder, as stream batches read and write them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import keys


@dataclass
class Tables:
    spark: SparkSession
    base: str

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        """The stored rows; an empty frame of the same shape before the first append."""
        if self.exists(name):
            return self.spark.read.schema(like.schema).parquet(self.path(name))
        return self.spark.createDataFrame([], like.schema)

    def append_new(self, name: str, rows: DataFrame, on: list[str], within: str | None = None, only: Column | None = None, partition: str | None = None) -> int:
        """Append the rows whose key the table lacks; returns how many those were.

        Re-running a batch after a failure appends nothing twice: rows already written hold their
        keys. With ``within``, a column that a key's rows share, the table is partitioned by it and
        only the partitions of this batch are read, so the cost is the batch's and not the
        table's; ``only`` says which stored rows can hold the keys at all. The count is observed by
        the write itself, not by a second pass. ``partition`` names a column to lay the table out by
        where a key's rows need not share it.
        """
        seen, stored = Observation(), self.read(name, rows)
        stored = stored if only is None else stored.where(only)
        if within is not None:
            # As many values as a batch spans, a handful of days.
            met = [r[0] for r in rows.select(within).distinct().collect()]
            stored = stored.where(F.col(within).isin(met))
        fresh = keys.append_new(rows, stored, on).observe(seen, F.count("*").alias("n"))
        writer = fresh.write.mode("append")
        by = within or partition
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        return seen.get["n"]
