"""Session settings, the shared scratch folder, and durable cuts of lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def configure(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: UTC times and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, else one in the warehouse.

    Without the setting a cluster's warehouse has to be a shared store: a path on local disks, of
    which every machine has its own, is refused unless the session runs in one process.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        local = not re.match(r"[a-z0-9+.-]+://?", named) or named.startswith("file:")
        if local and not context.master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set and the warehouse {named} is not shared")
    if not current.isDefined():
        context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the checkpoint folder, so both readers of it see the same rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written intermediate; ``clear_scratch`` deletes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this session's ``scratch_table`` named; returns how many there were.

    For the end of a job: results not yet written may still read these tables.
    """
    mine = [path for s, path in _MADE if s is spark]
    _MADE[:] = [x for x in _MADE if x[0] is not spark]
    for path in mine:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    return len(mine)


@atexit.register
def _clear_all() -> None:
    for spark in {id(s): s for s, _ in _MADE}.values():
        # The session's process may be gone already; its tables then stay for the folder's owner.
        with contextlib.suppress(Exception):
            clear_scratch(spark)
