"""Append-only tables on files: JSON-lines journals, synced appends, exports and mirrors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import keys
from tidewatch.schema import TABLES

# Shard names are <table>/<day>[.<rollover>].jsonl after one older <table>.jsonl. A shard
# is a file, or a folder of part files where a Spark job wrote it.
SHARD = r"/(\d{4}-\d{2}-\d{2})(?:\.(\d+))?\.jsonl(?:/part-[^/]*)?$"
ROWS_PER_FILE = 500_000


def json_cell(c: Column | str, kind: str, fallback: Column) -> Column:
    """A JSON text cell as a typed value; unreadable or missing text is the fallback."""
    return F.coalesce(F.from_json(c, kind), fallback)


def _typed(name: str, kind: T.DataType) -> Column:
    """Journal text to the column's type. Whole numbers may be written 500 or 500.0."""
    c = F.col(name)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return c.try_cast("decimal(38,6)").try_cast(kind.simpleString()).alias(name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        # Written either as a JSON value or as text holding one.
        return F.from_json(c, kind.simpleString()).alias(name)
    return c.try_cast(kind.simpleString()).alias(name)


def files(spark: SparkSession, table: str, directory: str) -> list[str]:
    """Journal paths of a table that exist: the older single file and the shard folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in (f"{directory}/{table}.jsonl", f"{directory}/{table}"):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            found.append(path)
    return found


def read(spark: SparkSession, table: str, directory: str) -> DataFrame:
    """Every journal row of a table, typed, with its append position in ``_at``.

    Malformed lines are left out. Rows order by (day, rollover, block, line); the older single
    file comes first because it has no day.
    """
    schema = TABLES[table].schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    text.add("_bad", T.StringType())
    paths = files(spark, table, directory)
    if not paths:
        return spark.createDataFrame([], schema).withColumn("_at", F.lit(None).cast("string"))
    raw = (
        spark.read.schema(text)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", "true")
        .json(paths)
        .withColumns(
            {
                "_path": F.col("_metadata.file_path"),
                "_block": F.col("_metadata.file_block_start"),
                "_line": F.monotonically_increasing_id(),
            }
        )
    )
    shard = F.col("_path").rlike(SHARD)
    older = F.col("_path").endswith(f"/{table}.jsonl")
    at = F.struct(
        F.regexp_extract("_path", SHARD, 1).alias("day"),
        F.coalesce(F.regexp_extract("_path", SHARD, 2).try_cast("int"), F.lit(0)).alias("rollover"),
        F.col("_block").alias("block"),
        F.col("_line").alias("line"),
    )
    return raw.where(F.col("_bad").isNull() & (shard | older)).select(
        *[_typed(f.name, f.dataType) for f in schema.fields], at.alias("_at")
    )


def restore(spark: SparkSession, table: str, directory: str, existing: DataFrame | None = None) -> DataFrame:
    """Journal rows that may enter the table: first wins on the key and every unique group."""
    spec = TABLES[table]
    rows = read(spark, table, directory)
    groups = [[spec.key], *[list(g) for g in spec.unique]]
    if len(groups) == 1:
        keyed = keys.first(rows.where(F.col(spec.key).isNotNull()), [spec.key], ["_at"])
        if existing is not None:
            keyed = keys.append_new(keyed, existing, [spec.key])
        return keyed.drop("_at")
    return keys.first_wins(rows, "_at", groups, [spec.key], existing).drop("_at")


def _next_shard(spark: SparkSession, table: str, directory: str, day: str) -> str:
    """The first shard name of a day that no file or folder has."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{table}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()
    tried = [f"{day}.jsonl", *(f"{day}.{k}.jsonl" for k in range(1, len(names) + 1))]
    return f"{directory}/{table}/{next(n for n in tried if n not in names)}"


def append(df: DataFrame, table: str, directory: str, day: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Append rows to a table's journal as the next shard of a day, in files of bounded size.

    Nothing is rewritten, and a shard appears whole: ``read`` sees it once the job has committed.
    """
    doc = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    shard = _next_shard(df.sparkSession, table, directory, day)
    df.select(doc).write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).text(shard)


def sync(new: DataFrame, table: str, directory: str, day: str) -> None:
    """Append the rows whose key the journal lacks; a second run appends nothing."""
    key = TABLES[table].key
    append(keys.append_new(new, read(new.sparkSession, table, directory), [key]), table, directory, day)


def bulk_load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newline-delimited JSON with explicit types; whole numbers are read as text first."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return spark.read.schema(text).json(path).select(*[_typed(f.name, f.dataType) for f in schema.fields])


def export(snapshots: DataFrame, path: str) -> str:
    """Parquet export by snapshot date into a fresh folder; an existing one is refused."""
    snapshots.write.mode("errorifexists").partitionBy("snapshot_date").parquet(path)
    return path


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    per = [df.agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), per).select("table", "rows")


def manifest(tables: dict[str, DataFrame], appended: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and rows appended by the last run."""
    now = counts(tables)
    last = counts(appended).withColumnRenamed("rows", "appended") if appended else None
    if last is None:
        return now.withColumn("appended", F.lit(0).cast("bigint"))
    return now.join(last, "table", "left").withColumn("appended", F.coalesce("appended", F.lit(0)))


def pull(source: DataFrame, mirror: DataFrame, seq: str = "seq") -> DataFrame:
    """Source rows past the mirror's high-water mark.

    The mark is one number, so it is read once and becomes a pushed-down filter on the source.
    """
    high = mirror.agg(F.max(seq)).first()[0]
    return source if high is None else source.where(F.col(seq) > high)


def reconcile(source: DataFrame, mirror: DataFrame, by: str) -> DataFrame:
    """Counts per table on both sides and whether the mirror must be rebuilt."""
    s = source.groupBy(by).agg(F.count("*").alias("source_rows"))
    m = mirror.groupBy(by).agg(F.count("*").alias("mirror_rows"))
    none = F.lit(0).cast("bigint")
    both = s.join(m, by, "full").withColumns(
        {c: F.coalesce(c, none) for c in ("source_rows", "mirror_rows")}
    )
    return both.withColumn("rebuild", F.col("source_rows") != F.col("mirror_rows"))


def store(new: DataFrame, table: str, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused) against a stored table's key and unique groups."""
    spec = TABLES[table]
    groups = [[spec.key], *[list(g) for g in spec.unique]]
    fresh = new
    for g in groups:
        fresh = keys.append_new(fresh, stored, g)
    refused = new.join(fresh.select(spec.key), spec.key, "left_anti")
    return fresh, refused
