"""Streams leave the same tables however they are batched, and re-running adds nothing."""

from pyspark.sql import functions as F

from tidewatch.catalog import flow
from tidewatch.catalog import inputs as I
from tidewatch.operators import keys
from tidewatch.session import scratch_table
from tidewatch.streaming import cycle, replay
from tidewatch.streaming.tables import Tables


def facts(df):
    cols = ["chain", "contract", "ts", "trigger_kind", "market_mcap_usd", "mindshare_rank"]
    return sorted(map(tuple, df.select(*cols).collect()))


def test_batching_and_restarts_do_not_change_the_result(spark, sf):
    path = flow.poll_files(spark, sf)
    results = []
    for files in (1, 4):
        tables = Tables(spark, scratch_table(spark, "t"))
        handle = cycle.on_batch(tables, "replay", label=False)
        replay.drain(replay.polls(spark, f"{path}/*", files), scratch_table(spark, "s"), handle)
        results.append(facts(spark.read.parquet(tables.path("snapshots"))))
    assert results[0] == results[1]
    want = sorted((r["chain"], r["contract"], r["ts"]) for r in I.snapshots_job(spark, sf).collect())
    assert [r[:3] for r in results[0]] == want
    # A fresh checkpoint on the same tables replays every poll: nothing fires twice.
    summary = []
    replay.drain(replay.polls(spark, f"{path}/*", 4), scratch_table(spark, "s"), cycle.on_batch(tables, "replay", summary, False))
    assert sum(s["fired"] for s in summary) == 0
    assert facts(spark.read.parquet(tables.path("snapshots"))) == results[0]
    assert spark.read.parquet(tables.path("trigger_events")).count() == len(results[0])


def test_labels_do_not_depend_on_batching_and_a_batch_reads_its_own_dates(spark, sf):
    path, newest = flow.poll_files(spark, sf), []
    for files in (1, 7):
        tables = Tables(spark, scratch_table(spark, "t"))
        mark = scratch_table(spark, "s")
        replay.drain(replay.polls(spark, f"{path}/*", files), mark, cycle.on_batch(tables, "replay"))
        # A restart with the same checkpoint has nothing left to do.
        replay.drain(replay.polls(spark, f"{path}/*", files), mark, cycle.on_batch(tables, "replay"))
        rows = keys.latest(spark.read.parquet(tables.path("labels")), ["snapshot_id"], ["filled_at_ms", "label_id"])
        newest.append(sorted(map(tuple, rows.select("snapshot_id", "max_multiple_1h", "max_multiple_24h", "survived_24h").collect()), key=str))
    assert newest[0] == newest[1] and newest[0]
    stored = spark.read.parquet(tables.path("outcome_observations"))
    days = [r[0] for r in stored.select("observed_date").distinct().orderBy("observed_date").collect()]
    one = stored.where(F.col("observed_date").isin(days[:1]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert len(days) > 1 and "PartitionFilters: [observed_date" in plan.replace("isnotnull(observed_date", "observed_date")
    assert len(one.inputFiles()) <= len(stored.inputFiles())


def test_an_unreadable_poll_is_an_empty_poll(spark, tmp_path):
    good = '{"poll_id": 1, "pos": %d, "chain": "c0", "contract": "t%d", "observed_at_ms": 1704067200000, "mcap_usd": 300000.0}'
    (tmp_path / "a.json").write_text(good % (1, 1) + "\n")
    (tmp_path / "b.json.gz").write_bytes(b"\x1f\x8b\x08\x00 cut short")
    (tmp_path / "c.json").write_text(good % (2, 2) + "\n{broken\n")
    tables = Tables(spark, scratch_table(spark, "t"))
    summary = []
    replay.drain(replay.polls(spark, str(tmp_path)), scratch_table(spark, "s"), cycle.on_batch(tables, "replay", summary, False))
    assert sum(s["observed"] for s in summary) == 2 and sum(s["fired"] for s in summary) == 2
