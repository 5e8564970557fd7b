"""Keyed state, timers and refused lines: the same rows however a stream is cut, ordered or restarted."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import flow
from tidewatch.catalog import inputs as I
from tidewatch.operators import outcomes, social
from tidewatch.session import scratch_table
from tidewatch.streaming import cycle, keyed, replay
from tidewatch.streaming.tables import Tables

LINE = '{"poll_id": %d, "pos": %d, "chain": "c0", "contract": "%s", "observed_at_ms": %d, "mcap_usd": %s}'
START = 1_704_067_200_000


def crossings(df):
    return Counter((r.chain, r.contract, r.observed_at_ms, r.pos, r.trigger_kind) for r in df.collect())


def test_a_token_fires_once_at_any_batch_size_and_across_a_restart(spark, sf, tmp_path):
    path = flow.poll_files(spark, sf)
    want = Counter((r.chain, r.contract, r.ts) for r in I.snapshots_job(spark, sf).collect())
    for files in (1, 7):
        out = flow.appended(spark, keyed.fired_once(replay.polls(spark, f"{path}/*", files)), scratch_table(spark, "s"))
        assert Counter((r.chain, r.contract, r.observed_at_ms) for r in out.collect()) == want
    # A second run goes on from the checkpoint: known tokens stay silent, a new one fires.
    mark, kept = scratch_table(spark, "s"), scratch_table(spark, "o")
    (tmp_path / "a.json").write_text("\n".join(LINE % (1, k, f"t{k % 3}", START + k, "300000.0") for k in range(30)))
    first = crossings(flow.appended(spark, keyed.fired_once(replay.polls(spark, str(tmp_path))), mark, kept))
    assert first == Counter({("c0", f"t{k}", START + k, k, "mcap_250k"): 1 for k in range(3)})
    (tmp_path / "b.json").write_text("\n".join(LINE % (2, 40 + k, f"t{k}", START + 40 + k, "300000.0") for k in range(4)))
    second = crossings(flow.appended(spark, keyed.fired_once(replay.polls(spark, str(tmp_path))), mark, kept))
    assert second == first + Counter({("c0", "t3", START + 43, 43, "mcap_250k"): 1})


def test_a_hot_token_reaches_its_state_as_one_row_per_task(spark):
    rows = spark.range(0, 9000, 1, 3).select(
        F.lit("c").alias("chain"), F.concat(F.lit("t"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0)).alias("contract"),
        (F.lit(START) - F.col("id")).alias("observed_at_ms"), F.col("id").alias("pos"), F.lit("k").alias("trigger_kind"),
        F.lit(1.0).alias("mcap_usd"), F.lit(None).cast("bigint").alias("holder_count"),
    )
    reduced = keyed.earliest_in_task(rows)
    assert reduced.where("contract = 't0'").count() <= 3
    assert reduced.groupBy("contract").agg(F.min("observed_at_ms")).where("contract = 't0'").first()[1] == START - 8999
    assert reduced.select("contract").distinct().count() == 900


def test_flags_may_be_given_a_time_to_live(spark, tmp_path):
    (tmp_path / "a.json").write_text(LINE % (1, 1, "t", START, "300000.0"))
    out, fired = scratch_table(spark, "o"), keyed.fired_once(replay.polls(spark, str(tmp_path)), keep_ms=3_600_000)
    # Expiring state wakes a stream for ever, so only one batch is asked for.
    sink = fired.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_table(spark, "s"))
    sink.trigger(once=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 1


@pytest.mark.parametrize("files, order, per_trigger", [(1, "a", 1), (6, "b", 1), (6, "c", 4)])
def test_missed_readings_do_not_depend_on_the_order_of_files(spark, sf, files, order, per_trigger):
    got = flow.stream_readings(spark, sf, files, order, per_trigger)
    read = [r.asDict() for r in I.social(spark, sf).collect()]
    want = Counter(
        (r["snapshot_id"], r["platform"], r["offset_minutes"], r["age_minutes"], r["age_minutes"] - r["offset_minutes"] > 20, r["error"]) for r in read
    )
    in_time = {k[:3] for k in want if not k[4]}
    for s in I.snapshots(spark, sf).select("snapshot_id").collect():
        for platform in ("x", "telegram"):
            for offset in social.OFFSETS:
                if (s.snapshot_id, platform, offset) not in in_time:
                    want[s.snapshot_id, platform, offset, offset + 21, True, "missed"] += 1
    names = ("snapshot_id", "platform", "offset_minutes", "age_minutes", "late", "error")
    assert Counter(tuple(r) for r in got.select(*names).collect()) == want
    assert any(k[5] == "missed" for k in want) and any(k[5] != "missed" for k in want)


def test_every_line_is_read_or_refused(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        "\n".join(
            [LINE % (1, 1, "t1", START, "300000.0"), "{broken", "", '{"poll_id": 1, "pos": 2}', "[1, 2", "   ", LINE % (1, 3, "t3", START, '"abc"'),
             LINE % (1, 4, "t4", START, "null"), "{broken"]
        )
    )
    (tmp_path / "b.json").write_text("not json at all\n" + LINE % (2, 5, "t5", START + 9, "1.0") + "\n")
    (tmp_path / "c.json.gz").write_bytes(b"\x1f\x8b\x08\x00 cut short")
    tables, summary = Tables(spark, scratch_table(spark, "t")), []
    for _ in range(2):  # A fresh checkpoint reads all again and keeps nothing twice.
        summary.clear()
        stream = replay.landed(spark, str(tmp_path), 1)
        replay.drain(stream, scratch_table(spark, "s"), cycle.on_batch(tables, "replay", summary, False))
        total = {k: sum(s[k] for s in summary) for k in ("landed", "read", "refused", "unread", "observed")}
        assert total == {"landed": 9, "read": 4, "refused": 5, "unread": 1, "observed": 4}
        kept = Counter((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in spark.read.parquet(tables.path("refused")).collect())
        assert kept == Counter({
            ("a.json", "{broken", "malformed"): 2, ("a.json", '{"poll_id": 1, "pos": 2}', "no contract"): 1,
            ("a.json", "[1, 2", "malformed"): 1, ("b.json", "not json at all", "malformed"): 1,
        })


def test_labels_open_only_the_snapshots_of_the_window_before(spark, tmp_path, monkeypatch):
    day = 86_400_000
    tables = Tables(spark, scratch_table(spark, "t"))
    for k in (0, 20, 40):
        poll = "\n".join(LINE % (k, 10 * k + j, f"t{k}-{j}", START + k * day + j, "300000.0") for j in range(3))
        file = tmp_path / f"{k:02d}.json"
        file.write_text(poll + "\n" + LINE % (k, 10 * k + 9, f"t{k}-0", START + k * day + 3_600_000, "400000.0"))
        os.utime(file, (START // 1000 + k, START // 1000 + k))  # Files are taken by age.
    opened, touched = [], cycle.touched
    monkeypatch.setattr(
        cycle, "touched", lambda snaps, *rest: opened.append(snaps._jdf.queryExecution().executedPlan().toString()) or touched(snaps, *rest)
    )
    replay.drain(replay.polls(spark, str(tmp_path), 1), scratch_table(spark, "s"), cycle.on_batch(tables, "replay"))
    assert outcomes.WINDOW_MINUTES == 7 * 24 * 60 and len(opened) == 3
    assert spark.read.parquet(tables.path("snapshots")).select("snapshot_date").distinct().count() == 3
    # The labels before the third batch are of day 21: it closes horizons of snapshots from day 14 on.
    dates = [p.split("PartitionFilters: [")[1].split("]")[0] for p in opened[1:]]
    assert "2023-12-25" in dates[0] and "2024-01-14" in dates[1], dates
