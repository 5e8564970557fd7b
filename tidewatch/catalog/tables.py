"""Latest/first rows, dedupe, append-only sync, lookups and counts over the stand-in tables."""

from pyspark.sql import functions as F

from tidewatch.catalog import inputs as I
from tidewatch.catalog import register
from tidewatch.catalog.sql import define, labels_sql
from tidewatch.operators import keys, outcomes

# A score history per token: each event is a scoring run of that token.
define(
    "score_",
    """SELECT 'r' || pos AS score_id, 's' || user_id AS snapshot_id, observed_at_ms AS scored_at_ms,
  CASE WHEN pos % 4 <> 0 THEN round(value / 5, 6) END AS score, pos % 4 = 0 AS excluded,
  (pos % 100 < 97)::INT + 1 AS prompt_version, 'w' || (pos % 3 > 0)::INT AS weights_version
  FROM ev_""",
)


def scores(spark, d):
    """The events of each token as its score history."""
    e = I.events(spark, d)
    p = F.col("pos")
    return e.select(
        F.concat(F.lit("r"), p).alias("score_id"),
        F.concat(F.lit("s"), "user_id").alias("snapshot_id"),
        F.col("observed_at_ms").alias("scored_at_ms"),
        F.when(p % 4 != 0, F.round(F.col("value") / 5, 6)).alias("score"),
        (p % 4 == 0).alias("excluded"),
        ((p % 100 < 97).cast("int") + 1).alias("prompt_version"),
        F.concat(F.lit("w"), (p % 3 > 0).cast("int")).alias("weights_version"),
    )


@register(
    "w01_latest_per_key",
    """SELECT * FROM score_ QUALIFY row_number() OVER (PARTITION BY snapshot_id
    ORDER BY scored_at_ms DESC, score_id DESC) = 1""",
)
def w01(spark, d):
    return keys.latest(scores(spark, d), ["snapshot_id"], ["scored_at_ms", "score_id"])


@register(
    "w02_first_per_key",
    """SELECT * FROM score_ QUALIFY row_number() OVER (PARTITION BY snapshot_id
    ORDER BY scored_at_ms, score_id) = 1""",
)
def w02(spark, d):
    return keys.first(scores(spark, d), ["snapshot_id"], ["scored_at_ms", "score_id"])


@register(
    "j04_trigger_time_scores",
    """SELECT s.snapshot_id, s.ts AS snapshot_ts, f.score_id, f.scored_at_ms, f.score FROM snap_ s JOIN
    (SELECT * FROM score_ QUALIFY row_number() OVER (PARTITION BY snapshot_id
    ORDER BY scored_at_ms, score_id) = 1) f USING (snapshot_id)""",
)
def j04(spark, d):
    first = keys.first(scores(spark, d), ["snapshot_id"], ["scored_at_ms", "score_id"])
    return (
        I.snapshots(spark, d)
        .select("snapshot_id", F.col("ts").alias("snapshot_ts"))
        .join(first, "snapshot_id")
        .select("snapshot_id", "snapshot_ts", "score_id", "scored_at_ms", "score")
    )


@register(
    "j03_newest_score",
    """SELECT s.snapshot_id, s.chain, n.score_id, n.score FROM snap_ s LEFT JOIN
    (SELECT * FROM score_ QUALIFY row_number() OVER (PARTITION BY snapshot_id
    ORDER BY scored_at_ms DESC, score_id DESC) = 1) n USING (snapshot_id)""",
)
def j03(spark, d):
    newest = keys.latest(scores(spark, d), ["snapshot_id"], ["scored_at_ms", "score_id"])
    return (
        I.snapshots(spark, d)
        .select("snapshot_id", "chain")
        .join(newest.select("snapshot_id", "score_id", "score"), "snapshot_id", "left")
    )


# Two label batches, an early and a late one, as the stored label history.
define(
    "labelhist_",
    f"""SELECT 'l' || {I.AS_OF_EARLY} || snapshot_id AS label_id, {I.AS_OF_EARLY} AS filled_at_ms, *
  FROM labels_early_ UNION ALL BY NAME SELECT 'l' || {I.AS_OF_LATE} || snapshot_id AS label_id,
  {I.AS_OF_LATE} AS filled_at_ms, * FROM labels_late_""",
)


def label_history(spark, d):
    def batch(as_of):
        return I.labels(spark, d, as_of).select(
            F.concat(F.lit(f"l{as_of}"), "snapshot_id").alias("label_id"),
            F.lit(as_of).cast("bigint").alias("filled_at_ms"),
            "*",
        )

    return batch(I.AS_OF_EARLY).unionByName(batch(I.AS_OF_LATE))


@register(
    "j01_latest_label",
    """SELECT s.snapshot_id, s.trigger_kind, l.label_id, l.max_multiple_24h, l.survived_24h
    FROM snap_ s LEFT JOIN (SELECT * FROM labelhist_ QUALIFY row_number() OVER
    (PARTITION BY snapshot_id ORDER BY filled_at_ms DESC, label_id DESC) = 1) l USING (snapshot_id)""",
)
def j01(spark, d):
    newest = keys.latest(label_history(spark, d), ["snapshot_id"], ["filled_at_ms", "label_id"])
    return (
        I.snapshots(spark, d)
        .select("snapshot_id", "trigger_kind")
        .join(newest.select("snapshot_id", "label_id", "max_multiple_24h", "survived_24h"), "snapshot_id", "left")
    )


@register(
    "a12_survivor_counts",
    """SELECT count(*) FILTER (survived_24h) AS survivors, count(*) FILTER (NOT survived_24h) AS dead
    FROM (SELECT * FROM labelhist_ QUALIFY row_number() OVER (PARTITION BY snapshot_id
    ORDER BY filled_at_ms DESC, label_id DESC) = 1)""",
)
def a12(spark, d):
    newest = keys.latest(label_history(spark, d), ["snapshot_id"], ["filled_at_ms", "label_id"])
    return newest.agg(
        F.count_if("survived_24h").alias("survivors"), F.count_if(~F.col("survived_24h")).alias("dead")
    )


_SAME = " AND ".join(f"n.{c} IS NOT DISTINCT FROM o.{c}" for c in outcomes.LABEL_COLUMNS)
_NONE = " AND ".join(f"n.{c} IS NULL" for c in outcomes.LABEL_COLUMNS)


@register(
    "u03_changed_labels",
    f"""SELECT n.* FROM labels_late_ n LEFT JOIN labels_early_ o USING (snapshot_id)
    WHERE NOT ({_NONE}) AND (o.snapshot_id IS NULL OR NOT ({_SAME}))""",
)
def u03(spark, d):
    stored = I.labels(spark, d, I.AS_OF_EARLY).select(
        F.concat(F.lit("l"), "snapshot_id").alias("label_id"),
        F.lit(I.AS_OF_EARLY).alias("filled_at_ms"),
        "*",
    )
    return outcomes.refresh(I.labels(spark, d), stored)


@register(
    "u04_changed_scores",
    """SELECT n.* FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY
      snapshot_id ORDER BY scored_at_ms DESC, score_id DESC) AS rn FROM score_) WHERE rn = 1) n
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id
      ORDER BY scored_at_ms DESC, score_id DESC) AS rn FROM score_
      WHERE scored_at_ms <= 1704758400000) WHERE rn = 1) o USING (snapshot_id)
    WHERE n.score IS DISTINCT FROM o.score OR n.excluded <> o.excluded
      OR n.prompt_version <> o.prompt_version OR n.weights_version <> o.weights_version""",
)
def u04(spark, d):
    from tidewatch.plans import scoring

    history = scores(spark, d)
    newest = keys.latest(history, ["snapshot_id"], ["scored_at_ms", "score_id"])
    stored = history.where(F.col("scored_at_ms") <= I.AS_OF_LATE)
    known = newest.join(stored.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    return scoring.changed_scores(
        known, stored, ["score", "excluded", "prompt_version", "weights_version"], ("score",)
    )


@register(
    "u01_first_wins_dedupe",
    """SELECT pos, chain, contract, event_type FROM ev_ QUALIFY row_number() OVER
    (PARTITION BY chain, contract ORDER BY pos) = 1""",
)
def u01(spark, d):
    e = I.events(spark, d).select("pos", "chain", "contract", "event_type")
    return keys.first_wins(e, "pos", [["pos"], ["chain", "contract"]], ["contract"])


define(
    "claim_",
    """SELECT pos, pos * 7 % 1009 AS row_key, chain, CASE WHEN pos % 19 <> 0 THEN contract END AS contract, row_number() OVER (ORDER BY pos) AS k FROM ev_""",
)
define(
    "claimed_",
    """WITH RECURSIVE w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS held_rows, []::VARCHAR[] AS held_tokens, false AS won
  UNION ALL SELECT k, CASE WHEN won THEN list_append(held_rows, row_key) ELSE held_rows END,
    CASE WHEN won AND token IS NOT NULL THEN list_append(held_tokens, token) ELSE held_tokens END, won
  FROM (SELECT c.k, held_rows, held_tokens, row_key, chain || '/' || contract AS token, NOT list_contains(held_rows, row_key)
    AND (contract IS NULL OR NOT list_contains(held_tokens, chain || '/' || contract)) AS won FROM w JOIN claim_ c ON c.k = w.k + 1))
  SELECT k FROM w WHERE won""",
)


@register("u01_first_wins_two_groups", "SELECT pos, row_key, chain, contract FROM claim_ JOIN claimed_ USING (k)")
def u01_two(spark, d):
    e = I.events(spark, d).select(
        "pos",
        (F.col("pos") * 7 % 1009).alias("row_key"),
        "chain",
        F.when(F.col("pos") % 19 != 0, F.col("contract")).alias("contract"),
    )
    return keys.first_wins(e, "pos", [["row_key"], ["chain", "contract"]])


@register(
    "s03_sync_new_rows",
    """SELECT score_id, snapshot_id FROM score_ WHERE score_id NOT IN
    (SELECT score_id FROM score_ WHERE scored_at_ms <= 1704758400000)""",
)
def s03(spark, d):
    rows = scores(spark, d).select("score_id", "snapshot_id", "scored_at_ms")
    journal = rows.where(F.col("scored_at_ms") <= I.AS_OF_LATE)
    return keys.append_new(rows, journal, ["score_id"]).select("score_id", "snapshot_id")


@register(
    "j05_orphan_observations",
    """SELECT count(*) FILTER (s.contract IS NOT NULL) AS accepted, count(*) FILTER (s.contract IS NULL) AS refused FROM
    (SELECT contract FROM ev_ UNION ALL SELECT contract || '-x' FROM ev_ WHERE event_type = 'click') e LEFT JOIN snap_ s USING (contract)""",
)
def j05(spark, d):
    e = I.events(spark, d)
    known = e.select(F.concat(F.lit("s"), "user_id").alias("snapshot_id"), "pos")
    # Clicks come once more for snapshots that are not there.
    lost = e.where("event_type = 'click'").select(F.concat(F.lit("s"), "user_id", F.lit("-x")).alias("snapshot_id"), "pos")
    ok, refused = outcomes.accept_observations(known.unionByName(lost), I.snapshots(spark, d).select("snapshot_id"))
    tagged = ok.select(F.lit(True).alias("ok")).unionByName(refused.select(F.lit(False).alias("ok")))
    return tagged.agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("refused"))


@register(
    "j06_not_yet_triggered",
    """SELECT chain, contract, count(*) AS n FROM ev_ WHERE contract NOT IN
    (SELECT contract FROM snap_ WHERE ts <= 1704080000000) GROUP BY 1, 2""",
)
def j06(spark, d):
    from tidewatch.operators import trigger

    fired = I.snapshots(spark, d).where("ts <= 1704080000000")
    return (
        trigger.not_yet_fired(I.events(spark, d), fired)
        .groupBy("chain", "contract")
        .agg(F.count("*").alias("n"))
    )


@register(
    "a03_chain_and_trigger_breakdown",
    """SELECT 'chain' AS kind, chain AS name, count(*) AS n FROM snap_ GROUP BY 2 UNION ALL
    SELECT 'trigger', trigger_kind, count(*) FROM snap_ GROUP BY 2 UNION ALL
    SELECT 'date', strftime(make_timestamp(ts * 1000), '%Y-%m-%d'), count(*) FROM snap_ GROUP BY 2""",
)
def a03(spark, d):
    date = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    facts = F.array(
        F.struct(F.lit("chain").alias("kind"), F.col("chain").alias("name")),
        F.struct(F.lit("trigger").alias("kind"), F.col("trigger_kind").alias("name")),
        F.struct(F.lit("date").alias("kind"), date.alias("name")),
    )
    rows = I.snapshots(spark, d).select(F.explode(facts).alias("f")).select("f.*")
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


@register(
    "a04_table_counts",
    """SELECT (SELECT count(*) FROM score_) AS score_rows, (SELECT count(DISTINCT snapshot_id) FROM score_)
    AS scored_snapshots, (SELECT count(*) FROM soc_) AS social_rows,
    (SELECT count(DISTINCT snapshot_id) FROM soc_) AS social_snapshots""",
)
def a04(spark, d):
    s, soc = scores(spark, d), I.social(spark, d)
    both = s.select(F.lit("score").alias("t"), "snapshot_id").unionByName(
        soc.select(F.lit("social").alias("t"), "snapshot_id")
    )
    per = both.groupBy("t", "snapshot_id").agg(F.count("*").alias("n"))
    return per.agg(
        *[
            c
            for t, rows, ids in (
                ("score", "score_rows", "scored_snapshots"),
                ("social", "social_rows", "social_snapshots"),
            )
            for c in (
                F.coalesce(F.sum(F.when(F.col("t") == t, F.col("n"))), F.lit(0)).alias(rows),
                F.count_if(F.col("t") == t).alias(ids),
            )
        ]
    )


@register(
    "a29_last_observation",
    """SELECT snapshot_id, max(scored_at_ms) AS last_ts, count(*) AS n FROM score_ GROUP BY 1""",
)
def a29(spark, d):
    return scores(spark, d).groupBy("snapshot_id").agg(
        F.max("scored_at_ms").alias("last_ts"), F.count("*").alias("n")
    )


@register(
    "o01_recent_snapshots",
    "SELECT snapshot_id, ts, chain FROM snap_ ORDER BY ts DESC, snapshot_id LIMIT 40",
)
def o01(spark, d):
    from tidewatch.plans import scoring

    return scoring.newest(I.snapshots(spark, d), 40).select("snapshot_id", "ts", "chain")


@register("p24_point_lookup", "SELECT snapshot_id, chain, contract, ts, true AS has_triggered FROM snap_ WHERE chain = 'c2' AND contract = 't6'")
def p24(spark, d):
    return (
        I.snapshots(spark, d)
        .where((F.col("chain") == "c2") & (F.col("contract") == "t6"))
        .select("snapshot_id", "chain", "contract", "ts", F.lit(True).alias("has_triggered"))
    )


@register(
    "p28_labelling_base",
    "SELECT snapshot_id, ts, market_mcap_usd, chain, contract FROM snap_",
)
def p28(spark, d):
    return I.snapshots(spark, d).select("snapshot_id", "ts", "market_mcap_usd", "chain", "contract")


@register(
    "s07_export_columns",
    "SELECT score_id, snapshot_id, score FROM score_",
)
def s07(spark, d):
    return scores(spark, d).select("score_id", "snapshot_id", "score")


@register(
    "s10_bootstrap_first_wins",
    """SELECT key, pos, value FROM (SELECT CASE WHEN pos % 23 <> 0 THEN 'k' || (pos % 4999) END AS key, pos, value
    FROM ev_) WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1""",
)
def s10(spark, d):
    rows = I.events(spark, d).select(
        F.when(F.col("pos") % 23 != 0, F.concat(F.lit("k"), F.col("pos") % 4999)).alias("key"), "pos", "value"
    )
    return keys.first(rows.where("key is not null"), ["key"], ["pos"])
