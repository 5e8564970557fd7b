"""Mention-search payloads to raw counts, and channel previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import number
from tidewatch.operators.social import TIER1_FOLLOWERS


def counts(posts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per search from post rows (author_id, followers, likes, reposts, is_reply)."""
    engaged = F.coalesce("likes", F.lit(0)) + F.coalesce("reposts", F.lit(0)) > 0
    return posts.groupBy(*keys).agg(
        F.count("*").alias("mentions_window"),
        F.nullif(F.countDistinct(F.nullif("author_id", F.lit(""))), F.lit(0)).alias("unique_authors"),
        F.nullif(F.coalesce(F.sum("followers"), F.lit(0.0)), F.lit(0.0)).alias("follower_weighted_reach"),
        F.count_if((F.col("followers") >= TIER1_FOLLOWERS) & engaged).alias("tier1_organic_engagements"),
        F.count_if("is_reply").alias("replies"),
        F.count_if(~F.col("is_reply")).alias("posts"),
    )


def searches(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Search payloads to counts. A payload holds one page of posts and the authors on it."""
    schema = (
        "struct<data:array<struct<author_id:string,public_metrics:struct<like_count:string,"
        "retweet_count:string>,referenced_tweets:array<struct<type:string>>>>,"
        "includes:struct<users:array<struct<id:string,public_metrics:struct<followers_count:string>>>>>"
    )
    parsed = payloads.select(*keys, F.from_json(payload, schema).alias("p"))
    # Authors of the same page, last entry of an id winning, as a map inside the row.
    followers = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform("p.includes.users", lambda u: u["id"])),
            lambda i: F.struct(
                i,
                F.element_at(F.filter("p.includes.users", lambda u: u["id"] == i), -1)["public_metrics"][
                    "followers_count"
                ],
            ),
        )
    )
    empty = F.create_map().cast("map<string,string>")
    rows = parsed.select(*keys, F.coalesce(followers, empty).alias("f"), F.explode_outer("p.data").alias("t"))
    t = F.col("t")
    known = number(F.try_element_at("f", t["author_id"]))
    posts = rows.select(
        *keys,
        t.isNotNull().alias("_real"),
        t["author_id"].alias("author_id"),
        F.when(known > 0, known).alias("followers"),
        number(t["public_metrics"]["like_count"]).alias("likes"),
        number(t["public_metrics"]["retweet_count"]).alias("reposts"),
        F.coalesce(
            F.exists(t["referenced_tweets"], lambda r: r["type"].eqNullSafe("replied_to")), F.lit(False)
        ).alias("is_reply"),
    )
    found = counts(posts.where("_real"), keys)
    zero = {c: 0 for c in ("mentions_window", "tier1_organic_engagements", "replies", "posts")}
    return (
        parsed.select(*keys)
        .distinct()
        .join(found, keys, "left")
        .withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zero.items()})
    )
