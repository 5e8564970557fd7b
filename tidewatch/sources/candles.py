"""Candle and asset-context payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import number, whole

# Bar sizes in milliseconds.
INTERVAL_MS = {
    "1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000,
    "4h": 14_400_000, "1d": 86_400_000,
}


def candles(payloads: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """Typed OHLCV rows from lists of text-number bars; a bar without a time is dropped."""
    bar = "array<struct<t:string,o:string,h:string,l:string,c:string,v:string>>"
    rows = payloads.select(*keep, F.explode(F.from_json(payload, bar)).alias("b"))
    return rows.select(
        *keep, whole(F.col("b.t")).alias("t"), *[number(F.col(f"b.{k}")).alias(k) for k in "ohlcv"]
    ).where("t is not null")


def contexts(payloads: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """One row per listed asset from [meta, contexts]: two lists aligned by position."""
    parts = F.from_json(payload, "array<string>")
    meta = F.from_json(
        F.get(parts, F.lit(0)), "struct<universe:array<struct<name:string,isDelisted:boolean>>>"
    )["universe"]
    ctx = F.from_json(
        F.get(parts, F.lit(1)),
        "array<struct<markPx:string,prevDayPx:string,dayNtlVlm:string,openInterest:string,"
        "funding:string,impactPxs:array<string>>>",
    )
    rows = payloads.where(F.size(parts) == 2).select(
        *keep, F.explode(F.arrays_zip(meta.alias("m"), ctx.alias("x"))).alias("z")
    )
    m, x = F.col("z.m"), F.col("z.x")
    delisted = F.coalesce(m["isDelisted"], F.lit(False))
    return rows.where((m["name"] != "") & ~delisted).select(
        *keep,
        m["name"].alias("coin"),
        number(x["markPx"]).alias("mark_px"),
        number(x["prevDayPx"]).alias("prev_day_px"),
        number(x["dayNtlVlm"]).alias("day_ntl_vlm"),
        number(x["openInterest"]).alias("open_interest"),
        number(x["funding"]).alias("funding"),
        number(F.get(x["impactPxs"], F.lit(0))).alias("impact_bid"),
        number(F.get(x["impactPxs"], F.lit(1))).alias("impact_ask"),
    )


def notional() -> Column:
    """Money traded in a bar: volume times typical price."""
    return F.col("v") * (F.col("h") + F.col("l") + F.col("c")) / 3.0


def open_interest_usd() -> Column:
    return F.col("open_interest") * F.col("mark_px")


def impact_spread_bps() -> Column:
    mark = F.nullif("mark_px", F.lit(0.0))
    return F.try_divide(F.col("impact_ask") - F.col("impact_bid"), mark) * 10_000
