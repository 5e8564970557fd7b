"""Price zones: a fold over a coin's swings, cut into stretches that are walked on their own.

What a stretch needs from before is the zones that still stand and that it can break or come back
to: its seed. All stretches are walked at once from no seed; then the zones standing at each
stretch's end, a small table, are carried along the coin, past every stretch that leaves them
alone, and the stretches whose seed changed are walked again, until none does. Each round settles at
least one more stretch of every coin, and usually nearly all.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.operators.medians import medians
from tidewatch.session import durable

#: Bars of a stretch.
STRETCH = 4096
MIN_TOUCHES = 3

_ZONE = "struct<sign: int, start: bigint, outer: double, inner: double, touches: bigint>"
_WALK = (
    f"coin string, stretch bigint, tol double, seed array<{_ZONE}>, standing array<{_ZONE}>, "
    "broken array<struct<sign: int, start: bigint, outer: double, inner: double, touches: bigint, end: bigint>>, "
    "marks array<struct<sign: int, start: bigint, i: bigint, price: double>>, "
    "close_up double, close_down double, high_from double, high_to double, low_from double, low_to double"
)
_CARRY = f"coin string, stretch bigint, seed array<{_ZONE}>, changed boolean"


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def typical_range(bars: DataFrame) -> DataFrame:
    """(coin, tol): median bar range over bars that moved."""
    moved = F.when(F.col("h") > F.col("l"), F.col("h") - F.col("l"))
    return medians(bars, ["coin"], moved, "tol")


def _ladder(leg: list[dict], sign: int) -> tuple[list[float], list[int]]:
    """The signed closes of a leg that are higher than all before them, with their bars."""
    rungs, at = [], []
    for row in leg:
        if not rungs or sign * row["c"] > rungs[-1]:
            rungs.append(sign * row["c"])
            at.append(row["i"])
    return rungs, at


def _opened(swing: dict, sign: int, tol: float) -> tuple[float, float, float]:
    """(price, outer, inner) of the zone a swing would open: at least half a typical range thick."""
    price = sign * (swing["h"] if sign > 0 else swing["l"])
    first = swing["o"] or swing["c"]
    inner = max(sign * first, sign * swing["c"])
    # Ceilings grow inward, floors outward.
    return (price, price, min(inner, price - tol / 2)) if sign > 0 else (price, max(price, inner + tol / 2), inner)


def walk(rows: list[dict], seed: Iterable[dict], tol: float) -> tuple[list, list, list]:
    """One stretch: (standing, broken, marks) after its rows, from the zones of ``seed``.

    A floor is a ceiling in the mirror: prices are taken with a sign, so a zone runs from ``inner``
    out to ``outer`` and breaks at the first signed close beyond ``outer``. A leg runs up to the bar
    of a swing; the zones standing at its end are those that the swing can come back to.
    """
    standing: dict[int, list[dict]] = {1: [], -1: []}
    for zone in sorted(seed, key=lambda z: z["start"]):
        standing[zone["sign"]].append(dict(zone))
    broken, marks, leg = [], [], []
    for row in rows:
        leg.append(row)
        if not row["kinds"] and row is not rows[-1]:
            continue
        for sign, zones in standing.items():
            rungs, at = _ladder(leg, sign)
            ends = [bisect_right(rungs, z["outer"]) for z in zones]
            broken += [{**z, "end": at[k]} for z, k in zip(zones, ends) if k < len(rungs)]
            standing[sign] = [z for z, k in zip(zones, ends) if k == len(rungs)]
        leg = []
        for kind in row["kinds"] or ():
            sign = 1 if kind == "high" else -1
            price, outer, inner = _opened(row, sign, tol)
            for z in standing[sign]:
                wide = max(z["outer"], outer) - min(z["inner"], inner)
                if z["inner"] - tol <= price <= z["outer"] + tol and wide <= 3 * tol:
                    z.update(outer=max(z["outer"], outer), inner=min(z["inner"], inner), touches=z["touches"] + 1)
                    marks.append({"sign": sign, "start": z["start"], "i": row["i"], "price": sign * price})
                    break
            else:
                standing[sign].append({"sign": sign, "start": row["i"], "outer": outer, "inner": inner, "touches": 1})
    return [z for zones in standing.values() for z in zones], broken, marks


def _bounds(rows: list[dict]) -> dict:
    """What tells whether a stretch can touch a zone: its farthest closes and its swings' prices."""
    closes = [r["c"] for r in rows]
    highs = [r["h"] for r in rows if "high" in (r["kinds"] or ())] or [None]
    lows = [-r["l"] for r in rows if "low" in (r["kinds"] or ())] or [None]
    return {
        "close_up": max(closes), "close_down": -min(closes), "high_from": min(highs), "high_to": max(highs),
        "low_from": min(lows), "low_to": max(lows),
    }


def _walked(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """A row per stretch of ``steps``, walked from its seed (none if ``seeds`` lacks the stretch)."""
    kind = _schema(_WALK)

    def run(rows: pa.Table, seed: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["i"])
        zones = [z for r in seed.to_pylist() for z in r["seed"]]
        first = rows[0]
        standing, broken, marks = walk(rows, zones, first["tol"])
        row = {k: first[k] for k in ("coin", "stretch", "tol")} | _bounds(rows)
        row |= {"seed": zones, "standing": standing, "broken": broken, "marks": marks}
        return pa.Table.from_pylist([row], schema=kind)

    by = ("coin", "stretch")
    kept = seeds.select(*by, "seed")
    return steps.groupBy(*by).cogroup(kept.groupBy(*by)).applyInArrow(run, _WALK)


def _touches(zone: dict, at: dict) -> bool:
    """Whether a stretch can break a zone or come back to it."""
    up = zone["sign"] > 0
    if at["close_up" if up else "close_down"] > zone["outer"]:
        return True
    least, most = (at["high_from"], at["high_to"]) if up else (at["low_from"], at["low_to"])
    return least is not None and least <= zone["outer"] + at["tol"] and most >= zone["inner"] - at["tol"]


def carry(stretches: list[dict]) -> list[dict]:
    """The seed of each stretch of one coin in order, whether it differs from the one that was walked,
    and (stretch null) the zones standing at the end."""
    state: list[dict] = []
    out = []
    for at in sorted(stretches, key=lambda r: r["stretch"]):
        touched = [z for z in state if _touches(z, at)]
        seed = sorted(touched, key=lambda z: (z["sign"], z["start"]))
        changed = seed != sorted(at["seed"], key=lambda z: (z["sign"], z["start"]))
        out.append({"coin": at["coin"], "stretch": at["stretch"], "seed": seed, "changed": changed})
        passed = {(z["sign"], z["start"]): z for z in state if not _touches(z, at)}
        # Where the seed changed, what the last walk left standing is a guess for the stretches after.
        state = list(({(z["sign"], z["start"]): z for z in at["standing"]} | passed).values())
    return [*out, {"coin": out[0]["coin"], "stretch": None, "seed": state, "changed": False}]


def _carried(walked: DataFrame) -> DataFrame:
    kind = _schema(_CARRY)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(carry(table.to_pylist()), schema=kind)

    return walked.drop("broken", "marks").groupBy("coin").applyInArrow(run, _CARRY)


def folded(steps: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zones, marks) of all coins.

    ``steps`` are a coin's bars that matter, with ``tol`` and ``kinds``; ``last`` its last bar. Zones:
    coin, sign, start, outer, inner, touches, end, broken. Marks: coin, sign, start, i, price.
    """
    steps = durable(steps.withColumn("stretch", F.floor(F.col("i") / STRETCH)))
    nothing = steps.sparkSession.createDataFrame([], _CARRY)
    walked = durable(_walked(steps, nothing))
    while True:
        carried = durable(_carried(walked))
        changed = carried.where("changed")
        if changed.isEmpty():
            break
        again = _walked(steps.join(changed, ["coin", "stretch"], "left_semi"), changed)
        walked = durable(walked.join(changed, ["coin", "stretch"], "left_anti").unionByName(again))
    ended = walked.select("coin", F.inline("broken")).withColumn("broken", F.lit(True))
    open_ones = carried.where("stretch is null").select("coin", F.inline("seed")).join(last, "coin")
    standing = open_ones.withColumnRenamed("last", "end").withColumn("broken", F.lit(False))
    return ended.unionByName(standing), walked.select("coin", F.inline("marks"))


def drawn(zones: DataFrame) -> DataFrame:
    """Zones that enough swings opened or came back to, with their edges, state and label."""
    side = F.when(F.col("sign") > 0, "SELL").otherwise("BUY")
    a, b = F.col("sign") * F.col("outer"), F.col("sign") * F.col("inner")
    state = F.when(F.col("broken"), "BROKEN").otherwise(side)
    return zones.where(F.col("touches") >= MIN_TOUCHES).select(
        "coin",
        side.alias("side"),
        F.greatest(a, b).alias("top"),
        F.least(a, b).alias("bottom"),
        "start",
        "end",
        "touches",
        state.alias("state"),
        F.format_string("BOX ×%d · %s", "touches", state).alias("label"),
    )


def extremes(rows: DataFrame, chunk: str = "_chunk") -> DataFrame:
    """The rows that zones depend on: swings, and between two swings of a chunk the closes higher or
    lower than all since the first of them."""
    w = Window.partitionBy("coin", chunk).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    legs = rows.withColumn("_leg", F.coalesce(F.sum(F.col("kinds").isNotNull().cast("int")).over(w), F.lit(0)))
    since = Window.partitionBy("coin", chunk, "_leg").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = legs.withColumns({"_top": F.max("c").over(since), "_low": F.min("c").over(since)})
    matters = F.col("_top").isNull() | (F.col("c") > F.col("_top")) | (F.col("c") < F.col("_low"))
    return seen.where(matters | F.col("kinds").isNotNull()).drop("_leg", "_top", "_low")
