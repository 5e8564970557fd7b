"""Latest, first, dedupe and append-only change detection.

"Latest" and "first" are aggregates, not windows: they combine map-side, so a key that holds a
third of all rows is reduced in every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import durable

#: Rows still open after a round that one task settles in their order.
ROOM = 500_000


def _pick(df: DataFrame, keys: list[str], order: list[Column | str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The newest row of each key."""
    return _pick(df, keys, order, F.max_by)


def first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The oldest row of each key."""
    return _pick(df, keys, order, F.min_by)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null is a value like any other."""
    side = right.select(*[F.col(k).alias(f"_on_{k}") for k in on], *[c for c in right.columns if c not in on])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on])
    return left.join(side, same, how).drop(*[f"_on_{k}" for k in on])


def append_new(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table does not hold yet."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def violations(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows refused because the table already holds their key."""
    return new.join(existing.select(*keys).distinct(), keys, "left_semi")


def differs(left: str, right: str, columns: list[str], digits: int | None = None) -> Column:
    """Null-safe "any of these columns changed"; doubles may be compared rounded."""

    def same(c: str) -> Column:
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        if digits is not None:
            a, b = F.round(a, digits), F.round(b, digits)
        return a.eqNullSafe(b)

    return ~reduce(lambda x, y: x & y, [same(c) for c in columns])


def changed_only(
    new: DataFrame,
    newest: DataFrame,
    keys: list[str],
    columns: list[str],
    rounded: tuple[str, ...] = (),
    digits: int = 9,
) -> DataFrame:
    """New rows that record something their key's newest stored row does not.

    Recomputed doubles (``rounded``) can differ in the last bit after a different shuffle order,
    so those compare rounded.
    """
    old = newest.select(*keys, F.lit(True).alias("_seen"), *columns)
    on = reduce(lambda x, y: x & y, [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys])
    exact = [c for c in columns if c not in rounded]
    moved = F.lit(False)
    if exact:
        moved = moved | differs("n", "o", exact)
    if rounded:
        moved = moved | differs("n", "o", list(rounded), digits)
    return (
        new.alias("n")
        .join(old.alias("o"), on, "left")
        .where(F.col("o._seen").isNull() | moved)
        .select("n.*")
    )


def _settled(rows: DataFrame, order: str, groups: list[list[str]]) -> DataFrame:
    """The rows that the rule accepts of a bounded number, in one pass by ``order`` in one task."""
    places = [[rows.columns.index(c) for c in g] for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set] = [set() for _ in places]
        for b in batches:
            mask = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                # Not-a-number equals itself as a key.
                row = tuple("NaN" if v != v else v for v in row)
                claims = [tuple(row[k] for k in at) for at in places]
                claims = [None if None in c else c for c in claims]
                free = not any(c in known for c, known in zip(claims, held))
                mask.append(free)
                for c, known in zip(claims, held):
                    if free and c is not None:
                        known.add(c)
            yield b.filter(pa.array(mask, pa.bool_()))

    return rows.repartition(1).sortWithinPartitions(order).mapInArrow(run, rows.schema)


def first_wins(
    new: DataFrame,
    order: str,
    groups: list[list[str]],
    not_null: list[str] = (),
    existing: DataFrame | None = None,
) -> DataFrame:
    """Accept rows in ``order``, passing over any whose key group an accepted row holds.

    A key with a null part never collides, and a row passed over claims nothing. Each round
    accepts every row that is the earliest open claimant of all its keys, then drops the rows
    those acceptances block. A round settles all but chains of conflicts, one link a round of
    those; once at most ``ROOM`` rows are open, whatever their chains, one task settles them in
    order. ``order`` must be unique.
    """
    open_rows = new
    for c in not_null:
        open_rows = open_rows.where(F.col(c).isNotNull())

    def complete(group: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in group])

    def unclaimed(rows: DataFrame, holders: DataFrame) -> DataFrame:
        for g in groups:
            rows = rows.join(holders.where(complete(g)).select(*g).distinct(), g, "left_anti")
        return rows

    if existing is not None:
        open_rows = unclaimed(open_rows, existing)
    # Rounds carry only the order and the keys; whole rows are fetched once at the end.
    names = [order, *sorted({c for g in groups for c in g} - {order})]
    open_rows = durable(open_rows.select(*names))
    accepted = None
    while rows_left := open_rows.count():
        if accepted is not None and rows_left <= ROOM:
            accepted = accepted.unionByName(durable(_settled(open_rows, order, groups)))
            break
        leading = open_rows
        for i, g in enumerate(groups):
            head = leading.where(complete(g)).groupBy(*g).agg(F.min(order).alias(f"_head{i}"))
            leading = leading.join(head, g, "left")
        winners = reduce(
            lambda x, y: x & y,
            [
                F.col(f"_head{i}").isNull() | (F.col(f"_head{i}") == F.col(order))
                for i in range(len(groups))
            ],
        )
        won = durable(leading.where(winners).select(*names))
        accepted = won if accepted is None else accepted.unionByName(won)
        left = open_rows.join(won.select(order), order, "left_anti")
        open_rows = durable(unclaimed(left, won).select(*names))
    if accepted is None:
        return new.where(F.lit(False))
    return new.join(accepted.select(order), order, "left_semi").select(*new.columns)
