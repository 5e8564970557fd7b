"""Mixing sources to target weights by a low-discrepancy schedule (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, stored, with_row_id
from tidewatch.operators.ordered import prefix_sums, row_numbers

#: Weights of the sources in code point order, repeating; the most passes over one source.
WEIGHTS, PASSES = (5, 2, 1), 3
#: Words of a block at most, and blocks that a source is cut into at least (fewer if it has fewer words).
BLOCK, LEAST_BLOCKS = 512, 256
#: Cells of the unit interval on which points and sources meet.
CELLS = 4096
_GOLDEN = 0.6180339887498949
_UNIT = 1 << 20


def _word_count(text: Column) -> Column:
    pieces = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), SPACES)
    return F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) != "", F.size(pieces)).otherwise(0).cast("bigint")


def sized(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """_rid, doc_id, _source and the words of each row's text (null: 0)."""
    rows = docs.select("doc_id", F.col(source).alias("_source"), F.col(text).alias("_text"))
    return with_row_id(rows).select("_rid", "doc_id", "_source", _word_count(F.col("_text")).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per source: _source, _sid (its rank by code point, null last), source_size, target.

    Targets share the sum of all sizes by weight; those above ``passes`` times their source stop
    there and the excess is shared among the others, until none is above.
    """
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ranked = row_numbers(per, [], [F.col("_source").isNull(), F.col("_source")], "_sid")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_sid") - 1) % len(weights) + 1).cast("int"))
    table = stored(ranked.withColumn("_weight", turn.cast("bigint")), "sources")
    full = F.lit(passes) * F.col("source_size")
    all_of = table.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weight")).first()
    words, rest, left, level, stopped = all_of["words"] or 0, all_of["words"] or 0, all_of["weight"] or 0, 0.0, 0
    while left:
        level = rest / left
        # One row of sums; each turn stops at least one more source or is the last.
        met = full <= F.lit(level) * F.col("_weight")
        now = table.where(met).agg(
            F.count(F.lit(1)).alias("n"), F.sum(full).alias("words"), F.sum("_weight").alias("weight")
        ).first()
        if now["n"] == stopped:
            break
        stopped, rest, left = now["n"], words - (now["words"] or 0), all_of["weight"] - (now["weight"] or 0)
    target = F.least(full.cast("double"), F.lit(float(level)) * F.col("_weight"))
    return table.select("_source", "_sid", "source_size", target.alias("target"))


def cut(sources: DataFrame, block: int = BLOCK, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Add to each source its block size and count, its expected slots, and its place on the scale."""
    size = F.col("source_size")
    cut_to = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(size / least_blocks))).cast("bigint")
    shaped = sources.withColumn("_block", cut_to).withColumn("_blocks", F.ceil(size / F.col("_block")).cast("bigint"))
    slots = F.when(size > 0, F.col("target") / size * F.col("_blocks") * _UNIT).otherwise(0)
    # Whole numbers, so that neighbours on the scale meet without gap or overlap.
    shaped = shaped.withColumn("_share", F.round(slots).cast("bigint"))
    upto = prefix_sums(shaped, [], [F.col("_sid")], {"_upto": "_share"})
    return stored(upto.withColumn("_from", F.col("_upto") - F.col("_share")), "scale")


def schedule(scale: DataFrame, passes: int = PASSES) -> DataFrame:
    """The slots of the mix: slot, _sid, rank, _pass, _no (the source's block that the slot takes).

    Slot i is the point i * golden ratio mod 1 on the scale of cumulative weights, so any stretch of
    slots holds the sources close to their weights. A source's slots are ranked in order; they take
    its blocks one after the other and begin again after the last.
    """
    spark = scale.sparkSession
    whole = scale.agg(F.max("_upto")).first()[0] or 0
    n = -(-whole // _UNIT)
    width = max(1, -(-whole // CELLS))
    high, low = F.floor(F.col("slot") / _UNIT), F.col("slot") % _UNIT
    # Two parts keep the digits that one large product would lose.
    turn = (low * F.lit(_GOLDEN) + F.pmod(high * F.lit((_UNIT * _GOLDEN) % 1.0), F.lit(1.0))) % 1.0
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("_at", F.floor(turn * whole).cast("bigint"))
    points = points.withColumn("_cell", F.floor(F.col("_at") / width).cast("bigint"))
    spans = scale.where("_share > 0").select(
        "_sid",
        "_blocks",
        "_from",
        "_upto",
        F.explode(
            F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_upto") - 1) / width))
        ).alias("_cell"),
    )
    met = points.join(spans, "_cell").where("_at >= _from and _at < _upto")
    ranked = row_numbers(met.select("slot", "_sid", "_blocks"), ["_sid"], [F.col("slot")], "rank")
    nth = F.col("rank") - 1
    return ranked.select(
        "slot",
        "_sid",
        "rank",
        F.floor(nth / F.col("_blocks")).cast("int").alias("_pass"),
        (nth % F.col("_blocks")).alias("_no"),
    ).where(F.col("_pass") < passes)


def pieces(sizes: DataFrame, scale: DataFrame) -> DataFrame:
    """The documents of each source, shuffled by the MD5 of their doc_id and cut at block borders:
    _rid, _sid, _no, _words."""
    own = scale.select("_source", "_sid", "_block").withColumnRenamed("_source", "_of")
    rows = sizes.where("size > 0").join(own, F.col("_source").eqNullSafe(F.col("_of")))
    rows = rows.select("_rid", "_sid", "_block", "size", F.md5(F.col("doc_id").cast("string")).alias("_mixed"))
    placed = prefix_sums(rows, ["_sid"], [F.col("_mixed"), F.col("_rid")], {"_end": "size"})
    start = F.col("_end") - F.col("size")
    spread = placed.withColumn("_start", start).withColumn(
        "_no",
        F.explode(
            F.sequence(F.floor(F.col("_start") / F.col("_block")), F.floor((F.col("_end") - 1) / F.col("_block")))
        ),
    )
    first, last = F.col("_no") * F.col("_block"), (F.col("_no") + 1) * F.col("_block")
    words = F.least("_end", last) - F.greatest("_start", first)
    return spread.select("_rid", "_sid", "_no", words.alias("_words"))


def takes(sizes: DataFrame, sources: DataFrame, passes: int = PASSES, **how) -> DataFrame:
    """_rid, _pass, _taken: the words of a row that each pass over its source takes."""
    scale = cut(sources, **how)
    slots = schedule(scale, passes).select("_sid", "_no", "_pass")
    met = pieces(sizes, scale).join(slots, ["_sid", "_no"])
    return met.groupBy("_rid", "_pass").agg(F.sum("_words").alias("_taken"))


def mixed(docs: DataFrame, source: str = "source", text: str = "text", **how) -> DataFrame:
    """Every row with size, source_size, target (of its source) and taken, and its _rid.

    Null and blank texts have size 0 and nothing is taken of them. Null is a source of its own, last
    in order. Rows that repeat a doc_id are mixed as separate documents. Empty in, empty out. Each
    source is cut into blocks of equal words (the last one shorter), so its taken words miss the
    target by a few blocks at most.
    """
    sizes = stored(sized(docs, source, text), "sizes")
    sources = stored(targets(sizes), "targets")
    taken = takes(sizes, sources, **how).groupBy("_rid").agg(F.sum("_taken").alias("taken"))
    own = sources.withColumnRenamed("_source", "_of")
    return (
        sizes.join(own, F.col("_source").eqNullSafe(F.col("_of")))
        .join(taken, "_rid", "left")
        .select(
            "_rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
        )
    )


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix as documents: a row comes once for each pass that takes at least half of its words."""
    sizes = stored(sized(docs, source, text), "sizes")
    sources = stored(targets(sizes), "targets")
    whole = takes(sizes, sources, **how).join(sizes.select("_rid", "size"), "_rid").where("2 * _taken >= size")
    copies = whole.groupBy("_rid").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    copies = copies.select(F.col("_rid").alias("__row_of_copies"), F.col("_copies").alias("__copies"))
    rows = with_row_id(docs, "__row").join(copies, F.col("__row") == F.col("__row_of_copies"))
    again = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    return rows.select(*docs.columns, again).drop("__copy")
