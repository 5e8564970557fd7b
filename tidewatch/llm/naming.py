"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and numbered,
so each text becomes a sequence of integers; adjacent integers are paired and the distinct pairs are
sorted and numbered in turn, until one integer is left. Two texts get the same integer at the same
level if and only if they are equal: names are ranks of values, not hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import partitions, sized_for, stored, with_row_id

#: Characters of a block.
BLOCK = 1024


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort distinct values inside the partitions that hold them and number them as ``_name``."""
    return distinct.sortWithinPartitions(*keys).withColumn("_name", F.monotonically_increasing_id())


def _name_blocks(blocks: DataFrame, spread: int) -> DataFrame:
    """(_rid, _pos, _block) → (_rid, _pos, _name), moving each block's text twice.

    A block that fills a third of all rows is first met in ``spread`` groups, by row; each group
    sends one row on, so naming sees at most ``spread`` rows of one block.
    """
    by_group = Window.partitionBy("_block", "_group").orderBy("_rid", "_pos")
    so_far = by_group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = blocks.withColumn("_group", F.pmod(F.xxhash64("_rid"), F.lit(spread))).withColumn(
        "_first", F.first(F.struct("_rid", "_pos")).over(so_far)
    )
    heads = met.where(F.col("_first") == F.struct("_rid", "_pos"))
    distinct = heads.groupBy("_block").agg(F.collect_list("_first").alias("_heads"))
    names = _numbered(distinct, ["_block"]).select("_name", F.explode("_heads").alias("_head"))
    return met.select("_rid", "_pos", "_first").join(names, F.col("_first") == F.col("_head")).select(
        "_rid", "_pos", "_name"
    )


def _name_pairs(named: DataFrame, rows: int) -> DataFrame:
    """One level up: adjacent names become pairs, distinct pairs become names. At most ``rows`` pairs."""

    def half(k: int) -> Column:
        return F.max(F.when(F.col("_pos") % 2 == k, F.col("_name")))

    pairs = named.groupBy("_rid", (F.col("_pos") / 2).cast("int").alias("_up")).agg(
        F.coalesce(half(0), F.lit(-1)).alias("_a"), F.coalesce(half(1), F.lit(-1)).alias("_b")
    )
    pairs = stored(sized_for(pairs, rows), "pairs")
    distinct = sized_for(pairs.select("_a", "_b").distinct(), rows)
    names = stored(_numbered(distinct, ["_a", "_b"]), "pair-names")
    return sized_for(pairs.join(names, ["_a", "_b"]), rows).select("_rid", F.col("_up").alias("_pos"), "_name")


def identities(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: _rid, doc_id, text_sha256, _level, _name.

    Equal (_level, _name) means equal texts; null counts as empty. Rows leave the recursion at the
    level where one name is left of them. ``docs`` is a stored table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = with_row_id(docs.select("doc_id", body.alias("_text")))
    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    # An empty text is one empty block.
    cut = F.when(F.length("_text") == 0, F.array(F.lit(""))).otherwise(cut)
    blocks = rows.select("_rid", F.posexplode(cut).alias("_pos", "_block"))
    named = stored(_name_blocks(blocks, partitions(docs.sparkSession)), "block-names")
    most, left = named.agg(F.max("_pos"), F.count(F.lit(1))).first()
    depth = (most or 0).bit_length()
    levels, ended = named, []
    for level in range(depth + 1):
        # A row with one name left has nothing at position 1; only position 0 can be its last.
        last = levels.groupBy("_rid").agg(F.max("_pos").alias("_most"), F.min("_name").alias("_name"))
        ended.append(last.where("_most = 0").select("_rid", F.lit(level).alias("_level"), "_name"))
        if level < depth:
            longer = last.where("_most > 0").select("_rid")
            levels = stored(_name_pairs(levels.join(longer, "_rid", "left_semi"), left), "level")
            left = levels.count()
    named_rows = ended[0]
    for e in ended[1:]:
        named_rows = named_rows.unionByName(e)
    facts = rows.select("_rid", "doc_id", F.sha2("_text", 256).alias("text_sha256"))
    return stored(facts.join(named_rows, "_rid"), "identities")


def duplicates(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Every row with its group of equal texts: _rid, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null is smallest); among rows that repeat
    that doc_id too, the first of the scan stays. Exactly one row of each group is kept. An empty
    table gives an empty result; other columns of the input are not looked at.
    """
    known = identities(docs, text, block)
    # Partial aggregation first: a group of a third of all rows is one row per task in the shuffle.
    groups = known.groupBy("_level", "_name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", -F.col("_rid"))).alias("_best")
    )
    # Stored, so that the join below has two plain shuffles and a hot name can be split.
    joined = known.join(stored(groups, "groups"), ["_level", "_name"])
    return joined.select(
        "_rid",
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("group_size").cast("bigint"),
        (F.col("_rid") == -F.col("_best").getField("col2")).alias("kept"),
        "text_sha256",
    )


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. ``docs`` is a stored table."""
    stay = duplicates(docs, text).where("kept").select(F.col("_rid").alias("__kept_row"))
    rows = with_row_id(docs, "__row")
    return rows.join(stay, F.col("__row") == F.col("__kept_row"), "left_semi").drop("__row")
