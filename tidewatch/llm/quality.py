"""Quality rules with host-level verdicts (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, with_row_id, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: A host is rejected when the shrunk failure rate of one rule reaches this.
HOST_LIMIT = 0.8
RULES = ("short", "repeats", "symbols", "lines")


def _repeated_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows' hashes in text order.

    Windows are sorted with their positions, so equal ones become neighbours; the positions that
    have an equal neighbour each cover three words, and the distinct covered words are counted.
    """
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.zip_with(
        F.slice(ranked, 1, F.size(ranked) - 1),
        F.slice(ranked, 2, F.size(ranked) - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    starts = F.array_distinct(F.flatten(F.array_compact(pairs)))
    covered = F.flatten(F.transform(starts, lambda s: F.array(s, s + 1, s + 2)))
    return F.size(F.array_distinct(covered)).cast("bigint")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the rules to each row, all inside the row: no shuffle.

    Added: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and
    base_failed. A null or empty text counts zero everywhere and fails. Existing columns of these
    names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    rest = [c for c in docs.columns if c not in (*made, "base_failed")]
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *rest,
        body.alias("_body"),
        words_of(F.col(text)).alias("_w"),
        F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_l"),
    )
    n = F.size("_w")
    hashed = split.select(
        *rest,
        n.cast("bigint").alias("n_words"),
        F.char_length(F.concat_ws("", "_w")).cast("bigint").alias("word_chars"),
        (F.char_length("_body") - F.char_length(F.regexp_replace("_body", SYMBOLS, "")))
        .cast("bigint")
        .alias("n_symbols"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            n >= 3,
            F.slice(
                F.transform("_w", lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))),
                F.lit(1),
                F.greatest(n - 2, F.lit(0)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    repeated = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("bigint"))
    counted = hashed.withColumn("n_repeat_words", repeated.otherwise(_repeated_words(F.col("_h"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(*rest, *made, failed.alias("base_failed"))


def _failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": F.col("n_symbols") > F.col("n_words"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host (null is a host): rows, failures and shrunk failure rate of each rule, host_kept.

    A rule's failure counts are taken as binomial with a beta prior whose mean and spread are
    fitted to all hosts by moments; a host's rate is (failures + a) / (rows + a + b), so a host of
    few rows stays near the mean of all.
    """
    per = measured.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(bad.cast("bigint")).alias(f"_f_{r}") for r, bad in _failures().items()],
    )
    per = stored(per, "hosts")
    # One row of sums over hosts, whatever the input's size.
    sums = per.agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"_f_{r}").alias(f"f_{r}") for r in RULES],
        *[F.sum(F.col(f"_f_{r}") * F.col(f"_f_{r}") / F.col("_n")).alias(f"q_{r}") for r in RULES],
    ).first()
    rates = {}
    for r in RULES:
        total = sums["n"] or 1
        mean = min(max((sums[f"f_{r}"] or 0) / total, 1e-6), 1 - 1e-6)
        within = mean * (1 - mean)
        spread = ((sums[f"q_{r}"] or 0.0) - mean * mean * total) / total - within * sums["hosts"] / total
        weight = min(max(within / max(spread, 1e-12) - 1, 1.0), 1e6)
        rates[f"rate_{r}"] = (F.col(f"_f_{r}") + mean * weight) / (F.col("_n") + weight)
    shrunk = per.withColumns(rates)
    return shrunk.withColumn("host_kept", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) < limit)


def judged(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Every row with its measures and verdict, and the row number ``_rid`` of the scan.

    Returned: _rid, doc_id, the measures, base_failed, host_kept, kept. ``kept`` is false for a row
    that fails on its own or whose host is rejected. Repeated rows are judged one by one; an empty
    table gives an empty result; clashing columns of the input are not carried.
    """
    rows = with_row_id(docs.select("doc_id", F.col(host).alias("_host"), F.col(text).alias("_text")))
    measured = stored(measures(rows, "_text").drop("_text"), "measures")
    hosts = host_verdicts(measured, "_host").select(F.col("_host").alias("_judged"), "host_kept")
    verdict = measured.join(hosts, F.col("_host").eqNullSafe(F.col("_judged")))
    return verdict.drop("_host", "_judged").withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def quality_filter(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows whose verdict is to keep them, with all their columns. ``docs`` is a stored table."""
    good = judged(docs, host, text).where("kept").select(F.col("_rid").alias("__kept_row"))
    rows = with_row_id(docs, "__row")
    return rows.join(good, F.col("__row") == F.col("__kept_row"), "left_semi").drop("__row")
