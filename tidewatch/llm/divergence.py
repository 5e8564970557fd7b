"""How far the sources of a language differ in their words: in-mapper stripes and exact divergences."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, in_arrow, stored

#: A kept term is in so many documents of its language at least.
DOCUMENTS = 30
#: Added to each count; the scale that shares are rounded down to.
EXTRA, SCALE = 5, 1_000_000_000
#: Ranks of terms that a group shows.
TERMS = 50
#: Cells (term, source) that a task holds before it writes its stripes out.
CELLS = 300_000
#: Sources on the left side of one task's table of pairs, and terms of a table.
LEFT, SPREAD = 256, 20_000
#: Fixed value: bytes of terms, upper-case ASCII letters lower-cased; all others separate.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

_STRIPES = "lang string, term binary, df long, sources array<string>, counts array<long>"
_FOUND = "lang string, source string, part string, item binary, value long"


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Fold documents into stripes: lang, term, df, and the term's count in each source that has it.

    A task folds whole documents into a hash table of its own and writes it out when it holds
    ``CELLS`` cells, so a term has a row for each time it was written; ``merged`` adds them up. The
    empty term's stripe names the sources that occur, with counts of zero. Nulls are taken as ''.
    """
    kind = arrow_schema(_STRIPES)

    def batch(held: dict, names: list[str]) -> Iterator[pa.RecordBatch]:
        rows = [(name, term, stripe) for name, terms in held.items() for term, stripe in terms.items()]
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            columns = [
                [r[0] for r in part],
                [r[1] for r in part],
                [r[2][-1] for r in part],
                [[names[k] for k in r[2] if k >= 0] for r in part],
                [[n for k, n in r[2].items() if k >= 0] for r in part],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, dict[int, int]]] = {}
        number: dict[str, int] = {}
        cells = 0
        for b in batches:
            for name, origin, body in zip(*(b.column(k).to_pylist() for k in ("_lang", "_source")), b.column("_text")):
                sid = number.setdefault(origin, len(number))
                terms = held.setdefault(name, {})
                terms.setdefault(b"", {-1: 0})[sid] = 0
                for term, n in Counter(body.as_py().translate(FOLD).split()).items():
                    stripe = terms.get(term)
                    if stripe is None:
                        terms[term] = {-1: 1, sid: n}
                        cells += 1
                        continue
                    stripe[-1] += 1
                    before = stripe.get(sid)
                    if before is None:
                        stripe[sid] = n
                        cells += 1
                    else:
                        stripe[sid] = before + n
                if cells > CELLS:
                    yield from batch(held, list(number))
                    held, number, cells = {}, {}, 0
        yield from batch(held, list(number))

    empty = F.lit("")
    rows = docs.select(
        F.coalesce(F.col(lang), empty).alias("_lang"),
        F.coalesce(F.col(source), empty).alias("_source"),
        F.coalesce(F.col(text), empty).cast("binary").alias("_text"),
    )
    return in_arrow(rows, run, _STRIPES)


def merged(parts: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """One stripe per language and term in at least ``documents`` documents: lang, term, sources, counts.

    The stripes themselves are shuffled; what is unpacked stays in its task. The empty term stays.
    """
    packed = parts.repartition("lang", "term")
    # A null source carries the document frequency.
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("source"), F.col("df").alias("n"))),
        F.zip_with("sources", "counts", lambda s, n: F.struct(s.alias("source"), n.alias("n"))),
    )
    cells = packed.select("lang", "term", F.inline(entries)).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    cell = F.when(F.col("source").isNotNull(), F.struct("source", "n"))
    whole = cells.groupBy("lang", "term").agg(
        F.sum(F.when(F.col("source").isNull(), F.col("n"))).alias("df"), F.collect_list(cell).alias("c")
    )
    kept = whole.where((F.col("df") >= documents) | (F.length("term") == 0))
    return kept.select("lang", "term", F.col("c.source").alias("sources"), F.col("c.n").alias("counts"))


def headers(kept: DataFrame, salts: int) -> DataFrame:
    """One row per language: its kept terms' number, its sources by name and their totals.

    Repeated for each salt and each block of ``LEFT`` sources, as ``divergences`` asks.
    """
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    groups = cells.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    sums = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"))
    sizes = kept.groupBy("lang").agg(F.sum((F.length("term") > 0).cast("long")).alias("df"))
    rows = sums.join(sizes, "lang").select(
        "lang",
        F.lit(None).cast("binary").alias("term"),
        "df",
        F.col("g.source").alias("sources"),
        F.col("g.n").alias("counts"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    return rows.withColumn("left", F.explode(F.sequence(F.lit(0), ((F.size("sources") - 1) / LEFT).cast("int"))))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals), exact for totals up to 9 * 10^15."""
    whole, rest = np.divmod(counts, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + more
    return whole + 1


class _Language:
    """What one task adds up for one language: its table of pairs and its best terms."""

    def __init__(self, name: str, size: int, sources: list[str], totals: list[int], left: int, first: bool):
        self.name, self.sources, self.used = name, sources, first
        self.place = {s: k for k, s in enumerate(sources)}
        self.under = np.array(totals, np.int64) + EXTRA * size
        self.whole = np.array([sum(totals) + EXTRA * size], np.int64)
        self.left = range(left * LEFT, min((left + 1) * LEFT, len(sources)))
        self.pairs = np.zeros((len(self.left), len(sources)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in self.left]
        self.terms: list[bytes] = []
        self.rows: list[np.ndarray] = []

    def add(self, term: bytes, sources: list[str], counts: list[int]) -> None:
        row = np.zeros(len(self.sources), np.int64)
        row[[self.place[s] for s in sources]] = counts
        self.terms.append(term)
        self.rows.append(row)
        if len(self.rows) * len(row) >= 1 << 20 or len(self.rows) == 1000:
            self.settle()

    def settle(self) -> None:
        """Add the held terms to the pairs and to the best terms."""
        if not self.rows:
            return
        self.used = True
        count = np.stack(self.rows)
        p = shares(count + EXTRA, self.under)
        q = shares(count.sum(1) + EXTRA, self.whole)
        for k, s in enumerate(self.left):
            self.pairs[k] += np.abs(p - p[:, s : s + 1]).sum(0)
            over = np.flatnonzero((count[:, s] > 0) & (p[:, s] > q))
            more = [(int(q[i] - p[i, s]), self.terms[i]) for i in over]
            self.best[k] = heapq.nsmallest(TERMS, self.best[k] + more)
        self.terms, self.rows = [], []

    def found(self) -> Iterator[tuple]:
        self.settle()
        # Tasks without terms of the language have nothing to say, but for one that gives the zeros.
        for k, s in enumerate(self.left if self.used else ()):
            for t, other in enumerate(self.sources):
                if t != s:
                    yield self.name, self.sources[s], "pair", other.encode(), int(self.pairs[k, t])
            for value, term in self.best[k]:
                yield self.name, self.sources[s], "term", term, -value


def divergences(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    documents: int = DOCUMENTS,
) -> DataFrame:
    """How each source of a language differs from its other sources and from the language.

    Returned: lang, source, part, item, value, rank. Part ``pair`` has a row for every other source
    of the language: the sum of the absolute differences of the terms' shares. Part ``term`` has the
    50 terms whose share in the source exceeds the language's most. A share is 1 + floor(10^9 *
    (count + 5) / (total + 5 * terms)) over the terms in at least ``documents`` documents of the
    language. Ranks go by value, ties by the item's bytes. All arithmetic is in whole numbers.

    Null text, lang and source count as ''. Documents without terms, and groups of nothing else,
    still make their source occur; a language without kept terms gives pairs of zero. Repeated rows
    count each time, other columns are not looked at, an empty table gives no rows, and a long text
    needs the memory of its different terms. Stripes of a language are spread by term; its header
    reaches each task first in the order of the rows, so nothing is broadcast.
    """
    kept = stored(merged(stripes(docs, text, lang, source), documents), "stripes")
    # Each table of pairs stands for many terms, so the tables' sums are few beside the stripes.
    salts = -(-kept.count() // SPREAD) or 1
    head = stored(headers(kept, salts), "headers")
    salt = F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")
    # A language of more than LEFT sources sends its terms to each block of them.
    lefts = head.where("salt = 0").select("lang", "salt", "left").withColumnsRenamed({"salt": "_s", "lang": "_l"})
    terms = kept.where(F.length("term") > 0).select(
        "lang", "term", F.lit(0).cast("long").alias("df"), "sources", "counts", salt.alias("salt")
    )
    wide = lefts.where("left > 0")
    copies = terms.join(wide, F.col("lang") == F.col("_l")).drop("_l", "_s")
    rows = head.unionByName(terms.withColumn("left", F.lit(0))).unionByName(copies)
    spread = rows.repartition("lang", "salt", "left").sortWithinPartitions(
        "lang", "salt", "left", F.col("term").asc_nulls_first()
    )
    kind = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def batch() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        def results() -> Iterator[pa.RecordBatch]:
            for row in now.found() if now else ():
                out.append(row)
                if len(out) == 10_000:
                    yield batch()
                    out.clear()

        for b in batches:
            names = ("lang", "term", "df", "sources", "counts", "left", "salt")
            for name, term, size, sources, counts, left, salt in zip(*(b.column(k).to_pylist() for k in names)):
                if term is None:
                    yield from results()
                    now = _Language(name, size, sources, counts, left, salt == 0)
                else:
                    now.add(term, sources, counts)
        yield from results()
        yield batch()

    parts = in_arrow(spread, run, _FOUND)
    sums = parts.groupBy("lang", "source", "part", F.col("item").cast("string").alias("item")).agg(
        F.sum("value").alias("value")
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = sums.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TERMS))
