"""Importance resampling towards a target: hashed features, a head-tail vocabulary, exact bucket totals."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, in_arrow, stored, with_row_id
from tidewatch.operators.ordered import row_numbers

#: Buckets that features fall into; longest run of words that is a feature.
BUCKETS, GRAM = 10_000, 1
#: Words (and, for longer runs, pairs) of the head; bytes of the longest one. Together they bound what
#: is sent to every executor.
HEAD, HEAD_BYTES = 30_000, 64
#: Least words of a document that can be drawn, percent of those that are, seed of the draw.
LEAST, PERCENT, SEED = 20, 10, 2024
#: Features that a task counts before it puts them into their buckets.
HELD = 200_000
#: Fixed value: bytes of words, upper-case ASCII letters lower-cased; all others separate.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words(body: bytes) -> list[bytes]:
    """The words of a text's UTF-8 bytes."""
    return body.translate(FOLD).split()


class Vocabulary:
    """Buckets of features. The head's words have their CRC state, the head's pairs their bucket, ready.

    A feature outside the head takes its CRC directly; a longer one goes on from the state of its
    first word, so each byte is read once. What the head holds changes no bucket.
    """

    def __init__(self, states: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], buckets: int, gram: int):
        self.states, self.pairs, self.buckets, self.gram = states, pairs, buckets, gram

    def state(self, word: bytes) -> int:
        found = self.states.get(word)
        return zlib.crc32(word) if found is None else found

    def counted(self, body: bytes) -> tuple[int, Counter]:
        """How many words, and the counts of words and of runs (tuples) of a text."""
        w = words(body)
        found: Counter = Counter(w)
        for n in range(2, self.gram + 1):
            found.update(zip(*(w[k:] for k in range(n))))
        return len(w), found

    def bucket(self, feature: bytes | tuple) -> int:
        if isinstance(feature, bytes):
            return self.state(feature) % self.buckets
        known = self.pairs.get(feature) if len(feature) == 2 else None
        if known is not None:
            return known
        state = self.state(feature[0])
        for word in feature[1:]:
            state = zlib.crc32(word, zlib.crc32(b" ", state))
        return state % self.buckets


def _bodies(table: DataFrame, text: str, *keys) -> DataFrame:
    return table.select(*keys, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))


def head(table: DataFrame, text: str = "text", gram: int = GRAM, size: int = HEAD) -> tuple[list, list]:
    """The words, and for ``gram`` of 2 and more the pairs, that are frequent in a table, at most ``size`` each.

    A task counts all its features and, whenever it holds ``HELD``, halves the table to those counted
    most; it passes on ``size`` at the end. The sums of these choose the head. They are lower bounds
    of the true counts, which only decides what is looked up and what is computed.
    """
    schema = "feature array<binary>, n long"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for body in b.column("_text"):
                w = words(body.as_py())
                counts.update(w)
                if gram > 1:
                    counts.update(zip(w, w[1:]))
                if len(counts) > HELD:
                    counts = Counter(dict(counts.most_common(HELD // 2)))
        best: list = []
        for pairs in (False, True):
            short = Counter({f: n for f, n in counts.items() if isinstance(f, tuple) == pairs
                             and len(f if not pairs else f[0] + f[1]) <= HEAD_BYTES})
            best += short.most_common(size)
        columns = [[list(f) if isinstance(f, tuple) else [f] for f, _ in best], [n for _, n in best]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    parts = in_arrow(_bodies(table, text), run, schema)
    sums = parts.groupBy("feature").agg(F.sum("n").alias("n"))
    found = []
    for width in (1, 2)[:gram]:
        best = sums.where(F.size("feature") == width).orderBy(F.desc("n"), "feature").limit(size)
        found.append([tuple(map(bytes, r["feature"])) for r in best.collect()])
    return [f[0] for f in found[0]], found[1] if gram > 1 else []


def vocabulary(
    table: DataFrame, text: str = "text", buckets: int = BUCKETS, gram: int = GRAM, size: int = HEAD
) -> tuple[dict, dict, int, int]:
    """What makes the ``Vocabulary`` whose head is frequent in a table.

    It holds ``size`` words and as many pairs at most, of ``HEAD_BYTES`` bytes at most.
    """
    frequent, pairs = head(table, text, gram, size)
    states = {w: zlib.crc32(w) for w in frequent}
    plain = Vocabulary(states, {}, buckets, gram)
    return states, {p: plain.bucket(p) for p in pairs}, buckets, gram


def bucket_totals(table: DataFrame, sent: Broadcast, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of a table fall into each bucket; ``sent`` is what ``vocabulary`` returns.

    Each task adds up its own features, so one row per task and used bucket is shuffled, and one per
    bucket reaches the driver.
    """
    schema = "bucket int, n long"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Vocabulary(*sent.value), Counter()
        totals = np.zeros(buckets, np.int64)

        def settle() -> None:
            for feature, n in held.items():
                totals[known.bucket(feature)] += n
            held.clear()

        for b in batches:
            for body in b.column("_text"):
                held.update(known.counted(body.as_py())[1])
                if len(held) > HELD:
                    settle()
        settle()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used])], schema=kind)

    whole = np.zeros(buckets, np.int64)
    for r in in_arrow(_bodies(table, text), run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        whole[r["bucket"]] = r["n"]
    return whole


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: floor(1000 * ln of the smoothed ratio)."""
    n, whole, aim = len(raw), float(raw.sum()), float(target.sum())
    ratio = [((t + 1) * (whole + n)) / ((s + 1) * (aim + n)) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def chance(doc_id: int | None, seed: int) -> int:
    """The Gumbel number of a document, drawn from its id: floor(-1000 * ln(-ln(u)))."""
    named = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(named.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, sent: Broadcast, gain: np.ndarray, text: str = "text", seed: int = SEED) -> DataFrame:
    """Every row with _rid, doc_id, n_words, n_features, weight and score."""
    schema = "_rid long, doc_id long, n_words long, n_features long, weight long, score long"
    kind = arrow_schema(schema)
    of = gain.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(*sent.value)
        bucket = known.bucket
        for b in batches:
            n_words, n_features, weight = [], [], []
            for body in b.column("_text"):
                n, found = known.counted(body.as_py())
                n_words.append(n)
                n_features.append(sum(found.values()))
                weight.append(sum(of[bucket(f)] * k for f, k in found.items()))
            ids = b.column("doc_id").to_pylist()
            score = [w + chance(i, seed) for w, i in zip(weight, ids)]
            columns = [b.column("_rid"), b.column("doc_id"), n_words, n_features, weight, score]
            columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    rows = with_row_id(_bodies(docs, text, F.col("doc_id").cast("long").alias("doc_id")))
    return in_arrow(rows, run, schema)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    buckets: int = BUCKETS,
    gram: int = GRAM,
    least: int = LEAST,
    percent: int = PERCENT,
    seed: int = SEED,
    size: int = HEAD,
) -> DataFrame:
    """Draw the documents that look most like ``target``, without replacement, by the Gumbel top-k trick.

    Returned for every row of ``docs``, a stored table: _rid, doc_id, n_words, n_features, weight,
    score and rank. Features are all runs of 1 to ``gram`` words. A document's weight is the sum of
    its features' gains, its score the weight plus a Gumbel number that its doc_id decides. Of the N
    rows with at least ``least`` words the floor(``percent`` * N / 100) highest scores have a rank
    from 1 on; ties go to the smaller doc_id, then to the earlier row; a null doc_id comes last and
    hashes as no digits. Null and empty texts have no features, a weight of zero, and are never drawn
    while ``least`` is above zero. Repeated rows are judged one by one. An empty ``docs`` gives no
    rows; an empty ``target`` leaves gains that only tell rare buckets from full ones. Other columns
    are not looked at. Bucket totals are exact and cover both tables whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, text, buckets, gram, size))
    gain = gains(bucket_totals(target, sent, buckets, text), bucket_totals(docs, sent, buckets, text))
    rows = stored(weighed(docs, sent, gain, text, seed), "weights")
    drawn = rows.where(F.col("n_words") >= least).count() * percent // 100
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_rid")]
    fit = row_numbers(rows.where(F.col("n_words") >= least), [], order, "_rank")
    ranked = fit.withColumn("rank", F.when(F.col("_rank") <= drawn, F.col("_rank"))).drop("_rank")
    short = rows.where(F.col("n_words") < least)
    return ranked.unionByName(short.withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The drawn rows of ``docs``, a stored table, with all their columns; ``settings`` as in ``resampled``."""
    good = resampled(docs, target, text, **settings).where(F.col("rank").isNotNull()).select(F.col("_rid").alias("__drawn"))
    rows = with_row_id(docs, "__row")
    return rows.join(good, F.col("__row") == F.col("__drawn"), "left_semi").drop("__row")
